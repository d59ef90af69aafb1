"""Repair of conversation structure by a shortest edit script.

A sound conversation has the role initials ``(s?(ua)+)?``: an optional system
turn, then user and assistant in turns. The cheapest edits that make one sound
are found by dynamic programming over its rows: Keep costs 0, Rerole (to user or
assistant) 1, Delete 2, Insert (an empty user or assistant turn) 5, and a
truncated row that is not deleted 5 more. Blank and duplicate rows must be
deleted. The state is the last role put out (none, s, u, a), so each state has
one role that may follow it. Of all cheapest scripts the one whose letters are
least in ASCII order is taken: walking forward, the least letter that still
leads to the cheapest end.

Backward cost vectors are kept at every sqrt(n)-th row only; walking forward,
each block's vectors are worked out again from the checkpoint at its end.

Rows are dealt by conversation and sorted by Spark (which spills), and each task
reads them as a stream. The first pass moves no texts, only hashes and flags,
and holds one byte a row of the conversation in hand; the second meets each
conversation's script ahead of its texts and holds one text at a time. A
conversation is worked on by one task, as its script is a sequential matter,
but never as a whole in memory.

Defined results: null roles and texts are one space; a null conv_id is a
conversation of its own; rows stand in order of turn (nulls first), then role,
then a hash of the text, so that equal rows are neighbours; a row whose role has
another initial than s, u, a (or none) can't be kept; an empty table gives no
rows. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NONE, S, U, A = range(4)
#: The role that may follow a state; a system turn may also open a conversation.
FOLLOWS = (U, U, A, U)
NAMES = {U: "user", A: "assistant"}
FAR = 1 << 60
#: Row codes: the initial's state in the low bits, then flags.
MUST_GO, OPEN_END = 4, 8
#: Rows sent to Arrow at once, and at most so many letters of scripts with them.
OUT_ROWS, OUT_CHARS = 4096, 1 << 22


def damaged(conversations: DataFrame) -> DataFrame:
    """The test damage by crc32(``conv_id:turn``) % 20: (conv_id, turn, role, text, gone).

    0 drops a row (it stays as a mark that its conversation exists), 1 empties
    its text, 2 takes its ``[.!?]`` out, 3 repeats it, 4 makes its role user.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(name) % 20
    role, text = F.coalesce(F.col("role").cast("string"), blank), F.coalesce(F.col("text").cast("string"), blank)
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same layout for rows that are to be repaired as they are."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select("conv_id", "turn", role, text, F.lit(False).alias("gone"))


def _order() -> list:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64("text", "role", F.lit(1)))


def _sketches(rows: DataFrame) -> DataFrame:
    """Rows without texts, dealt by conversation, in order: (conv_id, turn, gone, code, blank, again, cut)."""
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    slim = _keyed(rows).select(
        "conv_id", "turn", "role", "h1", "h2", "gone", (shown == "").alias("blank"),
        F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(NONE).alias("code"),
        (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("cut")).repartition("conv_id")
    # Dealt by conversation already: the window needs no further shuffle.
    seen = Window.partitionBy("conv_id", "gone", "role", "h1", "h2").orderBy(F.col("turn").asc_nulls_first())
    marked = slim.withColumn("again", F.row_number().over(seen) > 1)
    return marked.sortWithinPartitions("conv_id", *_order()).select("conv_id", "turn", "gone", "code", "blank", "again", "cut")


def _before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end from ahead of a row, by state, given those from behind it."""
    best = []
    initial, extra = code & 3, TRUNCATED if code & OPEN_END else 0
    for state in range(4):
        cost = after[state] + DELETE
        if not code & MUST_GO:
            role = FOLLOWS[state]
            cost = min(cost, after[role] + REROLE + extra)
            if initial == role or (initial == S and state == NONE):
                cost = min(cost, after[initial] + extra)
        best.append(cost)
    return _with_inserts(best)


def _with_inserts(best) -> tuple[int, ...]:
    """More than two inserts at one place only lead back to a state passed before."""
    n, s, u, a = best
    return (min(n, u + INSERT, a + 2 * INSERT), min(s, u + INSERT, a + 2 * INSERT), min(u, a + INSERT), min(a, u + INSERT))


END = _with_inserts([0, FAR, FAR, 0])


class Costs:
    """Backward steps, remembered by row code and the differences of the costs (there are few of these)."""

    def __init__(self):
        self.known: dict = {}

    def step(self, code: int, after: tuple[int, ...]) -> tuple[int, ...]:
        least = min(after)
        key = code, after[0] - least, after[1] - least, after[2] - least, after[3] - least
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = _before(code, key[1:])
        return got[0] + least, got[1] + least, got[2] + least, got[3] + least


def script(codes: bytes | bytearray, costs: Costs) -> tuple[int, str]:
    """Least cost and the ASCII-least script of that cost."""
    n = len(codes)
    every = max(1, isqrt(n))
    kept, vector = {n: END}, END
    for i in range(n - 1, -1, -1):
        vector = costs.step(codes[i], vector)
        if i % every == 0:
            kept[i] = vector
    total, state, letters = vector[NONE], NONE, bytearray()
    for first in range(0, n + 1, every):
        last = min(first + every, n)
        block = [kept[last]]
        for i in range(last - 1, first - 1, -1):
            block.append(costs.step(codes[i], block[-1]))
        block.reverse()
        for i in range(first, last):
            state = _walk(codes[i], block[i - first], block[i - first + 1], state, letters)
        if last == n:
            break
    while END[state]:
        letters += b"I"
        state = FOLLOWS[state]
    return total, letters.decode()


def _walk(code: int, here: tuple, after: tuple, state: int, letters: bytearray) -> int:
    """The least tight letters up to the end of a row."""
    initial, extra = code & 3, TRUNCATED if code & OPEN_END else 0
    while True:
        role = FOLLOWS[state]
        if here[state] == after[state] + DELETE:
            letters += b"D"
            return state
        if here[state] == here[role] + INSERT:
            letters += b"I"
            state = role
            continue
        keeps = initial == role or (initial == S and state == NONE)
        if not code & MUST_GO and keeps and here[state] == after[initial] + extra:
            letters += b"K"
            return initial
        letters += b"R"
        return role


_AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """What the first pass holds of the conversation in hand."""

    def __init__(self, conv_id):
        self.id, self.codes = conv_id, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.before = -1

    def add(self, turn, code: int, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None and (self.last is None or turn != self.last):
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.before >= 0 and (self.before, code) not in ((S, U), (U, A), (A, U)):
            self.illegal += 1
        self.before = code
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        self.codes.append(code | (MUST_GO if blank or again else OPEN_END if cut else 0))

    def result(self, costs: Costs) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost, audit = script(self.codes, costs)
        return self.id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _batches(rows: Iterator[tuple], schema: pa.Schema, text_at: int) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += len(r[text_at] or "")
        if len(held) >= OUT_ROWS or chars >= OUT_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _id_type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _arrow(fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(fields))


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation of ``rows``."""
    fields = f"conv_id {_id_type(rows)}, {_AUDIT}"
    schema = _arrow(fields)

    def scripts(batches):
        def found():
            costs, now = Costs(), None
            for conv_id, turn, gone, code, blank, again, cut in _stream(batches):
                if now is None or conv_id != now.id:
                    if now is not None:
                        yield now.result(costs)
                    now = _Conversation(conv_id)
                if not gone:
                    now.add(turn, code, blank, again, cut)
            if now is not None:
                yield now.result(costs)
        yield from _batches(found(), schema, -1)

    return _sketches(rows).mapInArrow(scripts, fields)


def _scripts_then_texts(rows: DataFrame) -> DataFrame:
    """Each conversation's audit, then its texts in order, in one task."""
    found = audits(rows)
    names = [f.name for f in found.schema.fields if f.name != "conv_id"]
    ahead = found.select("conv_id", F.lit(0).alias("kind"), *names, F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                         *(F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("h1", "long"), ("h2", "long"))))
    texts = _keyed(rows.where(~F.col("gone"))).select(
        "conv_id", F.lit(1).alias("kind"), *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in names),
        "turn", "role", "text", "h1", "h2")
    return (ahead.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())
            .select("conv_id", "kind", *names, "role", "text"))


def _repaired(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, one after the other."""
    state, at = NONE, 0
    for role, text in turns:
        while audit[at] == "I":
            state, at = FOLLOWS[state], at + 1
            yield "I", NAMES[state], ""
        edit, at = audit[at], at + 1
        if edit == "K":
            state = {"s": S, "u": U, "a": A}[role[0]]
            yield edit, role, text
        elif edit == "R":
            state = FOLLOWS[state]
            yield edit, NAMES[state], text
    while at < len(audit):
        state, at = FOLLOWS[state], at + 1
        yield "I", NAMES[state], ""


def _conversations(batches) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """Each conversation's audit row and an iterator over its (role, text), which must be used up."""
    from itertools import groupby

    counted = 0

    def number(r):
        nonlocal counted
        counted += r[1] == 0
        return counted

    for _, rows in groupby(_stream(batches), key=number):
        head = next(rows)
        yield head, ((r[-2], r[-1]) for r in rows)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, role, text), places from 0."""
    fields = f"conv_id {_id_type(rows)}, place long, edit string, role string, text string"
    schema = _arrow(fields)

    def emit(batches):
        def out():
            for head, turns in _conversations(batches):
                for place, turn in enumerate(_repaired(head[8], turns)):
                    yield head[0], place, *turn
        yield from _batches(out(), schema, -1)

    return _scripts_then_texts(rows).mapInArrow(emit, fields)


def repair(rows: DataFrame) -> DataFrame:
    """Each conversation's faults, cost, audit and the SHA-256 of its repaired ``role:text`` lines."""
    fields = f"conv_id {_id_type(rows)}, {_AUDIT}, repaired_sha256 string"
    schema = _arrow(fields)

    def emit(batches):
        def out():
            for head, turns in _conversations(batches):
                digest, gap = hashlib.sha256(), b""
                for _, role, text in _repaired(head[8], turns):
                    digest.update(gap + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    gap = b"\n"
                yield head[0], *head[2:9], digest.hexdigest()
        yield from _batches(out(), schema, -2)

    return _scripts_then_texts(rows).mapInArrow(emit, fields)
