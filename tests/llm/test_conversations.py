"""Conversation operators against brute force, and on odd input."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from meterframe.llm import turn_repair, turn_trie
from meterframe.llm.registry import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, h1 string, audit int, kind string, ids string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)


def odd_rows(seed, conversations=60):
    """Short texts from a small set, so that turns repeat; nulls, ties, strange roles and ids."""
    rng = random.Random(seed)
    texts = ["a b.", "c", "", "  \n", "d e f?", "g!", "h i", None, "É ü.", "x . y"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "User"]
    rows = []
    for c in [*range(conversations), None, -3, 10**15]:
        turn = rng.choice([0, 0, 3])
        for _ in range(rng.randint(0, 7)):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(roles), rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 1, 1, 2])
    return rows


# -- op12 ---------------------------------------------------------------------------------------

SOUND, OPEN = re.compile(r"(s?(ua)+)?"), re.compile(r"s?(ua)*u?")


def least_audit(rows):
    """Least (cost, audit) over all scripts with at most three inserts in a place, by plain recursion."""
    @functools.lru_cache(None)
    def best(i, roles, inserts):
        found = [(10**9, "~")]
        if i == len(rows) and SOUND.fullmatch(roles):
            found.append((0, ""))
        steps = [("u", 5, "I", i), ("a", 5, "I", i)] if inserts else []
        if i < len(rows):
            role, must_go, cut = rows[i]
            steps.append(("", 2, "D", i + 1))
            if not must_go:
                steps += [(r, c + 5 * cut, e, i + 1) for r, c, e in ((role, 0, "K"), ("u", 1, "R"), ("a", 1, "R")) if r]
        for role, cost, edit, then in steps:
            if OPEN.fullmatch(roles + role):
                rest = best(then, roles + role, inserts - 1 if then == i else 3)
                found.append((cost + rest[0], edit + rest[1]))
        return min(found)

    return best(0, "", 3)


def brute_repair(rows):
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        keep = convs[c]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        keep.extend([] if kind == 0 else [(t, role, text)] * (2 if kind == 3 else 1))
    return convs


def check_repair(convs, got, order):
    """``order``: each conversation's rows in the operator's order."""
    for c, rows in convs.items():
        rows = order[c]
        seen, flags, n = set(), [], collections.Counter()
        for _, role, text in rows:
            shown = text.rstrip(" \t\n\x0b\f\r")
            blank, again, cut = not shown, (role, text) in seen, shown[-1:] not in (".", "!", "?")
            seen.add((role, text))
            n["blank" if blank else "duplicate" if again else "truncated" if cut else "fine"] += 1
            flags.append((role[:1] if role[:1] in ("s", "u", "a") else "", blank or again, cut and not blank and not again))
        pairs = zip(rows, rows[1:])
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in pairs)
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = least_audit(tuple(flags))
        out, roles, rest = [], "", list(rows)
        for letter in audit:
            nxt = "u" if not roles or roles[-1] in "sa" else "a"
            if letter == "I":
                out.append({"u": "user", "a": "assistant"}[nxt] + ":")
                roles += nxt
                continue
            _, role, text = rest.pop(0)
            if letter == "K":
                out.append(f"{role}:{text}")
                roles += role[0]
            elif letter == "R":
                out.append({"u": "user", "a": "assistant"}[nxt] + f":{text}")
                roles += nxt
        assert re.fullmatch("(s?(ua)+)?", roles) and not rest
        g = got[c]
        assert (g.gaps, g.blank, g.duplicate, g.truncated, g.illegal, g.cost, g.audit) == \
            (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit), (c, rows)
        assert g.repaired_sha256 == hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_script_against_all_scripts():
    """Every conversation of up to 5 rows over all kinds of rows, by full search."""
    costs = turn_repair.Costs()
    kinds = [(r, m, c) for r in ("s", "u", "a", "") for m, c in ((False, False), (False, True))] + [("u", True, False)]
    code = {"": 0, "s": 1, "u": 2, "a": 3}
    rng = random.Random(3)
    cases = [c for n in range(4) for c in itertools.product(kinds, repeat=n)]
    cases += [tuple(rng.choice(kinds) for _ in range(n)) for n in (4, 5, 6, 7, 9, 12) for _ in range(150)]
    for rows in cases:
        codes = bytes(code[r] | (turn_repair.MUST_GO if m else turn_repair.OPEN_END if c else 0) for r, m, c in rows)
        assert turn_repair.script(codes, costs) == least_audit(rows), rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_brute_force(spark, seed):
    rows = odd_rows(seed)
    damaged = turn_repair.damaged(table(spark, rows))
    got = {r.conv_id: r for r in turn_repair.repair(damaged).collect()}
    convs = brute_repair(rows)
    assert set(got) == {r[0] for r in rows}
    kept = [r for r in turn_repair._keyed(damaged).collect() if not r.gone]
    order = collections.defaultdict(list)
    for r in sorted(kept, key=lambda r: (r.turn is not None, r.turn or 0, r.role, r.h1, r.h2)):
        order[r.conv_id].append((r.turn, r.role, r.text))
    assert {c: sorted(map(repr, v)) for c, v in convs.items() if v} == {c: sorted(map(repr, v)) for c, v in order.items()}
    check_repair(convs, got, order)


def test_repair_of_given_table(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    convs = brute_repair(rows)
    got = {r.conv_id: r for r in QUERIES["op12_structure_repair"](spark, sf_small).collect()}
    assert set(got) == {r[0] for r in rows}
    check_repair(convs, got, {c: sorted(v, key=lambda r: r[0]) for c, v in convs.items()})


def test_repaired_turns_give_the_digest(spark):
    damaged = turn_repair.damaged(table(spark, odd_rows(5)))
    lines = collections.defaultdict(list)
    for r in sorted(turn_repair.repaired_turns(damaged).collect(), key=lambda r: r.place):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in turn_repair.repair(damaged).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines[r.conv_id]).encode()).hexdigest()


def test_repair_of_empty_table_and_long_conversation(spark):
    assert turn_repair.repair(turn_repair.damaged(table(spark, []))).count() == 0
    n = 20_000
    rows = [(1, t, ("user", "assistant")[t % 2], f"word {t}.") for t in range(n)] + [(2, 0, "user", "w " * 500_000 + ".")]
    got = {r.conv_id: r for r in turn_repair.repair(turn_repair.undamaged(table(spark, rows))).collect()}
    assert got[1].audit == "K" * n and got[1].cost == 0 and got[1].gaps == 0
    assert (got[2].audit, got[2].cost) == ("D", 2)
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows[:n]).encode()).hexdigest()


# -- op13 ---------------------------------------------------------------------------------------

def brute_trie(turns):
    """Nodes of {conv_id: ((role, text), ...)} by counting every prefix."""
    members, children = collections.defaultdict(list), collections.defaultdict(set)
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
            if d:
                children[t[:d - 1]].add(t[:d])
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(turns[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def brute_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = tuple(convs.get(head, [])[:h]) + tuple(own[h:])
    return out


def ordered(spark, rows):
    """{conv_id: [(role, text)]} in the operator's order."""
    keyed = (table(spark, rows).where(F.col("conv_id").isNotNull()).na.fill("", ["role", "text"])
             .withColumn("a", F.xxhash64("role", "text")).withColumn("b", F.xxhash64("text", "role", F.lit(1))).collect())
    out = collections.defaultdict(list)
    for r in sorted(keyed, key=lambda r: (r.turn is not None, r.turn or 0, r.a, r.b)):
        out[r.conv_id].append((r.role, r.text))
    return out


def result(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,shards", [(1, 1), (2, 7), (3, 40)])
def test_trie_against_brute_force(spark, seed, shards):
    """Many shards, so that most nodes cross borders."""
    rows = odd_rows(seed, 120) + [(c, t, "user", f"same {t}") for c in range(500, 560) for t in range(1 + c % 3)]
    rows += [(7000, t, "user", "long text") for t in range(50)] + [(7001, t, "user", "long text") for t in range(47)]
    turns = turn_trie.rebuilt(table(spark, rows))
    assert result(turn_trie.trie(turns, shards)) == brute_trie(brute_rebuilt(ordered(spark, rows)))


def test_trie_as_they_are_and_empty(spark):
    rows = [(c, t, "user", "hi there" if t < 3 else f"w{c}") for c in range(30) for t in range(c % 5 + 1)]
    plain = {c: tuple(v) for c, v in ordered(spark, rows).items()}
    assert result(turn_trie.prefix_trie(table(spark, rows), rebuild=False)) == brute_trie(plain)
    assert turn_trie.prefix_trie(table(spark, [])).count() == 0
    assert turn_trie.prefix_trie(table(spark, [(None, 0, "user", "x")])).count() == 0


def test_trie_of_given_table(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op13_prefix_trie"](spark, sf_small)) == brute_trie(brute_rebuilt(ordered(spark, rows)))
