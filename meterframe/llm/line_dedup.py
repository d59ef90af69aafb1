"""Line dedup by pairwise alignment.

A document overlaps an earlier one if they share a run of lines. Partners are
found by keys: the hashes of the shortest runs of lines that hold
``min_block_words`` words and begin or end at a line (a line with so many words
is a run by itself; every line of a common block lies in such a run). Every
later holder of a key is paired with the earliest one, so a key gives one pair
for each holder however common it is; a pair found through several keys is
aligned once.

Each pair is aligned with patience diff over line hashes: common ends, then the
longest ascending run of lines that are unique in both, then the gaps between
them. Runs of aligned lines that hold at least ``min_block_words`` words are
common blocks and are deleted from the later document. Where this leaves a
shared run (it stands in another order in the earlier document, or holds no line
that is unique), the pair is aligned again with that run as its anchor, until no
common block is left. So a pair deletes all lines of the later document that lie
in a run of ``min_block_words`` words which the earlier one has too, and as each
run is met with its earliest holder, the deletions of all pairs add up to those
of the pairs of all documents.

Order of documents: by doc_id (null last), then by the hash of the text. Rows
that agree in doc_id and text are one document: each of them gets its result.
Lines are compared without white space at their ends; blank lines take no part
and stay. Defined results: a null text stays null and has no lines; an empty
table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import KEY, row_key, stage


def common_lines(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Aligned line numbers (in a, in b), ascending in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        anchors = _unique_run(a, alo, ahi, b, blo, bhi)
        if not anchors:
            continue
        out += anchors
        edges = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(out)


def _unique_run(a, alo, ahi, b, blo, bhi) -> list[tuple[int, int]]:
    def places(x, lo, hi):
        once: dict = {}
        for i in range(lo, hi):
            once[x[i]] = -1 if x[i] in once else i
        return once
    pa_, pb = places(a, alo, ahi), places(b, blo, bhi)
    pairs = [(i, pb[h]) for h, i in pa_.items() if i >= 0 and pb.get(h, -1) >= 0]
    pairs.sort()
    ends, at, back = [], [], []
    for n, (_, j) in enumerate(pairs):  # longest ascending run of j
        k = bisect_left(ends, j)
        back.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(j), at.append(n)
        else:
            ends[k], at[k] = j, n
    run, n = [], at[-1] if at else -1
    while n >= 0:
        run.append(pairs[n])
        n = back[n]
    return run[::-1]


def blocks_to_delete(later: np.ndarray, earlier: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """Lines of ``later`` that lie in common blocks of at least ``min_words`` words."""
    gone = np.zeros(len(later), bool)
    block: list = []
    for i, j in [*common_lines(later, earlier), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(int(words[x]) for x, _ in block) >= min_words:
                gone[block[0][0]:block[-1][0] + 1] = True
            block = []
        block.append((i, j))
    first, end = shared_runs(later, earlier, words, min_words)
    kept = np.r_[0, np.cumsum(~gone)]
    for i, j in zip(first, end):  # aligned again, with a run that was left as the anchor
        if kept[j] > kept[i]:
            gone[i:j] = True
    return np.flatnonzero(gone)


def shared_runs(later: np.ndarray, earlier: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and end of the shortest runs of ``later`` that stand in ``earlier`` too."""
    first, end = runs(words, min_words)
    known, at = np.unique(later, return_index=True)
    near = np.minimum(np.searchsorted(known, earlier), len(known) - 1)
    # A line that the later document lacks is in no shared run, whatever its words.
    there = runs(np.where(known[near] == earlier, words[at[near]], min_words), min_words)
    hit = np.isin(run_keys(later, first, end), run_keys(earlier, *there))
    return first[hit], end[hit]


def runs(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and end of the shortest runs of lines with ``min_words`` words: one begins and one ends at each line.

    So every line of a common block lies in a run inside the block.
    """
    upto = np.r_[0, np.cumsum(words, dtype=np.int64)]
    ends = np.searchsorted(upto, upto[:-1] + min_words, "left")
    starts = np.searchsorted(upto, upto[1:] - min_words, "right") - 1
    at = np.arange(len(words))
    return np.r_[at[ends < len(upto)], starts[starts >= 0]], np.r_[ends[ends < len(upto)], at[starts >= 0] + 1]


def run_keys(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the lines of each run; a single line keeps its own."""
    odd = 0x9E3779B97F4A7C15
    powers = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(len(hashes), x, dtype=np.uint64)], dtype=np.uint64)
    up, down = powers(odd), powers(pow(odd, -1, 1 << 64))
    sums = np.r_[np.uint64(0), np.cumsum(hashes.view(np.uint64) * up[:-1], dtype=np.uint64)]
    length = (end - first - 1).astype(np.uint64)
    return ((sums[end] - sums[first]) * down[first] + length * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def _arrays(batch: pa.RecordBatch, *names: str):
    """The named list columns of each row."""
    cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for r in range(batch.num_rows):
        yield tuple(c[r].values.to_numpy(zero_copy_only=False) for c in cols)


def dedup_lines(docs: DataFrame, min_block_words: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed, text): lines numbered from 0, text without the removed ones."""
    lines = F.split("text", "\n", -1)
    rows = docs.select("doc_id", "text")
    trimmed = F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")))
    full = F.filter(F.transform(trimmed, lambda x, i: F.struct(
        i.alias("line"), F.xxhash64(x).alias("hash"), F.regexp_count(x, F.lit(r"[^\x09-\x0D\x20]+")).alias("words"),
        (F.length(x) > 0).alias("full"))), lambda s: s["full"])
    slim = (rows.where(F.col("text").isNotNull()).select(F.struct(*row_key()).alias("doc"), full.alias("f"))
            .select("doc", F.col("f.line").alias("line"), F.col("f.hash").alias("hash"), F.col("f.words").alias("words")))

    def with_keys(batches):
        for batch in batches:
            # Here and not as a condition of the plan, which would work the lines out once more.
            batch = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column(2)), 0))
            keys = []
            for h, w in _arrays(batch, "hash", "words"):
                keys.append(np.unique(run_keys(h, *runs(w, min_block_words))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    doc_type = slim.schema["doc"].dataType.simpleString()
    slim, _ = stage(slim.mapInArrow(with_keys, f"doc {doc_type}, line array<int>, hash array<bigint>, words array<int>, keys array<bigint>"),
                    "lines")
    held = slim.select("doc", F.explode("keys").alias("key"))
    shared = (held.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
              .where(F.col("first") != F.col("last")).drop("last"))
    pairs, _ = stage(held.join(shared, "key").where(F.col("doc") != F.col("first")).select("doc", "first").distinct(), "line-pairs")
    one = slim.select("doc", "hash", "words", "line").dropDuplicates(["doc"])

    def align(batches):
        for batch in batches:
            found = [line[blocks_to_delete(b, a, words, min_block_words)]
                     for a, b, words, line in _arrays(batch, "a", "b", "words", "line")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc", "removed"])

    later = one.select("doc", F.col("hash").alias("b"), "words", "line")
    earlier = one.select(F.col("doc").alias("first"), F.col("hash").alias("a"))
    both = pairs.join(later, "doc").join(earlier, "first").select("doc", "a", "b", "words", "line")
    found = both.mapInArrow(align, f"doc {doc_type}, removed array<int>").where(F.size("removed") > 0)
    gone = found.groupBy("doc").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))
    gone = gone.select(*(F.col(f"doc.{c}").alias(c) for c in KEY), "removed")
    out = rows.select("doc_id", "text", *row_key()).join(gone, KEY, "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), removed)
    clean = F.when(F.size(removed) == 0, F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return out.select("doc_id", n_lines.cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"),
                      removed.alias("removed"), clean.alias("text"))
