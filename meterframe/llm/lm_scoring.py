"""LM scoring by deleted interpolation (Jelinek-Mercer).

Method. The probability of a word is a mix of maximum-likelihood estimates of
orders ``order``, ..., 1 and the uniform distribution. The mixture weights
depend on how often the context was seen (buckets by powers of two) and are
learned by expectation-maximisation: a tenth of the training documents is
deleted from the counts, and the weights are those under which the remaining
("kept") counts predict the deleted part best. The final estimates use all
training documents.

Counts of words and of n-grams cover every training document. They are
gathered over token blocks (``blocks.count_keys``), one request for each
distinct n-gram of a block, so no n-gram is a hot key.

Defined results: a null or empty text has the one end token; a null id counts
as the empty text in the split; repeated rows are scored one by one and counted
as often as they occur; an empty table gives an empty result; with no training
token every order is unseen and the score is uniform over one symbol (0).
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.llm.blocks import Block, answered, count_keys, mix, rows_of, token_blocks
from meterframe.llm.common import discard, id_text, stage

END = np.uint64(0x1F0E5A7C3D2B4961)
START = np.uint64(0x7B3C9D1E5F284A60)
TRAIN, DELETED = 1, 2
MAX_BUCKET = 24
#: Corpus tokens for each range of the key space, that is for each counting task.
RANGE_TOKENS = 4_000_000


@dataclass(frozen=True)
class Model:
    order: int
    weights: np.ndarray  # [order above 1][bucket][this order, lower order]
    uniform: float       # weight of the uniform part below the unigrams
    train_tokens: int
    vocabulary: int


def training_flags(modulus: int = 7, held_out: int = 2, deleted_one_in: int = 10) -> Column:
    crc = F.crc32(id_text(F.col("doc_id")))
    train = F.pmod(crc, F.lit(modulus)) != held_out
    deleted = train & (F.pmod(F.floor(crc / modulus), F.lit(deleted_one_in)) == 0)
    return F.when(deleted, TRAIN + DELETED).when(train, TRAIN).otherwise(0)


class Grams:
    """The n-grams of a block: every token of a document and its end token."""

    def __init__(self, b: Block, order: int):
        n = len(b)
        ends = np.cumsum(b.lengths + 1) - 1
        size = int(ends[-1]) + 1 if n else 0
        cur = np.empty(size, dtype=np.uint64)
        is_end = np.zeros(size, dtype=bool)
        is_end[ends] = True
        cur[~is_end] = b.words[b.tokens]
        cur[is_end] = END
        self.doc = np.repeat(np.arange(n), b.lengths + 1)
        starts = ends - b.lengths
        place = np.arange(size) - starts[self.doc]
        train, gone = (b.flags & TRAIN) > 0, (b.flags & DELETED) > 0
        self.train, self.gone = train[self.doc], gone[self.doc]
        #: keys[k]: distinct (k+1)-grams; index[k]: each token's place in them
        self.keys, self.index, gram, back = [], [], cur, cur
        for k in range(order):
            if k:
                back = np.r_[np.full(min(1, size), START), back[:-1]]
                back[place < k] = START
                gram = mix(back, gram)
            keys, index = np.unique(gram, return_inverse=True)
            self.keys.append(keys), self.index.append(index)

    def counts(self, k: int) -> np.ndarray:
        """Training count and deleted count of each distinct (k+1)-gram in this block."""
        n = len(self.keys[k])
        return np.stack([np.bincount(self.index[k][m], minlength=n) for m in (self.train, self.gone)], axis=1)


def _request(order: int):
    """All orders in one ascending key space; the two top bits hold the order."""
    def request(b: Block):
        g = Grams(b, order)
        keys, counts = zip(*((_tag(g.keys[k], k), g.counts(k)) for k in range(order)))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        by = np.argsort(keys, kind="stable")
        return keys[by], counts[by]
    return request


def _tag(keys: np.ndarray, k: int) -> np.ndarray:
    """Keys spread over the whole space whatever the order: the low bits hold the order."""
    return (keys & ~np.uint64(3)) | np.uint64(k)


def _contexts(g: Grams, per_gram: list[np.ndarray], order: int, starts: tuple[int, int]) -> list[np.ndarray]:
    """Counts of each token's context for orders 2 and up (columns: train, deleted).

    The context of an n-gram is the (n-1)-gram that ends one token earlier; at
    the start of a document it is the start mark, seen once a document.
    """
    first = np.r_[True, g.doc[1:] != g.doc[:-1]] if len(g.doc) else np.zeros(0, dtype=bool)
    out = []
    for k in range(1, order):
        c = per_gram[k - 1][g.index[k - 1]]
        prev = np.vstack([np.zeros((1, 2), dtype=np.int64), c[:-1]]) if len(c) else c
        prev[first] = starts
        out.append(prev)
    return out


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count)), at most MAX_BUCKET."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], MAX_BUCKET)


def score_documents(docs: DataFrame, order: int = 2, iterations: int = 15) -> DataFrame:
    """Scores of all documents; learns from the training split (module docstring)."""
    if not 1 <= order <= 4:
        raise ValueError("order must be 1 to 4")
    spark = docs.sparkSession
    blocks, blocks_at = stage(token_blocks(docs, training_flags()), "lm-blocks")
    size = blocks.agg(F.sum(F.col("n_tokens") + F.col("n_docs")).alias("t"), F.sum("n_docs").alias("d")).first()
    ranges = max(1, -(-(size["t"] or 0) * order // RANGE_TOKENS))
    answers, answers_at = stage(count_keys(blocks, _request(order), 2, ranges), "lm-counts")

    def known(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_pylist()[0]
        got = right.sort_by("part")
        return pa.table({**{k: [v] for k, v in row.items()}, "answers": [got.column("counts").to_pylist()]},
                        schema=pa.schema([*left.schema, ("answers", pa.list_(pa.binary()))]))

    joined = blocks.groupBy("block").cogroup(answers.select("block", "part", "counts").groupBy("block")).applyInArrow(
        known, f"{_schema(blocks)}, answers array<binary>")
    held, held_at = stage(joined, "lm-known")
    discard(spark, blocks_at, answers_at)

    def load(row: dict) -> tuple[Block, Grams, list[np.ndarray]]:
        b = Block(row)
        g = Grams(b, order)
        tagged = np.concatenate([_tag(g.keys[k], k) for k in range(order)])
        by = np.argsort(tagged, kind="stable")
        values = answered(pa.table({"part": list(range(len(row["answers"]))), "counts": row["answers"]}), 2)
        flat = np.empty((len(by), 2), dtype=np.int64)
        flat[by] = values
        at, per = 0, []
        for k in range(order):
            per.append(flat[at:at + len(g.keys[k])])
            at += len(g.keys[k])
        return b, g, per

    totals = _totals(held, load)
    model = _learn(held, load, order, totals, iterations)
    return _score(held, load, model, totals)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _totals(held: DataFrame, load) -> dict:
    """Training tokens, distinct words, documents; of all and of the deleted part.

    A word is counted by the share of its training count that lies in a block,
    so the sum of the shares is the number of distinct words.
    """
    def measure(batches):
        for batch in batches:
            for row in rows_of(batch):
                b, g, per = load(row)
                own, c = g.counts(0), per[0]
                seen = c[:, 0] > 0
                kept, own_kept = c[:, 0] - c[:, 1], own[:, 0] - own[:, 1]
                yield pa.RecordBatch.from_pydict({
                    "n": [int(own[:, 0].sum())], "n_deleted": [int(own[:, 1].sum())],
                    "v": [float((own[seen, 0] / c[seen, 0]).sum())],
                    "v_kept": [float((own_kept[kept > 0] / kept[kept > 0]).sum())],
                    "d": [int(((b.flags & TRAIN) > 0).sum())], "d_deleted": [int(((b.flags & DELETED) > 0).sum())]})

    cols = ["n", "n_deleted", "v", "v_kept", "d", "d_deleted"]
    got = held.mapInArrow(measure, "n long, n_deleted long, v double, v_kept double, d long, d_deleted long").agg(
        *(F.sum(c).alias(c) for c in cols)).first()
    return {c: int(round(got[c] or 0)) for c in cols}


def _learn(held: DataFrame, load, order: int, t: dict, iterations: int) -> Model:
    """EM for the weights, on the deleted documents' tokens against the kept counts."""
    names = [f"p{k}" for k in range(order)] + [f"b{k}" for k in range(1, order)]
    n_kept, d_kept = t["n"] - t["n_deleted"], t["d"] - t["d_deleted"]

    def events(batches):
        for batch in batches:
            for row in rows_of(batch):
                _, g, per = load(row)
                m = g.gone
                if not m.any():
                    continue
                contexts = _contexts(g, per, order, (t["d"], t["d_deleted"]))
                cols = {"p0": _ratio(_kept(per[0][g.index[0]][m]), np.float64(max(n_kept, 1)))}
                for k in range(1, order):
                    context = _kept(contexts[k - 1][m])
                    cols[f"p{k}"] = _ratio(_kept(per[k][g.index[k]][m]), context)
                    cols[f"b{k}"] = _bucket(context)
                flat = np.stack([cols[c] for c in names], axis=1)
                distinct, n = np.unique(flat, axis=0, return_counts=True)
                yield pa.RecordBatch.from_pydict({**{c: distinct[:, i].astype(np.float64) for i, c in enumerate(names)},
                                                  "n": n.astype(np.int64)})

    schema = ", ".join(f"{c} double" for c in names) + ", n long"
    seen = held.mapInArrow(events, schema).groupBy(*names).agg(F.sum("n").alias("n"))
    seen, seen_at = stage(seen, "lm-events")
    flat = 1.0 / (t["v_kept"] + 1)
    weights = np.full((max(order - 1, 0), MAX_BUCKET + 1, 2), 0.5)
    if order > 1:
        weights[:, 0] = (0.0, 1.0)
    uniform = 0.5
    for _ in range(iterations):
        # The chance that a token came from each order, from the mix so far.
        below = F.col("p0") * (1 - uniform) + uniform * flat
        share, parts = [], []
        for k in range(1, order):
            w = F.element_at(F.array(*(F.lit(float(x)) for x in weights[k - 1, :, 0])), F.col(f"b{k}").cast("int") + 1)
            below, lower = w * F.col(f"p{k}") + (1 - w) * below, below
            share.append((w * F.col(f"p{k}"), (1 - w) * lower, below))
        left = F.lit(1.0)
        sums = []
        for k in range(order - 1, 0, -1):
            own, rest, whole = share[k - 1]
            sums += [(k, F.col("n") * left * own / whole, F.col("n") * left * rest / whole)]
            left = left * rest / whole
        base = F.col("p0") * (1 - uniform) + uniform * flat
        cols = [F.sum(F.col("n") * left * F.lit(uniform * flat) / base).alias("u"), F.sum(F.col("n") * left).alias("all")]
        buckets = [f"b{k}" for k in range(1, order)]
        for k, own, rest in sums:
            cols += [F.sum(own).alias(f"own{k}"), F.sum(rest).alias(f"rest{k}")]
        got = seen.groupBy(*buckets).agg(*cols).collect()  # at most (MAX_BUCKET + 1) ** (order - 1) rows
        if not got:
            break
        uniform = min(max(sum(r["u"] for r in got) / sum(r["all"] for r in got), 1e-6), 1.0)
        for k in range(1, order):
            for b in range(1, MAX_BUCKET + 1):
                own = sum(r[f"own{k}"] for r in got if r[f"b{k}"] == b)
                rest = sum(r[f"rest{k}"] for r in got if r[f"b{k}"] == b)
                if own + rest > 0:
                    weights[k - 1, b, 0] = min(max(own / (own + rest), 0.0), 1 - 1e-6)
    discard(held.sparkSession, seen_at)
    return Model(order, weights[:, :, 0], uniform, t["n"], t["v"])


def _kept(c: np.ndarray) -> np.ndarray:
    return (c[:, 0] - c[:, 1]).astype(np.float64)


def _ratio(a, b):
    return np.divide(a, b, out=np.zeros(len(a)), where=np.broadcast_to(b, len(a)) > 0)


def _score(held: DataFrame, load, m: Model, t: dict) -> DataFrame:
    def score(batches):
        for batch in batches:
            for row in rows_of(batch):
                b, g, per = load(row)
                c = per[0][g.index[0]][:, 0].astype(np.float64)
                p = _ratio(c, np.float64(m.train_tokens)) * (1 - m.uniform) + m.uniform / (m.vocabulary + 1)
                contexts = _contexts(g, per, m.order, (t["d"], t["d_deleted"]))
                for k in range(1, m.order):
                    seen = contexts[k - 1][:, 0].astype(np.float64)
                    w = m.weights[k - 1][_bucket(seen)]
                    p = w * _ratio(per[k][g.index[k]][:, 0].astype(np.float64), seen) + (1 - w) * p
                base = np.log10(c + 1) - math.log10(m.train_tokens + m.vocabulary + 1)
                total = lambda x: np.bincount(g.doc, weights=x, minlength=len(b))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.doc_id_array(), "held_out": pa.array((b.flags & TRAIN) == 0, pa.bool_()),
                    "n_tokens": b.lengths + 1, "n_known": total(c > 0).astype(np.int64),
                    "train_tokens": np.full(len(b), m.train_tokens, dtype=np.int64),
                    "base_score": total(base), "score": total(np.log10(p))})

    return held.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                  "base_score double, score double")
