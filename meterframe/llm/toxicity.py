"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Examples are the labelled training texts, at most ``max_examples`` of each
label (the first by the hash of their id). Terms are the words whose presence
tells the labels apart best among the examples (chi-squared); their document
frequencies are counted over all documents. Every text becomes a TF-IDF vector
of unit length over these terms.

The examples lie in an inverted index of blocks, sorted so that alike vectors
share a block. For a query the blocks' largest weights for its terms bound each
block's best cosine from above; blocks are scored in that order and the search
ends at the first bound below the k-th best so far, so the k neighbours are
exact (ties: the smaller id). They vote with their cosine, each label weighted
up to its share among all labelled training rows, and a monotone fit on
leave-one-out votes of the examples turns votes into probabilities. The
neighbours' ids are the evidence. Texts without any term score as often as
examples without any term are labelled.

A score depends on the text alone. Defined results: null and empty texts have
no terms; labels other than 0 and 1 and null ids are passed over; an id with
both labels is an example of each; several texts of one id give the smallest as
example; without examples every score is 0; repeated rows are scored one by one;
an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import id_text, stage

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
THRESHOLD = 0.7


@dataclass(frozen=True)
class Settings:
    max_examples: int = 6000   # of each label
    max_terms: int = 256
    least_chi2: float = 40.0
    least_texts: int = 8       # examples that hold a term
    k: int = 25
    block: int = 64


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(id_text(doc_id)), F.lit(3)) == 1


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Index:
    """Examples as unit vectors, in blocks with each term's largest weight."""

    def __init__(self, terms: dict, idf: np.ndarray, found: list[tuple[int, int, dict]], rate: dict, s: Settings):
        self.terms, self.idf, self.k, self.size = terms, idf, s.k, s.block
        filled = sorted((x for x in found if x[2]), key=lambda x: (sorted(x[2], key=lambda t: -idf[t]), x[0], x[1]))
        self.ids = np.array([x[0] for x in filled], dtype=np.int64)
        self.labels = np.array([x[1] for x in filled], dtype=np.int64)
        # Examples with equal vectors are one row of the index; each row's first
        # k + 1 examples (by id) are all that a search can ask for.
        rows: dict = {}
        self.of = np.array([rows.setdefault(tuple(sorted(tf.items())), len(rows)) for _, _, tf in filled], dtype=np.int64)
        n = -(-len(rows) // s.block)
        # Postings: each term's weights, block after block (the last one filled up with zeros).
        self.postings = np.zeros((len(idf), n, s.block))
        for r, tf in enumerate(rows):
            t, w = self.vector(dict(tf))
            self.postings[t, r // s.block, r % s.block] = w
        self.members = [np.flatnonzero(self.of == r) for r in range(len(rows))]
        self.members = [m[np.argsort(self.ids[m], kind="stable")][:s.k + 1] for m in self.members]
        self.held = np.array([len(m) for m in self.members], dtype=np.int64)
        self.best = self.postings.max(axis=2).T if n else None
        n_of = {y: max(1, sum(x[1] == y for x in found)) for y in (0, 1)}
        #: Rows of the population that one example stands for.
        self.stands = np.array([rate[0] / n_of[0], rate[1] / n_of[1]])
        empty = [x[1] for x in found if not x[2]]
        weight = np.array([self.stands[y] for y in empty])
        self.without = float((weight * np.array(empty)).sum() / weight.sum()) if len(empty) else 0.0
        self.steps = None

    def vector(self, tf: dict) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(sorted(tf), dtype=np.int64)
        w = np.array([1 + np.log(tf[i]) for i in t]) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    @property
    def rows(self) -> np.ndarray:
        """The distinct vectors."""
        terms, blocks, size = self.postings.shape
        return self.postings.reshape(terms, blocks * size).T[:len(self.members)]

    @property
    def x(self) -> np.ndarray:
        """The examples' vectors."""
        return self.rows[self.of]

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest, exact."""
        bound = self.best[:, t] @ w
        order = np.argsort(-bound, kind="stable")
        rows, cos, bar, at, step = np.zeros(0, dtype=np.int64), np.zeros(0), 0.0, 0, 8
        while at < len(order):
            some = order[at:at + step]
            at, step = at + step, 2 * step
            some = some[(bound[some] > 0) & (bound[some] >= bar - 1e-12)]
            if not len(some):
                break
            c = np.tensordot(w, self.postings[np.ix_(t, some)], 1).ravel()
            near = np.flatnonzero((c > 0) & (c >= bar - 1e-12))
            rows = np.concatenate([rows, some[near // self.size] * self.size + near % self.size])
            cos = np.concatenate([cos, c[near]])
            best = np.argsort(-cos, kind="stable")
            enough = np.flatnonzero(np.cumsum(self.held[rows[best]]) >= k)
            if len(enough):
                bar = cos[best[enough[0]]]
                stay = cos >= bar - 1e-12
                rows, cos = rows[stay], cos[stay]
        if not len(rows):
            return rows, cos
        found = np.concatenate([self.members[r] for r in rows])
        cos = np.repeat(cos, self.held[rows])
        best = np.lexsort((self.ids[found], -np.round(cos, 12)))[:k]
        return found[best], cos[best]

    def vote(self, rows: np.ndarray, cos: np.ndarray) -> float:
        if not len(rows):
            return self.without
        weight = cos * self.stands[self.labels[rows]]
        return float((weight * self.labels[rows]).sum() / weight.sum())

    def calibrate(self) -> None:
        """Monotone steps from leave-one-out votes to the share labelled 1."""
        votes, labels, near, every = [], [], {}, self.rows
        for i in range(len(self.ids)):
            if self.of[i] not in near:
                vector = every[self.of[i]]
                t = np.flatnonzero(vector)
                near[self.of[i]] = self.nearest(t, vector[t], self.k + 1)
            rows, cos = near[self.of[i]]
            other = rows != i
            votes.append(self.vote(rows[other][:self.k], cos[other][:self.k])), labels.append(int(self.labels[i]))
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # upper vote, weight, weight labelled 1
        for i in order:
            weight = self.stands[labels[i]]
            pools.append([votes[i], weight, weight * labels[i]])
            while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or
                                      pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]):
                top, w, p = pools.pop()
                pools[-1] = [top, pools[-1][1] + w, pools[-1][2] + p]
        self.steps = (np.array([p[0] for p in pools]), np.array([p[2] / p[1] for p in pools]))

    def score(self, tf: dict) -> tuple[float, list[int]]:
        """A probability (with a small share of the raw vote, to part equal steps) and the evidence."""
        if not tf or self.best is None:
            return self.without, []
        rows, cos = self.nearest(*self.vector(tf), self.k)
        vote = self.vote(rows, cos)
        at = min(int(np.searchsorted(self.steps[0], vote)), len(self.steps[0]) - 1)
        return 0.99 * float(self.steps[1][at]) + 0.01 * vote, [int(i) for i in self.ids[rows[:5]]]


def _term_counts(text, terms: dict) -> dict:
    tf: dict = {}
    for w in words(text):
        i = terms.get(w)
        if i is not None:
            tf[i] = tf.get(i, 0) + 1
    return tf


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Index | None:
    """The index of examples; None without labelled training texts."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct())
    known, _ = stage(known, "tox-labels")
    first = lambda y: (known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id")
                       .limit(s.max_examples))
    picked = first(0).unionByName(first(1))
    # Bounded by max_examples: two small columns for each example.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = (texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label")
              .agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    sample, _ = stage(sample.repartition(12, "doc_id"), "tox-examples")
    rate = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size:
        return None

    def presence(batches):
        seen: dict = {}
        for batch in batches:
            for text, y in zip(batch.column(2), batch.column(1).to_pylist()):
                for w in set(words(text.as_py())):
                    seen.setdefault(w, [0, 0])[y] += 1
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(seen), pa.binary()),
                                          "n0": pa.array([n[0] for n in seen.values()], pa.int64()),
                                          "n1": pa.array([n[1] for n in seen.values()], pa.int64())})

    n0, n1 = size.get(0, 0), size.get(1, 0)
    counts = sample.mapInArrow(presence, "w binary, n0 long, n1 long").groupBy("w").agg(
        F.sum("n0").cast("double").alias("n0"), F.sum("n1").cast("double").alias("n1"))
    total, held = F.lit(float(n0 + n1)), F.col("n0") + F.col("n1")
    odd = F.col("n1") * n0 - F.col("n0") * n1
    chi2 = total * odd * odd / (held * (total - held) * float(max(n0 * n1, 1)))
    best = (counts.where((held >= s.least_texts) & (held < total)).withColumn("chi2", chi2)
            .where(F.col("chi2") >= s.least_chi2).orderBy(F.desc("chi2"), "w").limit(s.max_terms).collect())
    terms = {bytes(r["w"]): i for i, r in enumerate(best)}

    def frequency(batches):
        n, df = 0, np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                n += 1
                df[list(_term_counts(text.as_py(), terms))] += 1
        yield pa.RecordBatch.from_pydict({"term": np.r_[-1, np.arange(len(terms))].astype(np.int32), "n": np.r_[n, df]})

    df = {r["term"]: r["n"] for r in texts.select("text").mapInArrow(frequency, "term int, n long")
          .groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = np.array([1 + np.log((1 + df.get(-1, 0)) / (1 + df.get(i, 0))) for i in range(len(terms))])

    def vectors(batches):
        for batch in batches:
            tf = [_term_counts(t.as_py(), terms) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([list(x) for x in tf], pa.list_(pa.int32())),
                 pa.array([list(x.values()) for x in tf], pa.list_(pa.int32()))], names=["doc_id", "label", "t", "n"])

    found = [(r["doc_id"], r["label"], dict(zip(r["t"], r["n"]))) for r in
             sample.mapInArrow(vectors, "doc_id long, label int, t array<int>, n array<int>").collect()]
    index = Index(terms, idf, found, {y: rate.get(y, 0) for y in (0, 1)}, s)
    index.calibrate()
    return index


def score_documents(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), keep: list[str] = []) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), then the columns ``keep`` of ``docs`` as keep_0, keep_1, ..."""
    index = fit(docs, labels, s)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by max_examples and max_terms

    def run(batches):
        ix, done = shared.value, {}
        for batch in batches:
            found = []
            for text in batch.column(1):
                tf = _term_counts(text.as_py(), ix.terms) if ix else {}
                key = tuple(sorted(tf.items()))
                if key not in done:
                    if len(done) > 100_000:
                        done.clear()
                    done[key] = ix.score(tf) if ix else (0.0, [])
                found.append(done[key])
            score = np.array([f[0] for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score), pa.array(score >= THRESHOLD).cast(pa.int32()),
                 pa.array([f[1] for f in found], pa.list_(pa.int64())), *(batch.column(i) for i in range(3, batch.num_columns))],
                schema=pa.schema([batch.schema.field(0), batch.schema.field(2), ("score", pa.float64()), ("predicted", pa.int32()),
                                  ("evidence", pa.list_(pa.int64())), *(batch.schema.field(i) for i in range(3, batch.num_columns))]))

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      held_out(F.col("doc_id")).alias("held_out"), *(F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)))
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in src.schema.fields[3:])
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>" + kept)
