"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``Tree.sample_rows`` rows, the first by
the hash of their id); every row is then sent down the tree to its leaf. A query
walks the tree best bin first: a priority queue holds the unopened children by
their largest possible inner product with the query (centre times query plus
the radius of the sample below it times the query's length), and leaves are
visited in that order. How many leaves a query visits is calibrated: on sample
queries the number grows until the share of true neighbours found reaches
``target_recall``.

Rows and queries meet by leaf in blocks: a leaf's rows are cut into blocks of at
most ``block_rows`` and its queries likewise, so a vector that fills a third of
the table is spread over tasks. Each (query, block) keeps its k best; one
aggregation keeps the k best of each query. Scores are sums in double precision
over the components in order, the same for equal vectors wherever they lie.

Defined results: vectors that are null, of length zero, of another width than
most of the sample's, or that hold null or non-finite components take no part; a null id takes no
part; rows with the same id are candidates one by one, and a row is no candidate
of a query with its id; ties go to the smaller id; fewer than k candidates give
fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.common import stage


@dataclass(frozen=True)
class Tree:
    sample_rows: int = 16_384
    branch: int = 8
    leaf_rows: int = 128       # of the sample
    target_recall: float = 0.985
    calibration_queries: int = 256
    block_rows: int = 4096
    seed: int = 7


class KMeansTree:
    """Nodes in arrays: centre, radius, children (none: a leaf with a number)."""

    def __init__(self, x: np.ndarray, p: Tree):
        self.centres, self.radii, self.children, self.leaf = [], [], [], []
        self.n_leaves = 0
        self.rng = np.random.default_rng(p.seed)
        self._grow(x, p)

    def _grow(self, x: np.ndarray, p: Tree) -> int:
        node = len(self.centres)
        centre = x.mean(axis=0)
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())))
        self.children.append([]), self.leaf.append(-1)
        parts = self._split(x, p.branch) if len(x) > p.leaf_rows else []
        if len(parts) < 2:
            self.leaf[node] = self.n_leaves
            self.n_leaves += 1
        else:
            self.children[node] = [self._grow(part, p) for part in parts]
        return node

    def _split(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        centres = x[self.rng.choice(len(x), size=min(k, len(x)), replace=False)]
        for _ in range(12):
            own = _nearest(x, centres)
            centres = np.stack([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        own = _nearest(x, centres)
        return [x[own == c] for c in range(len(centres)) if (own == c).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            own = _nearest(x[rows], np.stack([self.centres[c] for c in kids]))
            todo += [(kid, rows[own == i]) for i, kid in enumerate(kids) if (own == i).any()]
        return out

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first leaves in best-bin-first order."""
        length = float(np.sqrt(q @ q))
        queue, found = [(0.0, 0)], []
        while queue and len(found) < leaves:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                found.append(self.leaf[node])
            for kid in self.children[node]:
                heapq.heappush(queue, (-(float(self.centres[kid] @ q) + length * self.radii[kid]), kid))
        return found


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products, added component by component."""
    out = np.zeros((len(q), len(x)))
    for d in range(q.shape[1]):
        out += q[:, d, None] * x[None, :, d]
    return out


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score and then the smaller id."""
    if len(ids) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= bar)
    else:
        rows = np.arange(len(ids))
    return rows[np.lexsort((ids[rows], -scores[rows]))[:k]]


def calibrate(tree: KMeansTree, x: np.ndarray, k: int, p: Tree) -> int:
    """Leaves to visit for ``target_recall`` of the true neighbours in the sample."""
    own = tree.assign(x)
    queries = x[np.linspace(0, len(x) - 1, min(p.calibration_queries, len(x))).astype(int)]
    ranks = []
    for q in queries:
        order = tree.visit(q, tree.n_leaves)
        place = np.empty(tree.n_leaves, dtype=np.int64)
        place[order] = np.arange(len(order))
        ranks.append(place[own[np.argsort(-(x @ q), kind="stable")[:k + 1]]])
    ranks = np.sort(np.concatenate(ranks))
    need = ranks[min(len(ranks) - 1, int(np.ceil(p.target_recall * len(ranks))) - 1)]
    return int(need) + 1


def fit(vectors: DataFrame, k: int, p: Tree) -> tuple[KMeansTree, int, int] | None:
    """Tree, leaves to visit and vector width from a bounded sample; None without vectors."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample_rows).select("vec").toPandas()["vec"]
    if not len(rows):
        return None
    width = Counter(map(len, rows)).most_common(1)[0][0]
    x = np.stack([np.asarray(v, dtype=np.float64) for v in rows if len(v) == width])
    tree = KMeansTree(x, p)
    return tree, calibrate(tree, x, k, p), width


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
            .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite
                   & F.exists("vec", lambda v: v != 0)))


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 20, p: Tree = Tree()) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and rows given as (vec_id, vec) by ``usable``."""
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    fitted = fit(rows, k, p)
    if fitted is None:
        return spark.createDataFrame([], schema)
    tree, visits, width = fitted

    def to_leaf(batches):
        for pdf in batches:
            if len(pdf):
                pdf["leaf"] = tree.assign(np.stack(pdf["vec"].to_numpy()))
            else:
                pdf["leaf"] = pd.Series([], dtype="int32")
            yield pdf[["vec_id", "vec", "leaf"]]

    def to_leaves(batches):
        for pdf in batches:
            found = [tree.visit(v, visits) for v in pdf["vec"]]
            n = [len(f) for f in found]
            yield pd.DataFrame({"query_id": np.repeat(pdf["vec_id"].to_numpy(), n),
                                "qvec": pd.Series([v for v, m in zip(pdf["vec"], n) for _ in range(m)], dtype=object),
                                "leaf": np.array([x for f in found for x in f], dtype="int32")})

    rows = rows.where(F.size("vec") == width)
    queries = queries.where(F.size("vec") == width)
    index, _ = stage(rows.mapInPandas(to_leaf, "vec_id long, vec array<double>, leaf int"), "ann-index")
    # Blocks of a leaf: as many as its rows need, by the hash of the row. The
    # table of leaves is bounded by the sample.
    sizes = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / p.block_rows).cast("int").alias("blocks"))
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("blocks")).cast("int")
    members = index.join(F.broadcast(sizes), "leaf").withColumn("block", spread).drop("blocks")
    asked = (queries.mapInPandas(to_leaves, "query_id long, qvec array<double>, leaf int")
             .join(F.broadcast(sizes), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    asked_sizes = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.first("blocks") / p.block_rows).cast("int").alias("parts"))
    asked = (asked.join(F.broadcast(asked_sizes), "leaf")
             .withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("blocks", "parts"))
    members = members.join(F.broadcast(asked_sizes), "leaf").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(m):
            ids, x = m["vec_id"].to_numpy(), np.stack(m["vec"].to_numpy())
            for at in range(0, len(q), 256):
                some = q.iloc[at:at + 256]
                scores = inner(np.stack(some["qvec"].to_numpy()), x)
                for qid, s in zip(some["query_id"], scores):
                    other = ids != qid
                    best = top(s[other], ids[other], k)
                    out.append((np.full(len(best), qid), ids[other][best], s[other][best]))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a, b, c = (np.concatenate(z) for z in zip(*out))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    keys = ["leaf", "block", "part"]
    found = (asked.groupBy(*keys).cogroup(members.groupBy(*keys))
             .applyInPandas(search, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
