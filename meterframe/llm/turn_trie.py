"""Prefix trie of conversations from padded matrices of turn ids.

A turn's id is 128 bits of hash of its role and text; a conversation is the
sequence of its ids. Conversations are dealt to range shards in the order of
their sequences (ties: conv_id, so a sequence that repeats very often is spread
as well), and each shard gets its neighbours' nearest conversation as a ghost.
In a shard the ids become small numbers in a matrix padded with 0; rows are put
in order by ``numpy.lexsort``, a block of columns at a time, so that one long
conversation does not widen the matrix of all. Change masks between
neighbouring rows, OR-accumulated along the columns, tell how many turns a row
shares with the row before it, and so where the nodes of each depth start;
``reduceat`` over these starts gives every depth's aggregates.

Every aggregate is a sum (or minimum) over rows, given what a row shares with
its neighbours: a child starts at the row that shares exactly the node's depth,
a leaf ends at a row whose successor does not go on from it, and a row that is
not the first of a node saves the words it shares. A node that crosses a shard's
border, known from the ghosts, comes out in parts that are added up by the hash
of its prefix; ids of conversations that end there are hashed as a stream.

A conversation's ids and word counts (20 bytes a turn, no texts) stand in one
row; a shard holds about ``SHARD_TURNS`` turns.

Defined results: conversations are ordered by turn (nulls first), rows of one
turn by the hash of role and text; null roles and texts are empty; rows without
a conv_id belong to no conversation; an empty table gives no nodes. Only
conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.common import discard, stage

#: Turns that a shard holds on average at most.
SHARD_TURNS = 1 << 18
#: Columns of a matrix.
WIDTH = 16
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(text, role, F.lit(1)).alias("b"),
            F.regexp_count(text, F.lit(WORD)).alias("n")).alias("t"))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of the conversations as they are."""
    return _turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % ``group``, then c's own after its first h.

    h = crc32 of c's decimal digits % ``most``. One shuffle: rows are dealt by
    the group's first id, which also deals them by conversation.
    """
    head = (F.col("conv_id") - F.col("conv_id") % group).alias("head")
    own = (_turns(conversations).select("*", head).repartition("head").groupBy("head", "conv_id")
           .agg(F.sort_array(F.collect_list("t")).alias("own")))
    first = F.max(F.when(F.col("conv_id") == F.col("head"), F.slice("own", 1, most - 1))).over(Window.partitionBy("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    parts = own.withColumn("first", F.coalesce(first, F.slice("own", 1, 0))).withColumn("h", h)
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    return parts.select("conv_id", F.concat(F.slice("first", F.lit(1), F.col("h")), rest).alias("turns"))


class Rows:
    """Sequences as flat arrays; ``ids`` are dense numbers from 1 in the order of the hashes."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        turns = table["turns"].combine_chunks() if isinstance(table["turns"], pa.ChunkedArray) else table["turns"]
        flat = turns.flatten()
        self.place = table["place"].to_numpy()
        self.conv = table["conv_id"].to_numpy()
        self.len = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.a, self.b = (flat.field(c).to_numpy(zero_copy_only=False) for c in "ab")
        self.off = np.concatenate([[0], np.cumsum(self.len)])
        self.words = np.concatenate([[0], np.cumsum(flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64))])
        by = np.lexsort((self.b, self.a))
        new = np.ones(len(by), bool)
        new[1:] = (self.a[by][1:] != self.a[by][:-1]) | (self.b[by][1:] != self.b[by][:-1])
        self.ids = np.zeros(len(by), np.int64)
        self.ids[by] = np.cumsum(new)

    def matrix(self, rows: np.ndarray, start: int) -> np.ndarray:
        """Columns ``start`` .. of the rows' ids, padded with 0."""
        at = start + np.arange(WIDTH)
        inside = at[None, :] < self.len[rows][:, None]
        out = np.zeros(inside.shape, np.int64)
        out[inside] = self.ids[(self.off[rows][:, None] + at[None, :])[inside]]
        return out

    def order(self) -> np.ndarray:
        """Rows in the order of (sequence, conv_id): each block of columns parts the groups of rows equal so far."""
        rank = np.zeros(len(self.len), np.int64)  # place of the first row of a row's group
        live = np.arange(len(self.len))
        for start in range(0, int(self.len.max(initial=0)), WIDTH):
            live = live[self.len[live] >= start]
            m = self.matrix(live, start)
            by = np.lexsort((*(m[:, c] for c in range(WIDTH - 1, -1, -1)), rank[live]))
            live, m = live[by], m[by]
            old = np.ones(len(live), bool)
            old[1:] = rank[live][1:] != rank[live][:-1]
            new = old.copy()
            new[1:] |= (m[1:] != m[:-1]).any(axis=1)
            at = np.arange(len(live))
            first_old = np.maximum.accumulate(np.where(old, at, 0))
            first_new = np.maximum.accumulate(np.where(new, at, 0))
            rank[live] += first_new - first_old
        return np.lexsort((self.conv, rank))

    def shared(self, order: np.ndarray) -> np.ndarray:
        """Turns that each row shares with the row before it in ``order`` (-1 for the first)."""
        out = np.zeros(len(order), np.int64)
        out[:1] = -1
        live = np.arange(1, len(order))
        for start in range(0, int(self.len.max(initial=0)), WIDTH):
            m, before = self.matrix(order[live], start), self.matrix(order[live - 1], start)
            changed = np.logical_or.accumulate((m != before) | (m == 0), axis=1)
            out[live] += (~changed).sum(axis=1)
            live = live[~changed[:, -1]]
            if not len(live):
                break
        return out

    def prefixes(self, row: int, depth: int) -> list[bytes]:
        """Hashes of the row's prefixes of 0 .. ``depth`` turns."""
        digest, out = hashlib.md5(usedforsecurity=False), []
        for d in range(depth + 1):
            if d:
                i = self.off[row] + d - 1
                digest.update(self.a[i].tobytes() + self.b[i].tobytes())
            out.append(digest.copy().digest())
        return out


PART = pa.schema([("shard", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
                  ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                  ("ends_sha256", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("ends", pa.string())])
_PART = ("shard int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, key binary, parent_key binary, ends string")


def shard_nodes(shard: int, table: pa.Table) -> pa.Table:
    """Nodes of a shard; those that cross its borders as parts with ``key`` (the prefix's hash) and ``ends``."""
    rows = Rows(table)
    order = rows.order()
    shares = rows.shared(order)
    real = np.flatnonzero(rows.place[order] == 0)
    lo, hi = real[0], real[-1]
    follows = np.concatenate([shares[1:], [-1]])[lo:hi + 1]  # what the next row shares
    shares, order = shares[lo:hi + 1], order[lo:hi + 1]
    length, conv, off = rows.len[order], rows.conv[order], rows.off[order]
    n = len(order)
    back, on = int(shares[0]), int(follows[-1])  # turns shared across the two borders
    back_keys = rows.prefixes(order[0], back) if back >= 0 else []
    on_keys = rows.prefixes(order[-1], on) if on >= 0 else []
    leaf = follows < length
    shared_words = rows.words[off + np.maximum(shares, 0)] - rows.words[off]
    names = conv.astype(str).astype(object)
    parts, live = [], np.arange(n)
    above = None
    for depth in range(int(length.max(initial=0)) + 1):
        live = live[length[live] >= depth]
        if not len(live):
            break
        starts = shares[live] < depth
        starts[0] = True
        at = np.flatnonzero(starts)
        size = np.diff(np.append(at, len(live)))
        ending = np.add.reduceat((length[live] == depth).astype(np.int64), at)
        skipped = rows.words[off[live] + max(depth - 1, 0)] - rows.words[off[live]]
        saved = np.where(shares[live] >= depth, shared_words[live] - skipped, 0)
        keys: list = [None] * len(at)
        if live[0] == 0 and depth <= back:
            keys[0] = back_keys[depth]
        if live[-1] == n - 1 and depth <= on:
            keys[-1] = on_keys[depth]
        least = np.minimum.reduceat(conv[live], at)
        shas, texts = [NO_ENDS] * len(at), [None] * len(at)
        for i in np.flatnonzero(ending):
            mine = live[at[i]:at[i] + ending[i]]
            text = ",".join(names[mine])
            if keys[i] is None:
                shas[i] = hashlib.sha256(text.encode()).hexdigest()
            else:
                texts[i] = text
        if above is None:
            parents, parent_keys = [None] * len(at), [None] * len(at)
        else:
            up = np.searchsorted(above[0], live[at], side="right") - 1
            parent_keys = [above[2][i] for i in up]
            parents = [None if k is not None else c for k, c in zip(parent_keys, above[1][up].tolist())]
        parts.append(pa.table([
            pa.array(np.full(len(at), shard, np.int32)), pa.array(least), pa.array(np.full(len(at), depth, np.int64)),
            pa.array(parents, pa.int64()), pa.array(size.astype(np.int64)),
            pa.array(np.add.reduceat(((length[live] > depth) & (shares[live] <= depth)).astype(np.int64), at)),
            pa.array(np.add.reduceat(leaf[live].astype(np.int64), at)), pa.array(np.add.reduceat(saved, at)),
            pa.array(shas, pa.string()), pa.array(keys, pa.binary()), pa.array(parent_keys, pa.binary()),
            pa.array(texts, pa.string())], schema=PART))
        above = live[at], least, keys
    return pa.concat_tables(parts)


def _joined(batches):
    """Parts of nodes that cross borders, sorted by (depth, key, shard), added up one node after the other."""
    node = digest = None
    done: list = []

    def close():
        done.append({**node, "ends_sha256": digest.hexdigest(), "ends": None})

    for batch in batches:
        for part in batch.to_pylist():
            if node is None or (part["depth"], part["key"]) != (node["depth"], node["key"]):
                if node is not None:
                    close()
                node, digest = part, hashlib.sha256()
                started = False
            else:
                node["conv_id"] = min(node["conv_id"], part["conv_id"])
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    node[c] += part[c]
            if part["ends"] is not None:
                digest.update(("," if started else "").encode() + part["ends"].encode())
                started = True
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=PART)
            done = []
    if node is not None:
        close()
        yield pa.RecordBatch.from_pylist(done, schema=PART)


def trie(turns: DataFrame, shards: int) -> DataFrame:
    """The nodes of all prefixes of ``turns`` (conv_id, turns), one row a node."""
    spark = turns.sparkSession
    ids = F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b")))
    keyed = turns.withColumn("ids", ids).repartitionByRange(shards, "ids", "conv_id")
    dealt, dealt_at = stage(keyed.select(F.spark_partition_id().alias("shard"), "conv_id",
                                         F.transform("turns", lambda t: t.dropFields("turn")).alias("turns")), "trie-shards")
    rank = F.struct(F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"))).alias("ids"), F.col("conv_id"))
    row = F.struct(rank.alias("rank"), "turns")
    ends = dealt.groupBy("shard").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    line = Window.orderBy("shard")  # one row a shard
    near = ends.select("shard", F.lag("hi").over(line).alias("before"), F.lead("lo").over(line).alias("after"))
    ghosts = [near.where(F.col(c).isNotNull()).select("shard", F.col(f"{c}.rank.conv_id").alias("conv_id"),
                                                      F.col(f"{c}.turns").alias("turns"), F.lit(p).alias("place"))
              for c, p in (("before", -1), ("after", 1))]
    with_ghosts = dealt.withColumn("place", F.lit(0)).unionByName(ghosts[0]).unionByName(ghosts[1])

    def nodes_of(key, table):
        return shard_nodes(key[0].as_py(), table)

    nodes, _ = stage(with_ghosts.groupBy("shard").applyInArrow(nodes_of, _PART), "trie-nodes")
    discard(spark, dealt_at)
    crossing = nodes.where(F.col("key").isNotNull()).repartition("depth", "key").sortWithinPartitions("depth", "key", "shard")
    joined, _ = stage(crossing.mapInArrow(_joined, _PART), "trie-crossing")
    whole = nodes.where(F.col("key").isNull()).unionByName(joined)
    # Only prefixes that cross borders; adaptive execution picks the join by size.
    parents = joined.select(F.col("key").alias("parent_key"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    known = whole.where(F.col("parent_key").isNull())
    found = (whole.where(F.col("parent_key").isNotNull()).join(parents, ["parent_key", "depth"], "left")
             .withColumn("parent_conv_id", F.col("above")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return known.select(*columns).unionByName(found.select(*columns))


def shards_for(conversations: DataFrame) -> int:
    """Shards of about ``SHARD_TURNS`` turns, and as many as the session's shuffles have at least."""
    turns = conversations.count()
    return max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))


def prefix_trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """Trie of the rebuilt conversations, or (``rebuild=False``) of the conversations as they are."""
    turns = rebuilt(conversations) if rebuild else sequences(conversations)
    return trie(turns, shards_for(conversations))
