"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each (key, shard) pair has a pseudo-random number u in (0, 1) from the md5 of
its text; a record goes to the shard with the largest ``-weight / ln(u)``
(ties: the smaller shard). A new shard takes rows only into itself, and a
weight moves only the rows that the shard gains or loses. The key is the
record's id alone, so equal ids meet in one shard.

Slots number the rows of a shard from 0 without gaps: rows are dealt to a fixed
number of buckets by their key's hash, a small table of the buckets' sizes gives
each bucket's first slot, and rows are numbered inside a bucket by (id, text
checksum, text hash). Equal rows are first counted and only then numbered as a
run, so a record that repeats very often is one row until its slots are written.

Defined results: a null id is the empty key; a null text has size 8 and the
checksum of the empty text; repeated rows each get a slot of their own; an
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterframe.llm.common import id_text

#: Buckets for each shard when slots are given out; the table of bucket sizes
#: has this many rows a shard at most, whatever the input.
SLOT_BUCKETS = 1024
#: Slots of one repeated record written from one row.
RUN = 1 << 16


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0, 1, ...) of a text key."""
    def weight(i: int, w: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{i}"))), 1, 13), 16, 10).cast("double")
        return F.struct((F.lit(-float(w)) / F.log((bits + 0.5) / float(1 << 52))).alias("score"), F.lit(-i).alias("neg"))
    return (-F.array_max(F.array(*(weight(i, w) for i, w in enumerate(weights))))["neg"]).cast("int")


def shard_documents(docs: DataFrame, weights: list[float], grown_weight: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    ``grown_shard`` is the row's shard once a further shard of
    ``grown_weight`` is added.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    key = id_text(F.col("doc_id"))
    distinct = (rows.groupBy("doc_id", "size", "text_crc32", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
                .withColumn("shard", rendezvous(key, weights))
                .withColumn("grown_shard", rendezvous(key, [*weights, grown_weight]))
                .withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(SLOT_BUCKETS)).cast("int")))
    sizes = distinct.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    inside = (Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "text_hash")
              .rowsBetween(Window.unboundedPreceding, -1))
    run = distinct.withColumn("ahead", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    # Proven bound: at most SLOT_BUCKETS rows a shard.
    placed = run.join(F.broadcast(first), ["shard", "bucket"])
    start = F.col("first_slot") + F.col("ahead")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("copies") - 1).cast("long"), F.lit(RUN).cast("long")))
    pieces = placed.withColumn("start", start).withColumn("piece", piece)
    last = F.least(F.col("piece") + (RUN - 1), F.col("copies") - 1)
    return pieces.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("start") + F.col("piece"), F.col("start") + last)).alias("slot"),
        "grown_shard").select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"),
                              "grown_shard")
