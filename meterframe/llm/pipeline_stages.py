"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``docs``. Rows are told apart by id and
text; rows that agree in both stand or fall together, except that near-duplicate
removal keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from meterframe.llm.common import KEY, row_key, small, stage, table

#: Words in a shingle and least similarity (as a fraction) of near duplicates.
SHINGLE, SIMILARITY = 5, (80, 100)
WINDOW = 10
SHARDS = 24
LEVELS = ("domain", "lang", "source")
#: Target weights of domains and of languages inside them; other nodes weigh 1.
WEIGHTS = {("domain0",): 4, ("domain1",): 3, ("domain2",): 2, ("domain3",): 1,
           **{(f"domain{d}", lang): w for d in range(4) for lang, w in (("en", 5), ("de", 2), ("fr", 2), ("es", 1))}}


def domain() -> Column:
    """The domain of a source: its number modulo 4, or other."""
    n = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    return F.coalesce(F.concat(F.lit("domain"), F.pmod(n, F.lit(4)).cast("string")), F.lit("other"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, list]:
    """Rows under own names next to their key, and the columns that give them back."""
    rows = docs.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)), *row_key())
    return rows, [F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), keep=docs.columns)
    return scored.where(F.col("predicted") == 0).select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, or without any the smallest text hash."""
    found, _ = stage(jaccard_join.link_components(docs, SHINGLE, *SIMILARITY), "near-duplicates")
    found = found.withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0).cast("long")),
                               "text_hash": F.col("tag")})
    # Of each component the smallest key stays: rows with an id before those without.
    kept = found.where("component is not null").groupBy("component").agg(F.min(F.struct(*KEY)).alias("kept"))
    gone = found.join(kept, "component").where(F.struct(*KEY) != F.col("kept")).select(*KEY).distinct()
    many = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY).join(gone, KEY, "left_anti")
    gone, _ = stage(gone, "near-duplicates-gone")
    many, _ = stage(many, "near-duplicates-repeated")
    rows, own = _keyed(docs)
    alone = rows.join(small(gone.unionByName(many)), KEY, "left_anti")
    one = rows.join(small(many), KEY, "left_semi").dropDuplicates(KEY)
    return alone.unionByName(one).select(*own)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), WINDOW)
    hit = found.where("contaminated").select(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), "text_hash")
    hit, _ = stage(hit.distinct(), "contaminated")
    rows, own = _keyed(docs)
    return rows.join(small(hit), KEY, "left_anti").select(*own)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill four fifths of the tokens by the target weights, each once."""
    mix = mixing.Mix(LEVELS, WEIGHTS, share=0.8, max_epochs=1)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(docs.columns)),
                       "doc_id", "text", "lang", "source", domain().alias("domain"))
    return mixing.choose(rows, mix).select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return sharding.shard_documents(docs, [1.0] * SHARDS)
