"""Corpus pipeline: documents in, sharded training mix out.

``STAGES`` lists the stages in order. Each takes ``(spark, docs, sf_dir)``,
works on all rows its predecessor kept and returns a DataFrame that is written
as Parquet and reread as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterframe.llm import pipeline_stages as P
from meterframe.llm.common import stage, table

STAGES = [
    ("toxicity", P.drop_toxic),
    ("near_duplicates", P.drop_near_duplicates),
    ("decontamination", P.drop_contaminated),
    ("mixing", P.mix_sources),
    ("sharding", P.shard),
]

#: The stages score, group and fit; SQL cannot express them. Tests hold each
#: stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs, _ = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
