"""Stored day-ahead price points, keyed by time and tags (SRC-7, J-5).

A point written again replaces the stored one, as in a time-series store.  Jobs
hold the store, not a snapshot of it: every load looks prices up in what is
stored when it runs, so points that arrive between two stream epochs count.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe.schemas import PRICE_POINTS
from meterframe.sinks.files import Files
from meterframe.sinks.publish import Publisher

KEY = ["time", "type_tag", "in_domain_tag", "out_domain_tag", "timestamp"]
_COLUMNS = [f.name for f in PRICE_POINTS.fields]
_DAY = "day"
_SCHEMA = T.StructType([*PRICE_POINTS.fields, T.StructField(_DAY, T.DateType())])


def rules() -> dict[str, Column]:
    return {f"null_{c}": F.col(c).isNull() for c in ("time", "type_tag", "price")}


class PricePointStore:
    """Points below ``path``, one folder a UTC day."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def publisher(self) -> Publisher:
        return Publisher(self.spark, self.path, [_DAY])

    def read(self) -> DataFrame:
        """All points as they are stored now."""
        Files(self.spark, self.path).make(self.path)
        return self.spark.read.schema(_SCHEMA).parquet(self.path).select(*_COLUMNS)

    def upsert(self, points: DataFrame) -> None:
        """Write points, one of each key; only the days they touch are read and rewritten."""
        self.publisher.recover()
        Files(self.spark, self.path).make(self.path)
        # Of equal keys in one batch any may come last; the largest price makes it definite.
        rest = F.struct(F.col("price"), *(F.col(c) for c in _COLUMNS if c not in KEY and c != "price"))
        last = points.groupBy(*KEY).agg(F.max(rest).alias("r"))
        new = (last.select(*(F.col(c) if c in KEY else F.col(f"r.{c}").alias(c) for c in _COLUMNS), F.to_date("time").alias(_DAY))
               .persist(StorageLevel.MEMORY_AND_DISK))
        try:
            days = [r[0] for r in new.select(_DAY).distinct().collect()]  # bounded by the batch span
            if not days:
                return
            old = self.spark.read.schema(_SCHEMA).parquet(self.path).where(F.col(_DAY).isin([d for d in days if d is not None]))
            kept = old.join(new.select(*KEY), [old[k].eqNullSafe(new[k]) for k in KEY], "left_anti")
            self.publisher.replace(kept.unionByName(new), ["time", "type_tag"], rules())
        finally:
            new.unpersist()
