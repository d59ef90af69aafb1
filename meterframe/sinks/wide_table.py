"""Denormalised priced points, partitioned by kind and UTC day (SNK-7, SNK-8).

A point is identified by its time and tags; writing it again replaces it, as
in a time-series store.  ``upsert`` reads only the (kind, day) partitions a
batch touches, keeps the stored points the batch does not replace (full outer
join on time and tags) and publishes just those partitions, all or nothing.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe.config import MEASURE_CONSUMPTION, MEASURE_PRODUCTION
from meterframe.schemas import LOAD_VERSION, WIDE
from meterframe.sinks.publish import Publisher

KINDS = {MEASURE_CONSUMPTION: "consumptions", MEASURE_PRODUCTION: "productions"}
TAG_KEY = ["time", "meteringpointcode_tag", "measurementtype_tag", "resolution_duration_tag"]
_COLUMNS = [f.name for f in WIDE.fields]
_VERSION = [f.name for f in LOAD_VERSION.fields]
_SCHEMA = T.StructType([*WIDE.fields, *LOAD_VERSION.fields, T.StructField("kind", T.StringType()),
                        T.StructField("day", T.DateType())])


def rules() -> dict[str, Column]:
    """A point has a time, a meter and a value."""
    return {f"null_{c}": F.col(c).isNull() for c in ("time", "meteringpointcode_tag", "measurementtype_tag", "value")}


class WideTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def publisher(self) -> Publisher:
        return Publisher(self.spark, self.path, ["kind", "day"])

    def read(self, kind: str | None = None) -> DataFrame:
        try:
            df = self.spark.read.schema(_SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            df = self.spark.createDataFrame([], _SCHEMA)
        if kind is not None:
            df = df.where(F.col("kind") == kind)
        return df

    def upsert(self, points: DataFrame, kind: str) -> None:
        """Write points; one of an older load than the stored one (both versions known) changes nothing (ST-7)."""
        self.publisher.recover()  # before the table is read
        missing = {f.name: F.lit(None).cast(f.dataType) for f in LOAD_VERSION.fields if f.name not in points.columns}
        new = (points.withColumns(missing).select(*_COLUMNS, *_VERSION, F.to_date("time").alias("day"))
               .persist(StorageLevel.MEMORY_AND_DISK))
        try:
            days = [r[0] for r in new.select("day").distinct().collect()]  # bounded by the batch span
            if not days:
                return
            old = self.read(kind).where(F.col("day").isin([d for d in days if d is not None])).select(*new.columns)
            o, n = (df.select(*(F.col(k).alias(f"{p}_{k}") for k in TAG_KEY), F.struct(*df.columns).alias(p))
                    for df, p in ((old, "o"), (new, "n")))
            # Tags may be NULL (hourly resolution tag): compare null-safely.
            both = o.join(n, [o[f"o_{k}"].eqNullSafe(n[f"n_{k}"]) for k in TAG_KEY], "full_outer")
            version = [F.struct(F.col(f"{p}.load_time"), F.coalesce(F.col(f"{p}.load_file"), F.lit(""))) for p in "on"]
            older = F.col("n.load_time").isNotNull() & F.col("o.load_time").isNotNull() & (version[1] < version[0])
            keep_old = F.col("n").isNull() | F.coalesce(older, F.lit(False))
            merged = both.select(F.when(keep_old, F.col("o")).otherwise(F.col("n")).alias("p")).select("p.*", F.lit(kind).alias("kind"))
            self.publisher.replace(merged, ["meteringpointcode_tag", "time"], rules())
        finally:
            new.unpersist()
