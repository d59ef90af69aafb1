"""Landing of payload documents by the local days they cover (O-35).

``measure_type=…/first_day=…/last_day=…`` folders hold documents as text, one a
line, as received (compressed: the slots of a document repeat each other).  A document stands once, under the first and the last local
day of its series, so a reader of any interval opens just the folders that
overlap it, however long the documents are.  A document whose header names no
such days covers all time: it is read always, and its readings tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.config import MEASURE_CONSUMPTION, MEASURE_PRODUCTION
from meterframe.functions.timeutil import parse_local
from meterframe.sinks.files import Files
from meterframe.sources import payloads as P

FIRST, LAST = "0001-01-01", "9999-12-31"
#: A compressed file is read by one task: it holds this many documents at most.
FILE_DOCUMENTS = 5_000
OPEN_FILES = 64
#: Documents that are made where they are written grow a hundred times and more after their shuffle: so little of it
#: makes a task.
TASK_BYTES, LEAST_TASK_BYTES = "1m", "64k"
_HEADER = "getconsumptionsresult struct<consumptiondata: struct<timeseries: struct<start: string, stop: string>>>"


def cover(lines: DataFrame) -> DataFrame:
    """``lines`` with the first and last local day of each document's series (its stop is exclusive)."""
    # Rows of a generator, so that each document is parsed once.
    header = F.inline(F.array(F.from_json("value", _HEADER)))
    at = lines.select("*", header).select(
        *lines.columns, *(parse_local(F.col(f"getconsumptionsresult.consumptiondata.timeseries.{c}")).alias(f"_{c}") for c in ("start", "stop")))
    last = F.greatest(F.col("_start"), F.col("_stop") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1)))
    known = F.col("_start").isNotNull() & F.col("_stop").isNotNull()
    return at.select(*lines.columns, F.when(known, F.date_format("_start", "yyyy-MM-dd")).otherwise(FIRST).alias("first_day"),
                     F.when(known, F.date_format(last, "yyyy-MM-dd")).otherwise(LAST).alias("last_day"))


def land(lines: DataFrame, root: str, mode: str = "append", clustered: bool = False) -> None:
    """Land documents (``value``, ``measure_type``), one a row, as compressed text.

    ``clustered``: each task of ``lines`` holds documents of few folders already, so they are written from where they
    are; else they are shuffled first.  Documents are not sorted: a task keeps a file open for each of its folders, up to
    ``OPEN_FILES``.
    """
    spark = lines.sparkSession
    rows = cover(lines.select("value", "measure_type"))
    folders = ["measure_type", *P.COVER]
    # A day's documents go to as many files as their size asks for.
    rows = rows if clustered else rows.hint("rebalance", *folders)
    settings = {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES),
                # The job's shuffle files go with it; nothing reads them again.
                "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if clustered:
        settings |= {"spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES,
                     "spark.sql.adaptive.coalescePartitions.minPartitionSize": LEAST_TASK_BYTES}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        (rows.write.mode(mode).option("partitionOverwriteMode", "static").option("compression", "gzip")
         .option("maxRecordsPerFile", FILE_DOCUMENTS).partitionBy(*folders).text(root))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def as_lines(docs: DataFrame) -> DataFrame:
    """Documents (``measure_type``, ``getconsumptionsresult``) as text; those made as text (``value``) already are."""
    if "value" in docs.columns:
        return docs.select("value", "measure_type")
    return docs.select(F.to_json(F.struct("getconsumptionsresult")).alias("value"), "measure_type")


def read_landed(spark: SparkSession, root: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Typed documents of both sides; of the given closed range of local days, only folders that overlap it are opened.

    A flat landing (no day folders) is read whole; a side that has landed nothing has no documents.
    """
    files, sides = Files(spark, root), []
    for side in (MEASURE_CONSUMPTION, MEASURE_PRODUCTION):
        files.make(P.side_path(root, side))
        lines = spark.read.text(P.side_path(root, side))
        if set(P.COVER) <= set(lines.columns):
            if last_day is not None:
                lines = lines.where(F.col("first_day").cast("string") <= last_day)
            if first_day is not None:
                lines = lines.where(F.col("last_day").cast("string") >= first_day)
        sides.append(P.typed_documents(lines, side))
    return sides[0].unionByName(sides[1], allowMissingColumns=True)
