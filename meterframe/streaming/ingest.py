"""Continuous ingest of landed payload documents (ST-3, ST-5..ST-7, SNK-9).

``readStream`` over the landing folders → ``foreachBatch``: strict document
check, explode, one tagged pass into the outbox, then every sink on its own
(``streaming.loads``): kept rejects, the keyed merge into ``energies``, the wide
points of both sides, and the roll-ups of the days the batch touched.  A
re-fetched reading overwrites by key, unless its document's file is older than
the one stored, so late or corrected data is never dropped and no watermark is
used.  A replayed micro-batch replaces its own load and merges by key, so it
gives the same tables; what a sink missed is tried again by the next run.
Progress is kept in the query's checkpoint location.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.config import MEASURE_CONSUMPTION, MEASURE_PRODUCTION, Settings
from meterframe.sinks.energies_table import EnergiesTable
from meterframe.sinks.files import Files
from meterframe.sinks.price_points import PricePointStore
from meterframe.sinks.rollup_store import RollupStore
from meterframe.sinks.wide_table import WideTable
from meterframe.sources import payloads as P
from meterframe.streaming.loads import Loads, Report


def payload_stream(spark: SparkSession, landing_root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Documents of both sides as one stream; a side may have landed nothing yet."""
    files, sides = Files(spark, landing_root), []
    for mt in (MEASURE_CONSUMPTION, MEASURE_PRODUCTION):
        files.make(P.side_path(landing_root, mt))
        r = spark.readStream
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        sides.append(P.typed_documents(r.format("text").load(P.side_path(landing_root, mt)), mt))
    return sides[0].unionByName(sides[1])


@dataclass
class IngestReport:
    batches: int = 0
    rejected_documents: int = 0
    errors: list = field(default_factory=list)
    #: Loads that some sink has yet to take.
    waiting: int = 0

    #: Readings taken, and those of them that were empty slots.
    readings: int = 0
    empty: int = 0

    def add(self, run: Report) -> None:
        self.readings, self.empty = self.readings + run.readings, self.empty + run.empty
        self.errors += run.errors
        self.waiting = run.waiting


def make_batch_handler(loads: Loads, report: IngestReport):
    def handle(batch: DataFrame, epoch_id: int) -> None:
        # Documents are read once, for the rejects and the readings, and never kept: parsed, they take many times the room
        # of their files. One folder of rejects per epoch, replaced as a whole: a replayed batch leaves one copy.
        folder, rows = f"{loads.rejects}/documents/epoch={epoch_id}", P.explode_checked(batch, loads.settings.tz)
        report.add(loads.apply(f"{epoch_id:020d}", rows, folder))
        report.rejected_documents += loads.spark.read.schema(rows.schema[P.DOCUMENT].dataType).parquet(folder).count()
        report.batches += 1
    return handle


def run_ingest(spark: SparkSession, landing_root: str, table: EnergiesTable, rollups: RollupStore,
               contracts, prices: DataFrame, checkpoint: str, rejects_path: str,
               settings: Settings = Settings(), max_files_per_trigger: int | None = None,
               wide_path: str | None = None, points: DataFrame | PricePointStore | None = None, outbox: str | None = None) -> IngestReport:
    """Process everything landed so far and stop (``availableNow``); first what earlier runs left in the outbox.

    Rejected documents go to ``<rejects_path>/documents``, rejected readings to
    ``<rejects_path>/readings``.
    """
    report = IngestReport()
    wide = WideTable(spark, wide_path) if wide_path is not None else None
    loads = Loads(spark, outbox or f"{checkpoint.rstrip('/')}-outbox", rejects_path, table, rollups, contracts, prices,
                  settings, wide, points)
    report.add(loads.run())
    q = (payload_stream(spark, landing_root, max_files_per_trigger).writeStream
         .foreachBatch(make_batch_handler(loads, report)).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return report
