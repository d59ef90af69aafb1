"""Loads and their outbox: every sink on its own, nothing lost (SNK-9, ST-3, ST-4, O-9..O-11).

A load is the readings of one stream epoch or one backfill.  ``apply`` first
writes them, each with the reason it is rejected for or none, to the outbox
(``<outbox>/<name>/readings``; slots without a quantity are only counted, as the
reference skips them silently); this one tagged pass over the documents feeds the
facts, the wide points of both sides and the kept rejects.  Then each sink takes
the load; a sink that fails is reported and does not stop the others or the
roll-up refresh, and the load stays in the outbox until every sink has it.

A sink takes loads in order: behind one that failed, later ones wait.  ``run``
tries again; jobs call it at their start.  Every step may be repeated (keyed
merges, replaced folders), so a process may end anywhere.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe.config import Settings
from meterframe.operators.pricing import build_energies, wide_points
from meterframe.operators.quality import tagged
from meterframe.operators.readings import REASON_NO_QUANTITY, REASON_NO_TARIFF, reject_reason
from meterframe.sources.payloads import DOCUMENT, labelled
from meterframe.sinks.energies_table import EnergiesTable, day_of
from meterframe.sinks.files import Files
from meterframe.sinks.price_points import PricePointStore
from meterframe.sinks.rollup_store import RollupStore
from meterframe.sinks.wide_table import KINDS, WideTable

READY = "ready"


@dataclass
class Report:
    """What a run did: sinks that failed, by load, and how many loads still wait."""
    errors: list = field(default_factory=list)
    waiting: int = 0
    days: set = field(default_factory=set)
    #: Readings of the load just put in, and those of them that were empty slots.
    readings: int = 0
    empty: int = 0


class Loads:
    """The sinks of one set of tables.

    ``points`` (a store, read anew by each load, or a DataFrame) price the wide points; without them ``prices`` do.
    """

    def __init__(self, spark: SparkSession, outbox: str, rejects: str, table: EnergiesTable, rollups: RollupStore,
                 contracts, prices: DataFrame, settings: Settings = Settings(), wide: WideTable | None = None,
                 points: DataFrame | PricePointStore | None = None):
        self.spark, self.outbox, self.rejects = spark, outbox.rstrip("/"), rejects.rstrip("/")
        self.table, self.rollups, self.wide = table, rollups, wide
        self.contracts, self.prices, self.points, self.settings = contracts, prices, points, settings

    @property
    def sinks(self) -> list[str]:
        return ["rejects", "facts", *(KINDS.values() if self.wide is not None else ()), "rollups"]

    @property
    def files(self) -> Files:
        return Files(self.spark, self.outbox)

    def apply(self, name: str, readings: DataFrame, documents: str | None = None) -> Report:
        """Put a load into the outbox and run; a load of the same name is replaced.

        Rejected documents among the readings (``payloads.explode_checked``) go to the folder ``documents``, replaced as a
        whole: one pass over the documents writes both down, and the rest is done from there.
        """
        self.files.delete(f"{self.outbox}/{name}")
        # Empty slots are most of a document that is fetched early: they are counted and dropped before the contracts
        # are joined, not kept. (A lost executor's repeated tasks may count them twice.)
        reading, counts = F.col(DOCUMENT).isNull() if documents is not None else F.lit(True), Observation()
        empty = reading & reject_reason(readings).eqNullSafe(REASON_NO_QUANTITY)
        seen_slots = readings.withColumn("_empty", empty).observe(
            counts, F.count_if("_empty").alias("empty"), F.count_if(reading).alias("all"))
        kept = seen_slots.where(~F.col("_empty")).drop("_empty")
        if documents is not None:
            parsed, kept = f"{self.outbox}/{name}/parsed", labelled(kept, self.settings.tz)
            self._write(kept, parsed)
            kept = self.spark.read.schema(kept.schema).parquet(parsed)
            self._write(kept.where(~reading).select(f"{DOCUMENT}.*"), documents)
            kept = kept.where(reading).drop(DOCUMENT)
        rows = tagged(kept, self.contracts, self.settings)
        self._write(rows, f"{self.outbox}/{name}/readings")
        seen = counts.get
        self.files.write(f"{self.outbox}/{name}/{READY}", json.dumps({"schema": rows.schema.jsonValue(), "readings": seen}))
        report = self.run()
        report.readings, report.empty = seen.get("all", 0), seen.get("empty", 0)
        return report

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)

    def waiting(self) -> list[str]:
        """Loads that some sink has yet to take, in order; those that were not written to the end are dropped."""
        names = []
        for n in self.files.names(self.outbox):
            if self.files.exists(f"{self.outbox}/{n}/{READY}"):
                names.append(n)
            else:
                self.files.delete(f"{self.outbox}/{n}")
        return names

    def run(self) -> Report:
        """Let each sink take the loads it has not taken yet."""
        report, names = Report(), self.waiting()
        if not names:
            return report
        self.table.recover()
        for sink in self.sinks:
            if sink == "rollups":
                continue
            for name in names:
                if self._taken(name, sink):
                    continue
                try:
                    getattr(self, f"_{sink}")(self._staged(name), name)
                    self._take(name, sink)
                except Exception as e:  # noqa: BLE001 - reported; the other sinks go on
                    report.errors.append((name, sink, f"{type(e).__name__}: {e}"))
                    break  # later loads wait: a sink takes them in order
        self._refresh(names, report)
        for name in names:
            if all(self._taken(name, s) for s in self.sinks):
                self.files.delete(f"{self.outbox}/{name}")
            else:
                report.waiting += 1
        return report

    def _refresh(self, names: list[str], report: Report) -> None:
        """Roll-ups of the days that the loads touch, whatever became of the sinks; done once the facts are in."""
        todo = [n for n in names if not self._taken(n, "rollups")]
        try:
            days = set()
            for name in todo:
                local = day_of(F.col("time"), self.settings.tz).alias("day")
                accepted = self._staged(name).where(F.col("reason").isNull())
                days |= {r[0] for r in accepted.select(local).distinct().collect()}  # bounded by the loads' spans
            self.rollups.refresh_days(self.table.read(with_partition=True), sorted(days))
            report.days = days
            for name in todo:
                if self._taken(name, "facts"):
                    self._take(name, "rollups")
        except Exception as e:  # noqa: BLE001
            report.errors.append((todo[0], "rollups", f"{type(e).__name__}: {e}"))

    def _staged(self, name: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self.files.read(f"{self.outbox}/{name}/{READY}"))["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.outbox}/{name}/readings")

    def _taken(self, name: str, sink: str) -> bool:
        return self.files.exists(f"{self.outbox}/{name}/taken-{sink}")

    def _take(self, name: str, sink: str) -> None:
        self.files.write(f"{self.outbox}/{name}/taken-{sink}", "")

    # -- sinks ------------------------------------------------------------------------------

    def _rejects(self, rows: DataFrame, name: str) -> None:
        """One folder a load, replaced as a whole: a replayed load leaves one copy."""
        self._write(rows.where(F.col("reason").isNotNull()), f"{self.rejects}/readings/load={name}")

    def _facts(self, rows: DataFrame, name: str) -> None:
        accepted = rows.where(F.col("reason").isNull()).drop("reason")
        self.table.merge(build_energies(accepted, self.contracts, self.prices, self.settings, versions=True))

    def _wide(self, rows: DataFrame, side: int) -> None:
        # Consumption under contract type none has no fact but a point without a fee.
        fit = rows.where(F.col("reason").isNull() | (F.col("reason") == REASON_NO_TARIFF)).drop("reason")
        prices = self.prices if self.points is None else self.points
        prices = prices.read() if isinstance(prices, PricePointStore) else prices
        self.wide.upsert(wide_points(fit, self.contracts, prices, side, settings=self.settings, versions=True), KINDS[side])

    def _consumptions(self, rows: DataFrame, name: str) -> None:
        self._wide(rows, _side("consumptions"))

    def _productions(self, rows: DataFrame, name: str) -> None:
        self._wide(rows, _side("productions"))


def _side(kind: str) -> int:
    return next(side for side, k in KINDS.items() if k == kind)


def read_rejects(spark: SparkSession, rejects: str) -> DataFrame:
    """Rejected readings of all loads, with their reason and load."""
    return spark.read.parquet(f"{rejects.rstrip('/')}/readings")
