"""Materialised roll-ups and their exact states (SNK-15, ST-1, ST-2, ST-6).

Tables below ``root``:

* ``{side}_{15min,hour,day}`` — partitioned by the local day of the bucket;
* ``{side}_month`` — by local month; ``{side}_year`` — by local year;
* ``_day_state`` (by day) and ``_month_state`` (by month) — exact sums and
  counts from which coarser grains are finished.

A batch recomputes the fine grains of the days it touched from the facts of
those days only, re-sums at most 31 day states per touched month and at most
12 month states per touched year, and overwrites just the touched partitions.
Each table's periods are published all or nothing (``sinks.publish``).
Exact sums make every step equal to aggregating the facts directly, so the
result equals a full refresh (tested).
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe.config import SIDES, Settings
from meterframe.functions.timeutil import ntz_lit, utc_to_local
from meterframe.operators.rollups import (
    THREE_KEYS, coarsen, fine_states, finish_all, local_month_start, local_year_start, rollup, rollup_columns,
    whole_hour_zone,
)
from meterframe.schemas import ENERGIES
from meterframe.sinks.publish import Publisher

PERIOD = "period"
_FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
_GRAIN_PERIOD = {"15min": "day", "hour": "day", "day": "day", "month": "month", "year": "year"}


def period_of(kind: str, time_col: str, tz: str):
    return F.date_format(utc_to_local(F.col(time_col), tz), _FORMATS[kind])


class RollupStore:
    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings
        self._schemas: dict[str, T.StructType] = {}

    def path(self, side: str, grain: str) -> str:
        return f"{self.root}/{side}_{grain}"

    def read(self, side: str, grain: str, time_from=None, time_to=None) -> DataFrame:
        """A roll-up, optionally of a closed UTC range: only the range's periods are opened."""
        df = self._table(self.path(side, grain), self._schema(side)).select(*rollup_columns(side), PERIOD)
        kind, tz = _GRAIN_PERIOD[grain], self.settings.tz
        for bound, inside in ((time_from, Column.__ge__), (time_to, Column.__le__)):
            if bound is not None:
                period = F.date_format(utc_to_local(ntz_lit(bound), tz), _FORMATS[kind])
                df = df.where(inside(F.col("time"), ntz_lit(bound)) & inside(F.col(PERIOD), period))
        return df.drop(PERIOD)

    def _table(self, path: str, schema: T.StructType) -> DataFrame:
        """Given schema: empty tables can be read, and the period stays text."""
        fields = [f for f in schema.fields if f.name != PERIOD]
        return self.spark.read.schema(T.StructType([*fields, T.StructField(PERIOD, T.StringType())])).parquet(path)

    def _schema(self, side: str) -> T.StructType:
        if side not in self._schemas:
            self._schemas[side] = rollup(self.spark.createDataFrame([], ENERGIES), side, "day", self.settings).schema
        return self._schemas[side]

    def _write(self, df: DataFrame, path: str, kind: str, time_col: str, periods: list[str] | None) -> None:
        """Replace the given periods, also those left without rows, or (None) the whole table; all or nothing."""
        out = df.withColumn(PERIOD, period_of(kind, time_col, self.settings.tz))
        if periods is not None:
            out = out.where(F.col(PERIOD).isin(periods))
        Publisher(self.spark, path, [PERIOD]).replace(
            out, [time_col, "metering_point_code"], keep_rest=periods is not None, also=[f"{PERIOD}={p}" for p in periods or ()])

    def _write_all(self, tables: dict[str, DataFrame], kind: str, periods: list[str] | None) -> None:
        """Write the roll-ups of one state side by side: each is a table of its own, and small jobs leave executors idle."""
        def write(name: str) -> None:
            self._write(tables[name], self.path(*name.split("_")), kind, "time", periods)

        with ThreadPoolExecutor(max(1, len(tables))) as pool:
            for done in [pool.submit(inheritable_thread_target(self.spark)(write), name) for name in tables]:
                done.result()

    def _read_state(self, like: DataFrame, name: str, parents: list[str] | None) -> DataFrame:
        """A state table, or its periods below the given months or years."""
        df = self._table(f"{self.root}/{name}", like.schema)
        if parents:
            inside = F.lit(False)
            for p in parents:
                inside = inside | F.col(PERIOD).startswith(f"{p}-")
            df = df.where(inside)
        return df.drop(PERIOD)

    def _refresh(self, facts: DataFrame, days: list[str] | None, sides) -> None:
        kept: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return kept[-1]

        s = self.settings
        months = sorted({d[:7] for d in days}) if days is not None else None
        years = sorted({d[:4] for d in days}) if days is not None else None
        try:
            fine = fine_states(facts, s, keep)
            day = keep(fine["day"])
            self._write(day, f"{self.root}/_day_state", "day", "bucket", days)
            self._write_all(finish_all(fine | {"day": day}, sides), "day", days)
            month = keep(coarsen(self._read_state(day, "_day_state", months),
                                 lambda b: local_month_start(b, s.tz), THREE_KEYS, wide=True))
            self._write(month, f"{self.root}/_month_state", "month", "bucket", months)
            year = coarsen(self._read_state(month, "_month_state", years),
                           lambda b: local_year_start(b, s.tz), THREE_KEYS, wide=True)
            self._write_all(finish_all({"month": month}, sides), "month", months)
            self._write_all(finish_all({"year": year}, sides), "year", years)
        finally:
            for df in kept:
                df.unpersist()

    def refresh_full(self, energies: DataFrame, sides=tuple(SIDES)) -> None:
        """Drop and rebuild every roll-up and state (SNK-15, ST-1/2)."""
        self._refresh(energies, None, sides)

    def refresh_days(self, energies_with_day: DataFrame, days: list[str], sides=tuple(SIDES)) -> None:
        """Recompute what the local ``days`` (``yyyy-MM-dd``) touched (ST-6).

        The fact scan reads only the days' partitions of the fact table. Where
        an hour crosses local midnight (zones off the whole hour), a fact also
        changes the last hour of the day before, and a day's last hour holds
        facts of the next day: both days are read, and only the changed days'
        periods are replaced.
        """
        if not days:
            return
        changed, fed = set(days), set(days)
        if not whole_hour_zone(self.settings.tz):
            changed |= {_shift(d, -1) for d in days}
            fed = changed | {_shift(d, 1) for d in changed}
        facts = energies_with_day.where(F.col("day").isin(sorted(fed)))
        self._refresh(facts, sorted(changed), sides)


def _shift(day: str, by: int) -> str:
    return (dt.date.fromisoformat(day) + dt.timedelta(days=by)).isoformat()

