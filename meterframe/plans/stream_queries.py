"""Streaming queries: ingest landed documents, refresh roll-ups incrementally."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meterframe.config import GRAINS, MEASURE_PRODUCTION, SIDES
from meterframe.functions.timeutil import ntz_lit
from meterframe.operators.readings import accepted, last_write_wins
from meterframe.operators.report import daily_report
from meterframe.plans import oracles as O
from meterframe.plans.catalog import SETTINGS, contract_table, events, register
from meterframe.plans.documents import documents_from_readings
from meterframe.plans.payload_queries import _DOCS, landed
from meterframe.plans.store_queries import (
    FIRST_LOAD_BEFORE, MERGE_CTES, SECOND_LOAD_FROM, merge_select, new_loads, repriced_table,
)
from meterframe.plans.wide_queries import _wide_sql
from meterframe.schemas import ENERGY_KEY, WIDE
from meterframe.session import work_path
from meterframe.sources import landing, testdata
from meterframe.streaming.ingest import run_ingest
from meterframe.streaming.loads import Loads

_RUNS: dict[tuple[str, str, str], Loads] = {}


def _run(spark: SparkSession, sf_dir: str, kind: str, steps) -> Loads:
    """Run the ingest stream over each of ``steps`` (landing root, contracts) in turn, once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _RUNS:
        for old in [k for k in _RUNS if k[:2] != key[:2]]:
            del _RUNS[old]
        loads = new_loads(spark, sf_dir, contract_table(spark))
        checkpoint = work_path(spark, "stream-checkpoint")
        for n, (root, contracts) in enumerate(steps()):
            report = run_ingest(spark, root, loads.table, loads.rollups, contracts, loads.prices, f"{checkpoint}/{n}",
                                loads.rejects, SETTINGS, wide_path=loads.wide.path, points=loads.points)
            if report.errors or report.waiting:
                raise RuntimeError(f"sinks failed: {report.errors}")
        _RUNS[key] = loads
    return _RUNS[key]


def streamed(spark: SparkSession, sf_dir: str) -> Loads:
    """The stream over all landed documents, into empty tables and through the incremental refresh."""
    return _run(spark, sf_dir, "once", lambda: [(landed(spark, sf_dir), contract_table(spark))])


def refetched(spark: SparkSession, sf_dir: str) -> Loads:
    """Two runs of the stream: a first load, and later a second one that fetches an overlapping week
    again, under the re-priced contracts."""
    def steps():
        ev = events(spark, sf_dir)
        for part, contracts in ((F.col("ts") < ntz_lit(FIRST_LOAD_BEFORE), contract_table(spark)),
                                (F.col("ts") >= ntz_lit(SECOND_LOAD_FROM), repriced_table(spark))):
            root = work_path(spark, "landing-refetch")
            ok = accepted(testdata.readings(ev.where(part))).select(*ENERGY_KEY, "value", "measure_unit", "seq")
            landing.land(landing.as_lines(documents_from_readings(last_write_wins(ok), SETTINGS.tz)), root, clustered=True)
            yield root, contracts
    return _run(spark, sf_dir, "refetch", steps)


# Facts as the stream sees them: good documents only, quantities as f32.
_PENERGIES = """
penergies AS (SELECT e.* REPLACE (CAST(CAST(e.value AS FLOAT) AS DOUBLE) AS value) FROM energies e
  JOIN doc_state d ON d.metering_point_code = e.metering_point_code AND d.measure_type = e.measure_type
  AND d.resolution_duration = e.resolution_duration
  AND d.day = date_trunc('day', e.time + INTERVAL 2 HOUR) - INTERVAL 2 HOUR WHERE d.reason IS NULL)
"""


@register("stream_ingest", O.with_base(f"SELECT {O.ENERGY_COLUMNS} FROM penergies", _DOCS, _PENERGIES))
def q_stream_ingest(spark, sf_dir):
    return streamed(spark, sf_dir).table.read()


@register("stream_incremental_refresh", O.with_base(
    O.rollup_sql("consumption", "day", source="penergies"), _DOCS, _PENERGIES))
def q_stream_incremental_refresh(spark, sf_dir):
    return streamed(spark, sf_dir).rollups.read("consumption", "day")


@register("stream_incremental_refresh_production_month", O.with_base(
    O.rollup_sql("production", "month", source="penergies"), _DOCS, _PENERGIES))
def q_stream_incremental_refresh_production_month(spark, sf_dir):
    return streamed(spark, sf_dir).rollups.read("production", "month")


#: First and last local midnight of the ranged report, as UTC.
REPORT_FROM, REPORT_TO = "2023-12-26 22:00:00", "2024-01-07 22:00:00"


@register("report_range", O.with_base(
    "SELECT time AS date, energy_consumption AS consumption, energy_fee / 100 AS energy_cost_eur, "
    "energy_fee_spot_no_margin / 100 AS spot_cost_no_margin_eur, energy_fee_avg / 100 AS avg_energy_price_eur, "
    "(CASE WHEN energy_consumption <> 0 THEN energy_fee_spot_no_margin / energy_consumption END) / 100 AS avg_spot_price_no_margin_eur "
    f"FROM ({O.rollup_sql('consumption', 'day', source='penergies')}) "
    f"WHERE time BETWEEN TIMESTAMP '{REPORT_FROM}' AND TIMESTAMP '{REPORT_TO}'", _DOCS, _PENERGIES))
def q_report_range(spark, sf_dir):
    """The report over a closed range of days of the stored roll-up: only that range's folders are opened (O-33, R-1)."""
    days = streamed(spark, sf_dir).rollups.read("consumption", "day", REPORT_FROM, REPORT_TO)
    return daily_report(days, REPORT_FROM, REPORT_TO)


@register("stream_wide_productions", _wide_sql(MEASURE_PRODUCTION, landed_only=True))
def q_stream_wide_productions(spark, sf_dir):
    return streamed(spark, sf_dir).wide.read("productions").select(*[f.name for f in WIDE.fields])


_F32 = "REPLACE (CAST(CAST(value AS FLOAT) AS DOUBLE) AS value)"
_REFETCHED = [*MERGE_CTES, f"l1_f AS (SELECT * {_F32} FROM l1_energies)", f"l2_f AS (SELECT * {_F32} FROM l2_energies)",
              f"menergies AS ({merge_select('l1_f', 'l2_f')})"]
_REFETCH_COLUMNS = ["time", "metering_point_code", "measure_type", "contract_type", "tax_percentage", "night", "spot_price",
                    "energy_fee", "energy_margin", "transfer_fee", "price", "price_avg", "energy_fee_spot_no_margin"]


def _refetch_sql() -> str:
    parts = [f"SELECT '{grain}' AS grain, {', '.join(_REFETCH_COLUMNS)} FROM ({O.rollup_sql(side, grain, source='menergies')})"
             for side in SIDES for grain in GRAINS]
    return O.with_base(" UNION ALL ".join(parts), *_REFETCHED)


@register("stream_refetch", O.with_base(f"SELECT {O.ENERGY_COLUMNS} FROM menergies", *_REFETCHED))
def q_stream_refetch(spark, sf_dir):
    return refetched(spark, sf_dir).table.read()


@register("stream_refetch_refresh", _refetch_sql())
def q_stream_refetch_refresh(spark, sf_dir):
    """All ten roll-ups after the second load, refreshed for the days it touched only."""
    store = refetched(spark, sf_dir).rollups
    parts = [store.read(side, grain).select(F.lit(grain).alias("grain"), *_REFETCH_COLUMNS) for side in SIDES for grain in GRAINS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("stream_refetch_wide", O.with_base(
    "SELECT e.time, metering_point_code AS meteringpointcode_tag, measure_type, resolution_duration, value, contract_type, "
    "COALESCE(p.price, 0.0) / 1000.0 AS price FROM menergies e LEFT JOIN day_ahead_prices p ON p.time = e.time", *_REFETCHED))
def q_stream_refetch_wide(spark, sf_dir):
    """The wide points of both sides after the second load."""
    points = refetched(spark, sf_dir).wide.read()
    return points.select("time", "meteringpointcode_tag", F.col("measurementtype").cast("int").alias("measure_type"),
                         F.coalesce("resolution_duration", F.lit("PT1H")).alias("resolution_duration"), "value",
                         "contract_type", "price")
