"""Queries over the stored fact table: upsert, backfill, load range."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterframe.functions.timeutil import local_to_utc, ntz_lit, utc_to_local
from meterframe.operators.contracts import ContractTable
from meterframe.operators.pricing import build_energies
from meterframe.plans import jobs
from meterframe.plans import oracles as O
from meterframe.plans.catalog import SETTINGS, contract_table, energies, events, prices, register
from meterframe.plans.payload_queries import landed_months
from meterframe.session import work_path
from meterframe.sinks.energies_table import EnergiesTable
from meterframe.sinks.price_points import PricePointStore
from meterframe.sinks.publish import RejectedBatch
from meterframe.sinks.rollup_store import RollupStore
from meterframe.sinks.wide_table import WideTable
from meterframe.sources import testdata
from meterframe.sources.landing import read_landed
from meterframe.streaming.loads import Loads
from meterframe.schemas import ENERGY_COLUMNS

# The first load fetched up to this instant, the second re-fetched from the
# other one (an overlapping week), under the re-priced contract set.
FIRST_LOAD_BEFORE = "2024-01-12 00:00:00"
SECOND_LOAD_FROM = "2024-01-05 00:00:00"

_REPRICED: dict[str, ContractTable] = {}


def repriced_table(spark) -> ContractTable:
    app = spark.sparkContext.applicationId
    if app not in _REPRICED:
        _REPRICED.clear()
        _REPRICED[app] = ContractTable(testdata.contracts(spark, testdata.REPRICED_CONTRACTS))
    return _REPRICED[app]


_REPRICED_ROWS = O.CONTRACT_ROWS.replace(
    "(1, TIMESTAMP '2023-12-24 22:00:00', TIMESTAMP '2023-12-31 21:59:59', 4, 5.5E0, 3.23E0, 2.23E0, CAST(NULL AS DOUBLE),",
    "(1, TIMESTAMP '2023-12-24 22:00:00', TIMESTAMP '2023-12-31 21:59:59', 3, 5.5E0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0.25E0,")


def merge_select(first: str, second: str) -> str:
    """SELECT of the table after two loads."""
    k = O.ENERGY_KEY_COLS
    on = " AND ".join(f"o.{c} = n.{c}" for c in k)
    cols = [f"COALESCE(n.{c}, o.{c}) AS {c}" for c in k]
    owned = {
        "energy_fee": "n.measure_type = 1 AND n.contract_type IN (2, 4)",
        "energy_margin": "n.measure_type = 6 OR n.contract_type = 3",
        "night": "n.measure_type = 1",
    }
    for c in [c for c in ENERGY_COLUMNS if c not in k]:
        if c in owned:
            kept = "COALESCE(o.night, FALSE)" if c == "night" else f"o.{c}"
            cols.append(f"CASE WHEN n.time IS NULL THEN o.{c} WHEN {owned[c]} THEN n.{c} ELSE {kept} END AS {c}")
        else:
            cols.append(f"CASE WHEN n.time IS NULL THEN o.{c} ELSE n.{c} END AS {c}")
    return f"SELECT {', '.join(cols)} FROM {first} o FULL OUTER JOIN {second} n ON {on}"


#: Facts of the two loads.
MERGE_CTES = [O.contracts_cte("contracts2", _REPRICED_ROWS),
              O.energies_ctes("l1_", f"ts < TIMESTAMP '{FIRST_LOAD_BEFORE}'", "contracts"),
              O.energies_ctes("l2_", f"ts >= TIMESTAMP '{SECOND_LOAD_FROM}'", "contracts2")]


@register("energies_upsert", O.with_base(merge_select("l1_energies", "l2_energies"), *MERGE_CTES))
def q_energies_upsert(spark, sf_dir):
    ev = events(spark, sf_dir)
    p = prices(spark, sf_dir)
    first = build_energies(testdata.readings(ev.where(F.col("ts") < ntz_lit(FIRST_LOAD_BEFORE))),
                           contract_table(spark), p, SETTINGS)
    second = build_energies(testdata.readings(ev.where(F.col("ts") >= ntz_lit(SECOND_LOAD_FROM))),
                            repriced_table(spark), p, SETTINGS)
    table = EnergiesTable(spark, work_path(spark, "energies"), SETTINGS.tz).create(first)
    table.merge(second)
    return table.read()


#: Inside two local months, so the documents of both cross a bound.
BACKFILL_START, BACKFILL_STOP, BACKFILL_RES = "2023-12-20T00:00:00", "2024-01-10T00:00:00", "PT15M"
_BACKFILLED = f"""
backfilled AS (SELECT e.* REPLACE (CAST(CAST(e.value AS FLOAT) AS DOUBLE) AS value) FROM energies e
  WHERE e.resolution_duration = '{BACKFILL_RES}' AND e.time + INTERVAL 2 HOUR >= TIMESTAMP '{BACKFILL_START.replace('T', ' ')}'
    AND e.time + INTERVAL 2 HOUR < TIMESTAMP '{BACKFILL_STOP.replace('T', ' ')}')
"""


@register("backfill_range", O.with_base(
    "SELECT time, metering_point_code, measure_type, resolution_duration, value, contract_type, spot_price FROM backfilled",
    _BACKFILLED))
def q_backfill_range(spark, sf_dir):
    docs = read_landed(spark, landed_months(spark, sf_dir), BACKFILL_START[:10], BACKFILL_STOP[:10])
    rows = jobs.backfill(docs, BACKFILL_START, BACKFILL_STOP, contract_table(spark), prices(spark, sf_dir), BACKFILL_RES, SETTINGS)
    return rows.select("time", "metering_point_code", "measure_type", "resolution_duration", "value",
                       "contract_type", "spot_price")


def new_loads(spark, sf_dir, contracts, points=True) -> Loads:
    """Sinks of a fresh set of tables, priced from ``events``."""
    root = work_path(spark, "tables")
    store = PricePointStore(spark, f"{root}/price_points")
    if points:
        # The hourly points are written twice: first with other prices, then as they are.
        given = testdata.price_points(events(spark, sf_dir))
        store.upsert(given.where(F.minute("time") == 0).withColumn("price", F.col("price") + 7))
        store.upsert(given)
    return Loads(spark, f"{root}/_outbox", f"{root}/_rejects", EnergiesTable(spark, f"{root}/energies", SETTINGS.tz).create(),
                 RollupStore(spark, f"{root}/rollups", SETTINGS), contracts, prices(spark, sf_dir), SETTINGS,
                 WideTable(spark, f"{root}/wide"), store if points else None)


def _sound(report) -> None:
    if report.errors or report.waiting:
        raise RuntimeError(f"sinks failed: {report.errors}")


@register("backfill_refresh", O.with_base(O.rollup_sql("consumption", "day", source="backfilled"), _BACKFILLED))
def q_backfill_refresh(spark, sf_dir):
    """The whole backfill job: landing by overlap, both sinks, rejects, refresh; read back from a roll-up."""
    loads = new_loads(spark, sf_dir, contract_table(spark))
    _sound(jobs.run_backfill(loads, landed_months(spark, sf_dir), BACKFILL_START, BACKFILL_STOP, BACKFILL_RES))
    return loads.rollups.read("consumption", "day")


@register("energies_bad_batch", O.with_base(f"SELECT {O.ENERGY_COLUMNS} FROM l1_energies",
                                            O.energies_ctes("l1_", f"ts < TIMESTAMP '{FIRST_LOAD_BEFORE}'", "contracts")))
def q_energies_bad_batch(spark, sf_dir):
    """A batch with rows that break the table's rules is rejected whole and leaves the table as it was (SNK-6, SNK-13)."""
    ev = events(spark, sf_dir)
    p = prices(spark, sf_dir)
    first = build_energies(testdata.readings(ev.where(F.col("ts") < ntz_lit(FIRST_LOAD_BEFORE))), contract_table(spark), p, SETTINGS)
    second = build_energies(testdata.readings(ev.where(F.col("ts") >= ntz_lit(SECOND_LOAD_FROM))), repriced_table(spark), p, SETTINGS)
    bad = second.withColumn("measure_unit", F.when(F.minute("time") == 0, F.lit("kilowatt hours")).otherwise(F.col("measure_unit")))
    table = EnergiesTable(spark, work_path(spark, "energies"), SETTINGS.tz).create(first)
    try:
        table.merge(bad)
    except RejectedBatch:
        return table.read()
    raise RuntimeError("the batch was not rejected")


@register("local_day_range", O.with_base(
    "SELECT strftime(d - INTERVAL 1 DAY, '%Y-%m-%dT00:00:00') AS load_start, "
    "strftime(d, '%Y-%m-%dT00:00:00') AS load_stop, n_readings FROM "
    "(SELECT CAST(time + INTERVAL 2 HOUR AS DATE) + INTERVAL 1 DAY AS d, count(*) AS n_readings "
    "FROM energies GROUP BY 1)"))
def q_local_day_range(spark, sf_dir):
    # Each local day is fetched by the run at 06:00 local on the next day.
    per_day = (energies(spark, sf_dir).groupBy(F.to_date(utc_to_local("time", SETTINGS.tz)).alias("d"))
               .agg(F.count(F.lit(1)).alias("n_readings")))
    run_local = F.make_timestamp_ntz(F.year(F.date_add("d", 1)), F.month(F.date_add("d", 1)),
                                     F.dayofmonth(F.date_add("d", 1)), F.lit(6), F.lit(0), F.lit(0))
    start, stop = jobs.load_range(local_to_utc(run_local, SETTINGS.tz), SETTINGS.tz)
    return per_day.select(start.alias("load_start"), stop.alias("load_stop"), "n_readings")
