"""Registered queries: each reads the driver's tables from ``sf_dir``.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name]`` (DuckDB SQL)
feed ``__spark_entry__``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.config import GRAINS, SIDES, Settings
from meterframe.operators import rollups as R
from meterframe.operators.contracts import ContractTable
from meterframe.operators.pricing import build_energies
from meterframe.operators.report import daily_report
from meterframe.plans import oracles as O
from meterframe.sources import testdata

SETTINGS = Settings()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.table(spark, sf_dir, "events")


_CONTRACTS: dict[str, ContractTable] = {}


def contract_table(spark: SparkSession) -> ContractTable:
    """The contract dimension, segmented once per application.

    It is configuration, not data: one small persisted table reused by every
    query of the session.
    """
    app = spark.sparkContext.applicationId
    if app not in _CONTRACTS:
        _CONTRACTS.clear()
        _CONTRACTS[app] = ContractTable(testdata.contracts(spark))
    return _CONTRACTS[app]


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.readings(events(spark, sf_dir))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.day_ahead_prices(events(spark, sf_dir))


def energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_energies(readings(spark, sf_dir), contract_table(spark), prices(spark, sf_dir), SETTINGS)


@register("energies_build", O.with_base(f"SELECT {O.ENERGY_COLUMNS} FROM energies"))
def q_energies_build(spark, sf_dir):
    return energies(spark, sf_dir)


def _rollup_query(side: str, grain: str) -> Query:
    def q(spark, sf_dir):
        return R.rollup(energies(spark, sf_dir), side, grain, SETTINGS)
    q.__name__ = f"q_rollup_{side}_{grain}"
    return q


for _side in SIDES:
    for _grain in GRAINS:
        register(f"rollup_{_side}_{_grain}", O.with_base(O.rollup_sql(_side, _grain)))(
            _rollup_query(_side, _grain))


_REPORT_SQL = O.with_base(
    """SELECT time AS date, energy_consumption AS consumption,
      energy_fee / 100 AS energy_cost_eur,
      energy_fee_spot_no_margin / 100 AS spot_cost_no_margin_eur,
      energy_fee_avg / 100 AS avg_energy_price_eur,
      (CASE WHEN energy_consumption <> 0 THEN energy_fee_spot_no_margin / energy_consumption END) / 100
        AS avg_spot_price_no_margin_eur
    FROM cday ORDER BY 1""",
    f"cday AS ({O.rollup_sql('consumption', 'day')})")


@register("report_daily", _REPORT_SQL)
def q_report_daily(spark, sf_dir):
    return daily_report(R.rollup(energies(spark, sf_dir), "consumption", "day", SETTINGS))


@register("cutover_derive", O.with_base(
    "SELECT min(time) AS cutover FROM energies WHERE resolution_duration = 'PT15M'"))
def q_cutover_derive(spark, sf_dir):
    return R.derive_cutover(energies(spark, sf_dir))


@register("cutover_filter", O.with_base(
    f"SELECT measure_type, resolution_duration, count(*) AS n_rows, min(time) AS first_time, "
    f"max(time) AS last_time FROM energies WHERE {O.CUTOVER_FILTER} GROUP BY 1, 2"))
def q_cutover_filter(spark, sf_dir):
    return (energies(spark, sf_dir).where(R.cutover_filter(SETTINGS.cutover))
            .groupBy("measure_type", "resolution_duration")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("time").alias("first_time"),
                 F.max("time").alias("last_time")))
