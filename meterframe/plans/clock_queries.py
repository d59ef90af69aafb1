"""Queries over readings across the clock changes of spring and autumn (O-2, O-16..O-21, AG-8, AG-9).

``events`` is shifted so that it straddles a change.  The contracts have night
hours of their own, no tax on negative prices and a time under type none.  The
SQL takes local time from DuckDB's own zone rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from meterframe.config import MEASURE_CONSUMPTION
from meterframe.operators import rollups as R
from meterframe.operators.contracts import ContractTable
from meterframe.operators.pricing import build_energies, wide_points
from meterframe.operators.readings import accepted, last_write_wins
from meterframe.plans import oracles as O
from meterframe.plans.catalog import SETTINGS, events, register
from meterframe.plans.documents import documents_from_readings
from meterframe.schemas import ENERGY_KEY
from meterframe.session import work_path
from meterframe.sources import landing, testdata
from meterframe.sources import payloads as P

#: Days by which events are shifted back: over 2024-03-31 and over 2023-10-29.
SEASONS = {"spring": -75, "autumn": 79}
_ZONE = "Europe/Helsinki"
_TABLES: dict[str, ContractTable] = {}


def _contracts(spark) -> ContractTable:
    app = spark.sparkContext.applicationId
    if app not in _TABLES:
        _TABLES.clear()
        _TABLES[app] = ContractTable(testdata.clock_contracts(spark))
    return _TABLES[app]


def _local(x: str) -> str:
    return f"timezone('{_ZONE}', timezone('UTC', {x}))"


def _utc(x: str) -> str:
    return f"timezone('UTC', timezone('{_ZONE}', {x}))"


def _sql(season: str, select: str, *ctes: str) -> str:
    def value(v) -> str:
        if v is None:
            return "NULL"
        if hasattr(v, "isoformat"):
            return f"TIMESTAMP '{v.isoformat(sep=' ')}'"
        return str(v).upper() if isinstance(v, bool) else f"{v}E0" if isinstance(v, float) else str(v)

    rows = ", ".join(f"({', '.join(value(v) for v in r)})" for r in testdata.CLOCK_CONTRACTS)
    contracts = (f"contracts AS (SELECT * REPLACE (CAST(valid_to AS TIMESTAMP) AS valid_to, CAST(energy_margin AS DOUBLE) AS energy_margin) "
                 f"FROM (VALUES {rows}) AS c({O.CONTRACT_COLUMNS}, e_from, e_to, t_from, t_to, free))")
    night = {k: f"lh < COALESCE(c.{k}_to, 7) OR lh >= COALESCE(c.{k}_from, 22)" for k in "et"}
    facts = O.energies_ctes(local=_local("time"), energy_night=night["e"], transfer_night=night["t"])
    parts = [O.shared(f"- INTERVAL ({SEASONS[season]}) DAY"), contracts, facts, *ctes]
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select.strip()


_BUCKETS = {g: _utc(f"date_trunc('{g}', {_local('time')})") for g in ("day", "month", "year")}


def _energies(spark, sf_dir, season):
    ev, back = events(spark, sf_dir), SEASONS[season]
    return build_energies(testdata.readings(ev, back), _contracts(spark), testdata.day_ahead_prices(ev, back), SETTINGS)


def _energies_query(season):
    @register(f"clock_{season}_energies", _sql(season, f"SELECT {O.ENERGY_COLUMNS} FROM energies"))
    def q(spark, sf_dir):
        return _energies(spark, sf_dir, season)


def _rollup_query(season, side, grain):
    @register(f"clock_{season}_rollup_{side}_{grain}", _sql(season, O.rollup_sql(side, grain, buckets=_BUCKETS)))
    def q(spark, sf_dir):
        return R.rollup(_energies(spark, sf_dir, season), side, grain, SETTINGS)


_WIDE_NIGHT = "h.lh < COALESCE(c.e_to, 7) OR h.lh >= COALESCE(c.e_from, 22)"
_SPOT = "COALESCE(p.price, 0.0)"
_WIDE = f"""
SELECT h.time, h.metering_point_code AS meteringpointcode, h.resolution_duration AS resolution, h.quantity AS value,
  {_SPOT} / 1000.0 AS price, CAST(c.contract_type AS SMALLINT) AS contract_type,
  CASE c.contract_type WHEN 1 THEN 0.0
    WHEN 3 THEN CASE WHEN c.free AND {_SPOT} < 0 THEN {_SPOT} / 10.0 + COALESCE(c.energy_margin, 0.0)
      ELSE {_SPOT} / 10.0 * (c.tax_percentage / 100.0 + 1.0) + COALESCE(c.energy_margin, 0.0) END
    ELSE COALESCE(CASE WHEN {_WIDE_NIGHT} THEN c.night_fee ELSE c.day_fee END, 0.0) END AS energy_fee
FROM h JOIN contracts c ON c.side = h.measure_type AND h.time >= c.valid_from AND (c.valid_to IS NULL OR h.time <= c.valid_to)
LEFT JOIN day_ahead_prices p ON p.time = h.time WHERE h.measure_type = {MEASURE_CONSUMPTION}
"""


def _wide_query(season):
    @register(f"clock_{season}_wide_consumptions", _sql(season, _WIDE))
    def q(spark, sf_dir):
        ev, back = events(spark, sf_dir), SEASONS[season]
        points = wide_points(testdata.readings(ev, back), _contracts(spark), testdata.day_ahead_prices(ev, back),
                             MEASURE_CONSUMPTION, settings=SETTINGS)
        return points.select("time", "meteringpointcode", F.coalesce("resolution_duration", F.lit("PT1H")).alias("resolution"),
                             "value", "price", "contract_type", "energy_fee")


_SLOTS = f"""
docs AS (SELECT DISTINCT metering_point_code, measure_type, resolution_duration, date_trunc('day', {_local('time')}) AS d FROM r),
slots AS (SELECT *, unnest(range(0, CAST(date_diff('minute', {_utc('d')}, {_utc('d + INTERVAL 1 DAY')}) AS BIGINT)
  // CASE resolution_duration WHEN 'PT1H' THEN 60 ELSE 15 END)) AS pos FROM docs),
timed AS (SELECT *, {_utc('d')} + pos * (CASE resolution_duration WHEN 'PT1H' THEN INTERVAL 60 MINUTE ELSE INTERVAL 15 MINUTE END) AS time
  FROM slots)
"""


def _explode_query(season):
    @register(f"clock_{season}_explode", _sql(
        season, "SELECT metering_point_code, measure_type, resolution_duration, CAST(pos AS INTEGER) AS pos, time, "
        "CAST(CAST(r.quantity AS FLOAT) AS DOUBLE) AS value FROM timed LEFT JOIN r USING (metering_point_code, measure_type, "
        "resolution_duration, time)", _SLOTS))
    def q(spark, sf_dir):
        """Documents of local days of 23, 24 and 25 hours, read back by position."""
        ok = accepted(testdata.readings(events(spark, sf_dir), SEASONS[season])).select(*ENERGY_KEY, "value", "measure_unit", "seq")
        root = work_path(spark, f"landing-{season}")
        landing.land(landing.as_lines(documents_from_readings(last_write_wins(ok), SETTINGS.tz)), root, clustered=True)
        rows = P.explode_readings(P.split_documents(landing.read_landed(spark, root))[0], SETTINGS.tz)
        return rows.select("metering_point_code", "measure_type", "resolution_duration", "pos", "time", "value")


for _season in SEASONS:
    _energies_query(_season)
    _wide_query(_season)
    _explode_query(_season)
    for _side, _grain in (("consumption", "day"), ("production", "day"), ("consumption", "month")):
        _rollup_query(_season, _side, _grain)
