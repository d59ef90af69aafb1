"""Wide priced-point queries (SNK-7, SNK-8, O-12..O-15, J-5)."""

from __future__ import annotations

from meterframe.config import MEASURE_CONSUMPTION, MEASURE_PRODUCTION
from meterframe.operators.pricing import wide_points
from meterframe.plans import oracles as O
from meterframe.plans.catalog import SETTINGS, contract_table, events, readings, register
from meterframe.sources import testdata
from meterframe.sources.prices import point_prices

_HC = ("h JOIN contracts c ON c.side = h.measure_type AND h.time >= c.valid_from "
       "AND (c.valid_to IS NULL OR h.time <= c.valid_to) LEFT JOIN day_ahead_prices p ON p.time = h.time")
_NIGHT = "(h.lh < 7 OR h.lh >= 22)"
_SPOT = "COALESCE(p.price, 0.0)"


def _wide_sql(side: int, skip_quarter: bool = False, landed_only: bool = False) -> str:
    fee = (f"CASE WHEN c.contract_type = 1 THEN 0.0 "
           f"WHEN c.contract_type IN (2, 4) THEN COALESCE(CASE WHEN {_NIGHT} THEN c.night_fee ELSE c.day_fee END, 0.0) "
           f"WHEN c.contract_type = 3 THEN {_SPOT} / 10.0 * (c.tax_percentage / 100.0 + 1.0) "
           f"+ COALESCE(c.energy_margin, 0.0) END")
    tag = "CASE WHEN h.resolution_duration = 'PT1H' THEN NULL ELSE h.resolution_duration END"
    margin = "c.energy_margin" if side == MEASURE_CONSUMPTION else "CAST(NULL AS DOUBLE)"
    where = f"h.measure_type = {side}" + (" AND h.resolution_duration <> 'PT15M'" if skip_quarter else "")
    value = "h.quantity"
    hc = _HC
    extra = ()
    if landed_only:
        # Readings as the stream sees them: good documents only, f32 quantities.
        from meterframe.plans.payload_queries import _DOCS
        value = "CAST(CAST(h.quantity AS FLOAT) AS DOUBLE)"
        hc = (_HC + " JOIN doc_state d ON d.metering_point_code = h.metering_point_code "
              "AND d.measure_type = h.measure_type AND d.resolution_duration = h.resolution_duration "
              "AND d.day = date_trunc('day', h.time + INTERVAL 2 HOUR) - INTERVAL 2 HOUR")
        where += " AND d.reason IS NULL"
        extra = (_DOCS,)
    return O.with_base(
        f"SELECT h.time, h.metering_point_code AS meteringpointcode_tag, '{side}' AS measurementtype_tag, "
        f"{tag} AS resolution_duration_tag, h.metering_point_code AS meteringpointcode, "
        f"'{side}' AS measurementtype, {tag} AS resolution_duration, 'kWh' AS unit, "
        f"strftime(h.time, '%Y-%m-%dT%H:%M:%S') AS timestamp, {value} AS value, "
        f"{_SPOT} / 1000.0 AS price, c.transfer_basic_fee, "
        f"CASE WHEN {_NIGHT} THEN c.transfer_night ELSE c.transfer_day END AS transfer_fee, "
        f"c.transfer_tax_fee AS tax_fee, c.energy_basic_fee AS basic_fee, {fee} AS energy_fee, "
        f"CAST(c.contract_type AS SMALLINT) AS contract_type, {margin} AS spot_margin, "
        f"c.tax_percentage FROM {hc} WHERE {where}", *extra)


def _points(spark, sf_dir):
    """Price points with corrections and other document types; the first A44 point of a time counts (SRC-7, J-5)."""
    return testdata.price_points(events(spark, sf_dir))


@register("wide_consumptions", _wide_sql(MEASURE_CONSUMPTION))
def q_wide_consumptions(spark, sf_dir):
    return wide_points(readings(spark, sf_dir), contract_table(spark), _points(spark, sf_dir),
                       MEASURE_CONSUMPTION, settings=SETTINGS)


@register("wide_productions", _wide_sql(MEASURE_PRODUCTION))
def q_wide_productions(spark, sf_dir):
    return wide_points(readings(spark, sf_dir), contract_table(spark), _points(spark, sf_dir),
                       MEASURE_PRODUCTION, settings=SETTINGS)


@register("wide_consumptions_hourly_only", _wide_sql(MEASURE_CONSUMPTION, skip_quarter=True))
def q_wide_consumptions_hourly_only(spark, sf_dir):
    return wide_points(readings(spark, sf_dir), contract_table(spark), _points(spark, sf_dir),
                       MEASURE_CONSUMPTION, skip_quarter=True, settings=SETTINGS)


@register("price_points_a44", O.with_base("SELECT time, price FROM day_ahead_prices"))
def q_price_points_a44(spark, sf_dir):
    return point_prices(testdata.price_points(events(spark, sf_dir)))
