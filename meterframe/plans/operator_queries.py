"""Single-operator queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterframe.functions import tariff
from meterframe.functions.timeutil import local_hour
from meterframe.operators import quality as Q
from meterframe.operators.contracts import attach_contract
from meterframe.operators.pricing import attach_spot_price, price_duplicates
from meterframe.operators.readings import accepted, last_write_wins
from meterframe.plans import oracles as O
from meterframe.plans.catalog import (
    SETTINGS, contract_table, energies, prices, readings, register,
)
from meterframe.schemas import ENERGY_KEY
from meterframe.sources import testdata

KEY = ", ".join(ENERGY_KEY)


def _latest(spark, sf_dir):
    """Accepted readings, one per key."""
    ok = accepted(readings(spark, sf_dir)).select(*ENERGY_KEY, "value", "measure_unit", "seq")
    return last_write_wins(ok)


def _contracted(spark, sf_dir):
    return attach_contract(_latest(spark, sf_dir), contract_table(spark), SETTINGS)


_HC = "h JOIN contracts c ON c.side = h.measure_type AND h.time >= c.valid_from AND (c.valid_to IS NULL OR h.time <= c.valid_to)"


@register("contract_join", O.with_base(
    f"SELECT h.time, h.metering_point_code, h.measure_type, h.resolution_duration, "
    f"CAST(c.contract_type AS SMALLINT) AS contract_type, c.energy_basic_fee, c.energy_margin, "
    f"c.transfer_tax_fee, c.tax_percentage FROM {_HC}"))
def q_contract_join(spark, sf_dir):
    return _contracted(spark, sf_dir).select(
        *ENERGY_KEY, F.col("contract_type").cast("short").alias("contract_type"),
        "energy_basic_fee", "energy_margin", "transfer_tax_fee", "tax_percentage")


@register("price_exact", O.with_base(
    f"SELECT r.time, r.metering_point_code, r.measure_type, r.resolution_duration, p.price / 10 AS spot_exact "
    f"FROM r LEFT JOIN day_ahead_prices p ON p.time = r.time"))
def q_price_exact(spark, sf_dir):
    df = attach_spot_price(_latest(spark, sf_dir), prices(spark, sf_dir), hour_fallback=False, out="px")
    return df.select(*ENERGY_KEY, (F.col("px") / 10).alias("spot_exact"))


@register("price_hour_fallback", O.with_base(
    f"SELECT r.time, r.metering_point_code, r.measure_type, r.resolution_duration, "
    f"COALESCE(p1.price, p2.price) / 10 AS spot_price FROM r "
    f"LEFT JOIN day_ahead_prices p1 ON p1.time = r.time LEFT JOIN day_ahead_prices p2 ON p2.time = r.hour_start"))
def q_price_hour_fallback(spark, sf_dir):
    df = attach_spot_price(_latest(spark, sf_dir), prices(spark, sf_dir), out="px")
    return df.select(*ENERGY_KEY, (F.col("px") / 10).alias("spot_price"))


@register("price_wide_default", O.with_base(
    f"SELECT r.time, r.metering_point_code, r.measure_type, r.resolution_duration, "
    f"COALESCE(p.price, 0.0) / 1000.0 AS price FROM r LEFT JOIN day_ahead_prices p ON p.time = r.time"))
def q_price_wide_default(spark, sf_dir):
    df = attach_spot_price(_latest(spark, sf_dir), prices(spark, sf_dir), hour_fallback=False, out="px")
    return df.select(*ENERGY_KEY, (F.coalesce(F.col("px"), F.lit(0.0)) / 1000.0).alias("price"))


@register("price_duplicates", O.with_base(
    "SELECT CAST(sum(n) AS BIGINT) AS n_price_rows, count(*) AS n_times, "
    "count(*) FILTER (WHERE n > 1) AS n_duplicate_times "
    "FROM (SELECT time, count(*) AS n FROM (SELECT time FROM day_ahead_prices UNION ALL "
    "SELECT time FROM day_ahead_prices WHERE EXTRACT(hour FROM time) % 5 = 0) GROUP BY time)"))
def q_price_duplicates(spark, sf_dir):
    """Prices of every fifth hour stand twice."""
    p = prices(spark, sf_dir)
    return price_duplicates(p.unionByName(p.where(F.hour("time") % 5 == 0)), summary=True)


@register("night_flag", O.with_base(
    f"SELECT h.time, h.metering_point_code, h.measure_type, h.resolution_duration, "
    f"CAST(h.lh AS INTEGER) AS local_hour, (h.lh < 7 OR h.lh >= 22) AS night FROM {_HC}"))
def q_night_flag(spark, sf_dir):
    df = _contracted(spark, sf_dir).withColumn("local_hour", local_hour("time", SETTINGS.tz))
    return df.select(*ENERGY_KEY, "local_hour", tariff.energy_night("local_hour").alias("night"))


@register("transfer_fee", O.with_base(
    f"SELECT h.time, h.metering_point_code, h.measure_type, h.resolution_duration, "
    f"CASE WHEN h.lh < 7 OR h.lh >= 22 THEN c.transfer_night ELSE c.transfer_day END AS transfer_fee FROM {_HC}"))
def q_transfer_fee(spark, sf_dir):
    df = _contracted(spark, sf_dir).withColumn("_lh", local_hour("time", SETTINGS.tz))
    return df.select(*ENERGY_KEY, tariff.transfer_fee("_lh").alias("transfer_fee"))


@register("energy_fee_fixed", O.with_base(
    f"SELECT h.time, h.metering_point_code, h.measure_type, h.resolution_duration, "
    f"COALESCE(CASE WHEN h.lh < 7 OR h.lh >= 22 THEN c.night_fee ELSE c.day_fee END, 0.0) AS energy_fee "
    f"FROM {_HC} WHERE c.contract_type IN (2, 4)"))
def q_energy_fee_fixed(spark, sf_dir):
    df = _contracted(spark, sf_dir).where(F.col("contract_type").isin(*tariff.FIXED_LIKE))
    df = df.withColumn("_lh", local_hour("time", SETTINGS.tz))
    return df.select(*ENERGY_KEY, tariff.energy_fee_fixed("_lh").alias("energy_fee"))


_SPOT_FEE = "COALESCE(p.price, 0.0) / 10.0 * (c.tax_percentage / 100.0 + 1.0) + COALESCE(c.energy_margin, 0.0)"


def _wide_priced(spark, sf_dir):
    df = attach_spot_price(_contracted(spark, sf_dir), prices(spark, sf_dir), hour_fallback=False, out="px")
    return df.withColumn("_spot", F.coalesce(F.col("px"), F.lit(0.0))) \
             .withColumn("_lh", local_hour("time", SETTINGS.tz))


@register("energy_fee_spot", O.with_base(
    f"SELECT h.time, h.metering_point_code, h.measure_type, h.resolution_duration, {_SPOT_FEE} AS energy_fee "
    f"FROM {_HC} LEFT JOIN day_ahead_prices p ON p.time = h.time WHERE c.contract_type = 3"))
def q_energy_fee_spot(spark, sf_dir):
    df = _wide_priced(spark, sf_dir).where(F.col("contract_type") == tariff.SPOT)
    return df.select(*ENERGY_KEY, tariff.energy_fee_spot("_spot").alias("energy_fee"))


@register("energy_fee_dispatch", O.with_base(
    f"SELECT h.time, h.metering_point_code, h.measure_type, h.resolution_duration, "
    f"CAST(c.contract_type AS SMALLINT) AS contract_type, "
    f"CASE WHEN c.contract_type = 1 THEN 0.0 "
    f"WHEN c.contract_type IN (2, 4) THEN COALESCE(CASE WHEN h.lh < 7 OR h.lh >= 22 THEN c.night_fee ELSE c.day_fee END, 0.0) "
    f"WHEN c.contract_type = 3 THEN {_SPOT_FEE} END AS energy_fee "
    f"FROM {_HC} LEFT JOIN day_ahead_prices p ON p.time = h.time"))
def q_energy_fee_dispatch(spark, sf_dir):
    df = _wide_priced(spark, sf_dir)
    return df.select(*ENERGY_KEY, F.col("contract_type").cast("short").alias("contract_type"),
                     tariff.energy_fee("contract_type", "_spot", "_lh").alias("energy_fee"))


# Readings with every fault: some without a time, some from before the first contract, and a week under type none.
_NONE_WEEK = ("(1, TIMESTAMP '2023-12-24 22:00:00', TIMESTAMP '2023-12-31 21:59:59', 4,", "(1, TIMESTAMP '2023-12-24 22:00:00', TIMESTAMP '2023-12-31 21:59:59', 1,")


@register("rejects_by_reason", O.with_base(
    "SELECT measure_type, reason, count(*) AS n_rows FROM (SELECT f.measure_type, CASE WHEN f.time IS NULL THEN 'no_time' "
    "WHEN f.quantity IS NULL THEN 'no_quantity' WHEN c.contract_type IS NULL THEN 'no_single_contract' "
    "WHEN f.measure_type = 1 AND c.contract_type = 1 THEN 'contract_type_none' END AS reason FROM faulty f "
    "LEFT JOIN contracts_none c ON c.side = f.measure_type AND f.time >= c.valid_from AND (c.valid_to IS NULL OR f.time <= c.valid_to)) "
    "WHERE reason IS NOT NULL GROUP BY 1, 2",
    O.contracts_cte("contracts_none", O.CONTRACT_ROWS.replace(*_NONE_WEEK)),
    "faulty AS (SELECT * REPLACE (CASE WHEN event_id % 50 = 11 THEN NULL WHEN event_id % 50 IN (13, 7) THEN time - INTERVAL 730 DAY "
    "ELSE time END AS time) FROM readings)"))
def q_rejects_by_reason(spark, sf_dir):
    slot = F.col("seq") % 50
    faulty = readings(spark, sf_dir).withColumn("time", F.when(slot == 11, None).when(
        slot.isin(13, 7), F.col("time") - F.make_dt_interval(F.lit(730))).otherwise(F.col("time")))
    return Q.rejects_by_reason(faulty, testdata.contracts(spark, testdata.NONE_WEEK_CONTRACTS), SETTINGS)


@register("energies_dedupe", O.with_base(
    f"SELECT {KEY}, count(*) AS n_copies, max(event_id) AS seq, arg_max(quantity, event_id) AS value "
    f"FROM readings WHERE quantity IS NOT NULL GROUP BY {KEY} HAVING count(*) > 1"))
def q_energies_dedupe(spark, sf_dir):
    ok = accepted(readings(spark, sf_dir))
    latest = F.max(F.struct("seq", "value"))
    return (ok.groupBy(*ENERGY_KEY).agg(F.count(F.lit(1)).alias("n_copies"), latest.alias("_l"))
            .where(F.col("n_copies") > 1)
            .select(*ENERGY_KEY, "n_copies", F.col("_l.seq").alias("seq"), F.col("_l.value").alias("value")))


@register("energies_key_check", O.with_base(
    f"SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_duplicate_keys "
    f"FROM (SELECT {KEY}, count(*) AS n FROM (SELECT * FROM energies UNION ALL SELECT * FROM energies "
    f"WHERE EXTRACT(hour FROM time) = 5) GROUP BY {KEY})"))
def q_energies_key_check(spark, sf_dir):
    """Facts of the hour from 5 stand twice."""
    e = energies(spark, sf_dir)
    return Q.key_check(e.unionByName(e.where(F.hour("time") == 5)))


_NULL_SQL = ", ".join([f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in Q.NOT_NULL])
# Facts that break each rule: the hour of a fact tells which column is spoilt.
_SPOIL = {c: i for i, c in enumerate(Q.NOT_NULL)}


def _spoilt_sql() -> str:
    spoilt = [f"CASE WHEN EXTRACT(hour FROM e.time) = {h} THEN NULL ELSE {c} END AS {c}" for c, h in _SPOIL.items()
              if c not in ("measure_unit", "resolution_duration")]
    spoilt += [f"CASE EXTRACT(hour FROM e.time) WHEN {_SPOIL[c]} THEN NULL WHEN {h} THEN '{x}' ELSE {c} END AS {c}"
               for c, h, x in (("measure_unit", 20, "kilowatt"), ("resolution_duration", 21, "PT15MINUTES"))]
    return f"spoilt AS (SELECT e.* REPLACE ({', '.join(spoilt)}) FROM energies e)"


@register("energies_null_check", O.with_base(
    f"SELECT count(*) AS n_rows, {_NULL_SQL}, "
    f"count(*) FILTER (WHERE length(measure_unit) > 3) AS long_measure_unit, "
    f"count(*) FILTER (WHERE length(resolution_duration) > 10) AS long_resolution_duration FROM spoilt", _spoilt_sql()))
def q_energies_null_check(spark, sf_dir):
    hour = F.hour("time")
    e = energies(spark, sf_dir)
    spoilt = {c: F.when(hour != h, F.col(c)) for c, h in _SPOIL.items()}
    for c, h, x in (("measure_unit", 20, "kilowatt"), ("resolution_duration", 21, "PT15MINUTES")):
        spoilt[c] = F.when(hour == h, F.lit(x)).otherwise(spoilt[c])
    return Q.null_check(e.select(*(spoilt.get(c, F.col(c)).alias(c) for c in e.columns)))


@register("resolution_backfill", O.with_base(
    f"SELECT {KEY}, value FROM energies"))
def q_resolution_backfill(spark, sf_dir):
    # Rows as stored before the resolution column existed: hourly rows carry NULL.
    legacy = energies(spark, sf_dir).withColumn(
        "resolution_duration",
        F.when(F.col("resolution_duration") != "PT1H", F.col("resolution_duration")))
    return Q.backfill_resolution(legacy).select(*ENERGY_KEY, "value")
