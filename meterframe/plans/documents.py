"""Payload documents made from readings, for the queries and tests that read documents back.

Readings are grouped per (point, side, resolution, local day or month).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.config import DEFAULT_TZ
from meterframe.functions.tariff import resolution_minutes
from meterframe.functions.timeutil import local_day_start, local_month_start, utc_to_local


#: Pieces that the documents of a side and period are dealt into at least.
_SPREAD = 4
#: To the end of a text.
_ALL = 2**31 - 1


def _local_text(utc: Column, tz: str) -> Column:
    return F.date_format(utc_to_local(utc, tz), "yyyy-MM-dd'T'HH:mm:ss")


def _next_period(start_utc: Column, tz: str, months: bool) -> Column:
    # Start of the following period: 36 h on is inside the next local day, 45 days on inside the next month.
    if months:
        return local_month_start(start_utc + F.make_dt_interval(F.lit(45)), tz)
    return local_day_start(start_utc + F.make_dt_interval(F.lit(1), F.lit(12)), tz)


def _minutes_between(a: Column, b: Column) -> Column:
    # TIMESTAMP_NTZ difference; a cast to TIMESTAMP would go through the session zone.
    return F.timestamp_diff("MINUTE", a, b).cast("int")


def _open(json: Column) -> Column:
    """A JSON object's text without its last bracket, so that a field can follow."""
    return F.substr(json, F.lit(1), F.length(json) - 1)


def documents_from_readings(readings: DataFrame, tz: str = DEFAULT_TZ,
                            spot_prices: DataFrame | None = None, months: bool = False) -> DataFrame:
    """Payload documents as text (``value``), one per (point, side, resolution, local day or month).

    ``readings`` must hold one row per key (after last-write-wins), so each
    group is bounded by the slots of one period.  Every slot of it is
    present; slots without a reading carry a NULL quantity.  With
    ``spot_prices`` (``time, price``) consumption documents of a day embed its
    hourly spot series.

    Rows are brought together by side and period while they hold just their
    readings; the slots, much the larger part, are made after that, in the
    tasks that use them (``landing.land(…, clustered=True)`` shuffles no more).
    What all documents of a period say alike (the times of its slots, its spot
    series) is worked out once a period and sent to all tasks: a document adds
    its quantities, in time linear in its slots.
    """
    step = resolution_minutes(F.col("resolution_duration"))
    start = local_month_start if months else local_day_start
    r = readings.select(
        "metering_point_code", "measure_type", "resolution_duration", "measure_unit", "value",
        start(F.col("time"), tz).alias("day"), "time")
    r = r.withColumn("slot", (_minutes_between(F.col("day"), F.col("time")) / step).cast("int"))
    grouped = r.groupBy("metering_point_code", "measure_type", "resolution_duration", "day").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.col("value").cast("float").alias("quantity")))).alias("q"),
        F.first("measure_unit").alias("unit"),
        F.sum("value").cast("float").alias("total"))
    # Map keys are slots, none of them twice.
    grouped = grouped.withColumn("q", F.array_sort(F.map_entries("q")))
    grouped = grouped.withColumn("_spread", F.pmod(F.xxhash64("metering_point_code"), F.lit(_SPREAD))) \
        .hint("rebalance", "measure_type", "day", "_spread")
    periods = _periods(readings, tz, spot_prices, months)
    g = F.broadcast(periods).join(
        grouped, (periods["p_day"] == grouped["day"]) & periods["p_resolution"].eqNullSafe(grouped["resolution_duration"]), "right")
    period = [F.col("start_txt").alias("start"), F.col("stop_txt").alias("stop")]
    header = F.to_json(F.struct(F.col("metering_point_code").alias("meteringpointcode"),
                                F.struct(F.col("total").alias("quantity"), *period, F.col("unit").alias("unit")).alias("sum")))
    series = F.to_json(F.struct(*period, F.col("resolution_duration").alias("resolution")))
    # A slot's text ends with the unit, which also parts it from the next one.
    end = F.when(F.col("unit").isNull(), F.lit("}")).otherwise(
        F.concat(F.lit(","), F.substring(F.to_json(F.struct("unit")), 2, _ALL)))
    filled = F.zip_with(_heads(F.size("slots")), "slots", lambda head, slot: F.concat(head, slot))
    slots = F.call_function("array_join", filled, F.concat(end, F.lit(",")))
    tsv = F.when(F.size("slots") > 0, F.concat(slots, end)).otherwise(F.lit(""))
    spot = F.when((F.col("measure_type") == 1) & F.col("spot").isNotNull(), F.concat(F.lit(',"spotdata":'), F.col("spot"))).otherwise("")
    return g.select("measure_type", F.concat(
        F.lit('{"getconsumptionsresult":{"consumptiondata":'), _open(header), F.lit(',"timeseries":'), _open(series),
        F.lit(',"values":{"tsv":['), tsv, F.lit("]}}}"), spot, F.lit("}}")).alias("value"))


def _heads(n_slots: Column) -> Column:
    """How each slot's text begins: with its quantity where ``q`` (sorted by slot) has one."""
    def filled(e, i):
        quantity = F.concat(F.rtrim(F.to_json(F.struct(e["value"].alias("quantity"))), F.lit("}")), F.lit(","))
        following = F.coalesce(F.get(F.col("q"), i + 1)["key"], n_slots)
        return F.concat(F.array(F.when(e["value"].isNull(), F.lit("{")).otherwise(quantity)),
                        F.array_repeat(F.lit("{"), following - e["key"] - 1))

    return F.concat(F.array_repeat(F.lit("{"), F.coalesce(F.get(F.col("q"), F.lit(0))["key"], n_slots)),
                    F.flatten(F.transform("q", filled)))


def _periods(readings: DataFrame, tz: str, spot_prices: DataFrame | None, months: bool) -> DataFrame:
    """What the documents of a period and resolution say alike: start, stop, the slots' text (from their time to their
    stop) and the spot series.  One row for each of them, however many documents there are."""
    start = local_month_start if months else local_day_start
    # Distinct times first: the period is worked out for them only.
    times = readings.where(F.col("time").isNotNull()).select("time", "resolution_duration").distinct()
    p = times.select(start(F.col("time"), tz).alias("p_day"), F.col("resolution_duration").alias("p_resolution")).distinct()
    p = p.withColumn("next_day", _next_period(F.col("p_day"), tz, months)).withColumn("step", resolution_minutes(F.col("p_resolution")))
    p = p.withColumn("n_slots", (_minutes_between(F.col("p_day"), F.col("next_day")) / F.col("step")).cast("int"))
    p = p.withColumn("start_txt", _local_text(F.col("p_day"), tz)).withColumn("stop_txt", _local_text(F.col("next_day"), tz))

    def slot(i):
        t = F.col("p_day") + F.make_dt_interval(F.lit(0), F.lit(0), i * F.col("step"), F.lit(0))
        text = F.to_json(F.struct(_local_text(t, tz).alias("time"), F.col("start_txt").alias("start"), F.col("stop_txt").alias("stop")))
        return F.substring(F.rtrim(text, F.lit("}")), 2, _ALL)

    p = p.withColumn("slots", F.transform(F.sequence(F.lit(0), F.col("n_slots") - 1), slot))
    p, spot = (p, F.lit(None).cast("string")) if spot_prices is None else _with_spot(p, spot_prices, tz)
    return p.select("p_day", "p_resolution", "start_txt", "stop_txt", "slots", spot.alias("spot"))


def _with_spot(periods: DataFrame, prices: DataFrame, tz: str):
    """The hourly spot series of a period as text.

    Prices are grouped per local day once (bounded: 25 hours a day) and joined
    to the periods on the day: one short row a day.
    """
    hourly = prices.where(F.minute("time") == 0).select(
        local_day_start(F.col("time"), tz).alias("pday"), "time", "price")
    hourly = hourly.withColumn("slot", (_minutes_between(F.col("pday"), F.col("time")) / 60).cast("int"))
    per_day = hourly.groupBy("pday").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.col("price").cast("float")))).alias("pq"))
    d = periods.join(F.broadcast(per_day), periods["p_day"] == per_day["pday"], "left")
    n_hours = (_minutes_between(F.col("p_day"), F.col("next_day")) / 60).cast("int")

    def slot_entry(i):
        t = F.col("p_day") + F.make_dt_interval(F.lit(0), i, F.lit(0), F.lit(0))
        return F.struct(F.try_element_at(F.col("pq"), i).alias("quantity"), _local_text(t, tz).alias("time"),
                        F.col("start_txt").alias("start"), F.col("stop_txt").alias("stop"),
                        F.lit("EUR/MWh").alias("unit"))

    tsv = F.transform(F.sequence(F.lit(0), n_hours - 1), slot_entry)
    spot = F.struct(
        F.struct(F.lit(None).cast("float").alias("quantity"), F.col("start_txt").alias("start"),
                 F.col("stop_txt").alias("stop"), F.lit("EUR/MWh").alias("unit")).alias("sum"),
        F.struct(F.col("start_txt").alias("start"), F.col("stop_txt").alias("stop"),
                 F.lit("PT1H").alias("resolution"), F.struct(tsv.alias("tsv")).alias("values")).alias("timeseries"))
    return d, F.to_json(spot)
