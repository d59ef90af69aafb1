"""The driver's ``events`` table read as meter readings and prices (FIXTURES §3).

``events`` is shifted back 15 days so that it straddles the resolution
cut-over.  Each event is one reading of a metering point; every third is an
hourly reading, errors and purchases are production, every 50th quantity is
missing.  Day-ahead prices are aggregated from the same events.  Everything is
derived with Spark from the table, so work grows with it.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe import schemas
from meterframe.config import (
    MEASURE_CONSUMPTION, MEASURE_PRODUCTION, RESOLUTION_HOUR, RESOLUTION_QUARTER,
)
from meterframe.functions.timeutil import hour_start, quarter_start

#: Days by which events are shifted back.
BACK_DAYS = 15
_CONSUMPTION_EVENTS = ("view", "click", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _bucketed(events: DataFrame, back_days: int = BACK_DAYS) -> DataFrame:
    t = F.col("ts") - F.make_dt_interval(F.lit(back_days))
    return (events.select("event_id", "user_id", "event_type", "value", t.alias("t"))
            .select("event_id", "user_id", "event_type", "value",
                    quarter_start("t").alias("t15"), hour_start("t").alias("t60")))


def readings(events: DataFrame, back_days: int = BACK_DAYS) -> DataFrame:
    """Raw readings (``schemas.READINGS`` plus ``hour_start``), nulls kept."""
    b = _bucketed(events, back_days)
    hourly = F.col("event_id") % 3 == 0
    return b.select(
        F.when(hourly, F.col("t60")).otherwise(F.col("t15")).alias("time"),
        F.concat(F.lit("mp-"), F.col("user_id").cast("string")).alias("metering_point_code"),
        F.when(F.col("event_type").isin(*_CONSUMPTION_EVENTS), F.lit(MEASURE_CONSUMPTION))
         .otherwise(F.lit(MEASURE_PRODUCTION)).alias("measure_type"),
        F.when(hourly, F.lit(RESOLUTION_HOUR)).otherwise(F.lit(RESOLUTION_QUARTER))
         .alias("resolution_duration"),
        F.when(F.col("event_id") % 50 == 7, F.lit(None).cast("double"))
         .otherwise(F.col("value") / 100).alias("value"),
        F.lit("kWh").alias("measure_unit"),
        F.col("event_id").alias("seq"),
    )


def day_ahead_prices(events: DataFrame, back_days: int = BACK_DAYS) -> DataFrame:
    """``(time, price)`` in EUR/MWh: hourly and some quarter-hour prices."""
    b = _bucketed(events, back_days)
    hourly = (b.where(F.hour("t60") % 7 != 3).groupBy(F.col("t60").alias("time"))
              .agg((F.round(F.avg("value") * 100) / 100 - 40).alias("price")))
    quarterly = (b.where((F.col("event_id") % 2 == 0) & (F.col("t15") != F.col("t60")))
                 .groupBy(F.col("t15").alias("time"))
                 .agg((F.max("value") - 60).alias("price")))
    return hourly.unionByName(quarterly)


def price_points(events: DataFrame) -> DataFrame:
    """Point-form prices (``schemas.PRICE_POINTS``) derived from the same events.

    Every price appears as an A44 point; hourly prices are repeated as a
    later-stamped A44 correction and as another document type, so the A44
    filter and the first-row rule both have work.
    """
    p = day_ahead_prices(events)
    stamp = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def points(type_tag, ts, price):
        return p.select(
            "time", F.lit(type_tag).alias("type_tag"), F.lit("10YFI-1--------U").alias("in_domain_tag"),
            F.lit("10YFI-1--------U").alias("out_domain_tag"), F.lit(type_tag).alias("document_type"),
            F.lit("10YFI-1--------U").alias("in_domain"), F.lit("10YFI-1--------U").alias("out_domain"),
            F.lit("EUR").alias("currency"), F.lit("MWH").alias("price_measure"), F.lit("A01").alias("curve_type"),
            ts.alias("timestamp"), price.alias("price"), F.lit(None).cast("int").alias("dirty"))

    hourly = F.minute("time") == 0
    first = points("A44", stamp, F.col("price"))
    later = points("A44", F.concat(stamp, F.lit("+1")), F.col("price") + 1).where(hourly)
    other = points("A65", stamp, F.col("price") + 100).where(hourly)
    return first.unionByName(later).unionByName(other)


# ---------------------------------------------------------------------------
# The contract table of the mapping, bounds already in UTC.
# (side, valid_from, valid_to, contract_type, energy_basic_fee, day_fee,
#  night_fee, energy_margin, transfer_basic_fee, transfer_day, transfer_night,
#  transfer_tax_fee, tax_percentage)
# ---------------------------------------------------------------------------
_T = _dt.datetime
FIXTURE_CONTRACTS = [
    (1, _T(2023, 1, 1, 0, 0, 0), _T(2023, 12, 24, 21, 59, 59), 2, 4.5, 2.23, 1.23, None, 13.5, 3.34, 2.34, 2.35972, 24.0),
    (1, _T(2023, 12, 24, 22, 0, 0), _T(2023, 12, 31, 21, 59, 59), 4, 5.5, 3.23, 2.23, None, 14.5, 4.34, 3.34, 2.35972, 24.0),
    (1, _T(2023, 12, 31, 22, 0, 0), None, 3, 5.5, None, None, 0.25, 14.5, 4.34, 3.34, 2.35972, 24.0),
    (6, _T(2023, 1, 1, 0, 0, 0), None, 3, 0.0, None, None, 0.3, 0.0, 0.07, 0.07, 0.0, 24.0),
]


# A later configuration in which the hybrid period was re-priced as spot; used
# to exercise column ownership when re-fetched readings change contract type.
REPRICED_CONTRACTS = [
    FIXTURE_CONTRACTS[0],
    (1, _T(2023, 12, 24, 22, 0, 0), _T(2023, 12, 31, 21, 59, 59), 3, 5.5, None, None, 0.25, 14.5, 4.34, 3.34, 2.35972, 24.0),
    FIXTURE_CONTRACTS[2],
    FIXTURE_CONTRACTS[3],
]
# The same week under contract type none (1): its consumption can't be priced.
NONE_WEEK_CONTRACTS = [FIXTURE_CONTRACTS[0], (*FIXTURE_CONTRACTS[1][:3], 1, *FIXTURE_CONTRACTS[1][4:]), *FIXTURE_CONTRACTS[2:]]


def contracts(spark: SparkSession, rows_in=None) -> DataFrame:
    """The mapping's contract dimension in ``schemas.CONTRACTS`` layout."""
    rows = []
    for (side, lo, hi, ctype, e_basic, e_day, e_night, margin,
         t_basic, t_day, t_night, t_tax, tax) in (rows_in or FIXTURE_CONTRACTS):
        rows.append((side, lo, hi, ctype, tax, None, None, e_basic, e_day, e_night, margin,
                     None, None, None, t_basic, t_day, t_night, t_tax))
    return spark.createDataFrame(rows, schemas.CONTRACTS)


# Contracts over a year with both clock changes: night hours of their own (energy start, end; transfer start, end), no
# tax on negative prices, a time under type none. (… as above, energy start, end, transfer start, end, negative_no_tax)
CLOCK_CONTRACTS = [
    (1, _T(2023, 10, 1, 0, 0, 0), _T(2023, 11, 4, 21, 59, 59), 2, 4.5, 2.23, 1.23, None, 13.5, 3.34, 2.34, 2.35972, 24.0, 23, 6, 21, 8, None),
    (1, _T(2023, 11, 4, 22, 0, 0), _T(2023, 11, 8, 21, 59, 59), 1, 1.5, None, None, None, 13.5, 3.34, 2.34, 2.35972, 24.0, None, None, 20, 5, None),
    (1, _T(2023, 11, 8, 22, 0, 0), _T(2024, 3, 28, 21, 59, 59), 4, 5.5, 3.23, 2.23, None, 14.5, 4.34, 3.34, 2.35972, 10.0, 20, 5, None, None, None),
    (1, _T(2024, 3, 28, 22, 0, 0), _T(2024, 4, 7, 20, 59, 59), 3, 5.5, None, None, 0.25, 14.5, 4.34, 3.34, 2.35972, 24.0, 1, 4, 0, 3, True),
    (1, _T(2024, 4, 7, 21, 0, 0), None, 3, 5.5, None, None, 0.5, 14.5, 4.34, 3.34, 2.35972, 25.5, None, None, None, None, False),
    (6, _T(2023, 1, 1, 0, 0, 0), None, 3, 0.0, None, None, 0.3, 0.0, 0.07, 0.05, 0.0, 24.0, None, None, 21, 6, None),
]


def clock_contracts(spark: SparkSession) -> DataFrame:
    """``CLOCK_CONTRACTS`` in ``schemas.CONTRACTS`` layout."""
    rows = [(side, lo, hi, kind, tax, e_from, e_to, e_basic, e_day, e_night, margin, free, t_from, t_to, t_basic, t_day, t_night, t_tax)
            for (side, lo, hi, kind, e_basic, e_day, e_night, margin, t_basic, t_day, t_night, t_tax, tax,
                 e_from, e_to, t_from, t_to, free) in CLOCK_CONTRACTS]
    return spark.createDataFrame(rows, schemas.CONTRACTS)
