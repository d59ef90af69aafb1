"""Daily cost report over the consumption day roll-up (R-1, O-32, O-33, SO-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.functions.timeutil import ntz_lit


def daily_report(day_rollup: DataFrame, date_from=None, date_to=None,
                 metering_point_code: str | None = None) -> DataFrame:
    """Date, consumption and money columns in EUR, closed date range, ascending.

    The dashboard's source columns map onto the day roll-up as SURVEY §2.8.
    Rows are sorted by date, then meter, so a day's meters are spread over
    several sort tasks.
    """
    d = day_rollup
    if metering_point_code is not None:
        d = d.where(F.col("metering_point_code") == metering_point_code)
    if date_from is not None:
        d = d.where(F.col("time") >= ntz_lit(date_from))
    if date_to is not None:
        d = d.where(F.col("time") <= ntz_lit(date_to))
    spot_avg = F.when(F.col("energy_consumption") != 0,
                      F.col("energy_fee_spot_no_margin") / F.col("energy_consumption"))
    return d.select(
        F.col("time").alias("date"),
        F.col("energy_consumption").alias("consumption"),
        (F.col("energy_fee") / 100).alias("energy_cost_eur"),
        (F.col("energy_fee_spot_no_margin") / 100).alias("spot_cost_no_margin_eur"),
        (F.col("energy_fee_avg") / 100).alias("avg_energy_price_eur"),
        (spot_avg / 100).alias("avg_spot_price_no_margin_eur"),
    ).orderBy("date", d["metering_point_code"])
