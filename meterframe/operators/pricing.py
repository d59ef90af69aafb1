"""Spot-price lookups and the priced fact rows (J-2..J-5, O-16..O-23, SNK-1..3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.config import (
    MEASURE_CONSUMPTION, MEASURE_PRODUCTION, PRICE_DOCUMENT_TYPE, Settings,
)
from meterframe.functions import tariff
from meterframe.functions.timeutil import hour_start, local_hour
from meterframe.operators.contracts import attach_contract
from meterframe.operators.readings import accepted, last_write_wins, load_version

def price_duplicates(prices: DataFrame, summary: bool = False) -> DataFrame:
    """Times with more than one price row (J-4): a lookup there is ambiguous.

    ``summary=True`` gives one row: price rows, distinct times, duplicated times.
    """
    per_time = prices.groupBy("time").agg(F.count(F.lit(1)).alias("n_prices"))
    if summary:
        return per_time.agg(F.sum("n_prices").alias("n_price_rows"), F.count(F.lit(1)).alias("n_times"),
                            F.count_if(F.col("n_prices") > 1).alias("n_duplicate_times"))
    return per_time.where(F.col("n_prices") > 1)


#: Text of the error for a looked-up time with several prices (the reference's
#: scalar subquery fails there).
AMBIGUOUS_PRICE = "more than one day-ahead price for a looked-up time; see price_duplicates()"


def _lookup(prices: DataFrame, name: str) -> DataFrame:
    """One row per time; using a time with several prices is an error (J-4)."""
    one = prices.groupBy("time").agg(F.min("price").alias("p"), F.count(F.lit(1)).alias("n"))
    return one.select(F.col("time").alias(f"_{name}_t"), F.col("p").alias(f"_{name}_p"), F.col("n").alias(f"_{name}_n"))


def _used(name: str):
    return F.when(F.col(f"_{name}_n") > 1, F.raise_error(F.lit(AMBIGUOUS_PRICE)).cast("double")).otherwise(F.col(f"_{name}_p"))


def attach_spot_price(df: DataFrame, prices: DataFrame, *, hour_fallback: bool = True,
                      out: str = "spot_eur_mwh", time_col: str = "time") -> DataFrame:
    """Day-ahead price at the reading's time, else at its hour start (J-2, J-3).

    Left equi-joins on time, planned lazily: no job runs here and nothing is
    kept, so a price added later is seen by the next read. A reading whose
    lookup meets several prices fails the job (J-4); duplicates at times that
    no reading looks up do no harm.
    """
    res = df.join(_lookup(prices, "px"), F.col(time_col) == F.col("_px_t"), "left")
    price = _used("px")
    if hour_fallback:
        res = res.withColumn("_hour", hour_start(time_col)).join(
            _lookup(prices, "ph"), F.col("_hour") == F.col("_ph_t"), "left")
        price = F.coalesce(price, _used("ph"))
    return res.withColumn(out, price).select(*(F.col(f"`{c}`") for c in df.columns), out)


def a44_prices(price_points: DataFrame) -> DataFrame:
    """Point-form prices restricted to type A44, first row per time (SRC-7, SO-2).

    The first is taken by a combining aggregate, so many points of one time meet
    only as one partial row a task.
    """
    first = F.min(F.struct(F.col("timestamp").isNull().alias("last"), F.col("timestamp"), F.col("price")))
    return (price_points.where(F.col("type_tag") == PRICE_DOCUMENT_TYPE).groupBy("time").agg(first.alias("_first"))
            .select("time", F.col("_first.price").alias("price")))


def energy_rows(priced: DataFrame, settings: Settings = Settings(), extra: list | None = None) -> DataFrame:
    """Fact rows in ``schemas.ENERGIES`` layout from readings joined with a
    contract and a spot price.

    Column ownership per writer (SNK-1..3): production writes the margin but
    no energy fee and no night flag; consumption fixed/hybrid writes the fixed
    fee and night flag but no margin; consumption spot writes margin and night
    flag but no energy fee.
    """
    ct = F.col("contract_type")
    consumption = F.col("measure_type") == MEASURE_CONSUMPTION
    fixed_like = ct.isin(*tariff.FIXED_LIKE)
    hour = local_hour("time", settings.tz)
    return priced.withColumn("_lh", hour).select(
        "time", "metering_point_code", "measure_type",
        ct.cast("short").alias("contract_type"),
        F.lit(settings.source).alias("source"),
        "measure_unit", "value", "energy_basic_fee",
        F.when(consumption & fixed_like, tariff.energy_fee_fixed("_lh")).alias("energy_fee"),
        F.when(~consumption | (ct == tariff.SPOT), tariff.energy_margin()).alias("energy_margin"),
        "transfer_basic_fee",
        tariff.transfer_fee("_lh").alias("transfer_fee"),
        "transfer_tax_fee",
        tariff.tax_percentage().alias("tax_percentage"),
        F.when(consumption, tariff.energy_night("_lh")).otherwise(F.lit(False)).alias("night"),
        "resolution_duration",
        (F.col("spot_eur_mwh") / 10).alias("spot_price"),
        *(extra or []),
    )


def priceable(readings: DataFrame, contracts, settings: Settings = Settings()) -> DataFrame:
    """Accepted readings, last write per key, with their single contract.

    The contract valid for a reading depends only on ``(measure_type, time)``,
    both part of the key, so collapsing duplicates first is equivalent to the
    reference's order and keeps the shuffled rows narrow.  Consumption under
    contract type *none* is not priceable (D5) and left out.
    """
    ok = accepted(readings).select("time", "metering_point_code", "measure_type",
                                   "resolution_duration", "value", "measure_unit", "seq")
    matched = attach_contract(last_write_wins(ok), contracts, settings)
    return matched.where(~((F.col("measure_type") == MEASURE_CONSUMPTION)
                           & (F.col("contract_type") == tariff.NONE)))


def build_energies(readings: DataFrame, contracts: DataFrame, prices: DataFrame,
                   settings: Settings = Settings(), versions: bool = False) -> DataFrame:
    """Readings → priced ``energies`` rows; with ``versions`` also the load that each row came with."""
    rows = priceable(readings, contracts, settings)
    priced = attach_spot_price(rows, prices)
    return energy_rows(priced, settings, load_version(priced) if versions else None)


def wide_points(readings: DataFrame, contracts: DataFrame, prices: DataFrame, side: int,
                raw_resolution: str | None = None, skip_quarter: bool = False,
                settings: Settings = Settings(), versions: bool = False) -> DataFrame:
    """Denormalised priced points for one side (SNK-7/8, O-12..O-15, J-5).

    Price is the exact-time price or 0.0 (no hour fallback), in EUR/kWh; given
    price points (with ``type_tag``), the first A44 point of a time counts. The
    energy fee follows the full dispatch (O-21) including ``negative_no_tax``.
    """
    from meterframe.config import RESOLUTION_HOUR, RESOLUTION_QUARTER
    from meterframe.functions.timeutil import utc_text

    r = readings.where(F.col("measure_type") == side)
    if skip_quarter:
        r = r.where(F.col("resolution_duration") != RESOLUTION_QUARTER)
    keep = ["time", "metering_point_code", "measure_type", "resolution_duration", "value",
            "measure_unit", "seq"] + (["raw_resolution"] if "raw_resolution" in r.columns else [])
    latest = attach_contract(last_write_wins(accepted(r).select(*keep)), contracts, settings)
    if "type_tag" in prices.columns:
        prices = a44_prices(prices)
    priced = attach_spot_price(latest, prices, hour_fallback=False)
    spot = F.coalesce(F.col("spot_eur_mwh"), F.lit(0.0))
    hour = local_hour("time", settings.tz)
    raw = F.col("raw_resolution") if "raw_resolution" in latest.columns else F.col("resolution_duration")
    tag = F.when(F.col("resolution_duration") == RESOLUTION_HOUR, F.lit(None).cast("string")).otherwise(raw)
    mtype = F.lit(str(side))
    spot_margin = F.col("energy_margin") if side == MEASURE_CONSUMPTION else F.lit(None).cast("double")
    return priced.withColumn("_lh", hour).select(
        "time",
        F.col("metering_point_code").alias("meteringpointcode_tag"),
        mtype.alias("measurementtype_tag"),
        tag.alias("resolution_duration_tag"),
        F.col("metering_point_code").alias("meteringpointcode"),
        mtype.alias("measurementtype"),
        tag.alias("resolution_duration"),
        F.col("measure_unit").alias("unit"),
        utc_text("time").alias("timestamp"),
        "value",
        (spot / 1000.0).alias("price"),
        "transfer_basic_fee",
        tariff.transfer_fee("_lh").alias("transfer_fee"),
        F.col("transfer_tax_fee").alias("tax_fee"),
        F.col("energy_basic_fee").alias("basic_fee"),
        tariff.energy_fee("contract_type", spot, "_lh").alias("energy_fee"),
        F.col("contract_type").cast("short").alias("contract_type"),
        spot_margin.alias("spot_margin"),
        tariff.tax_percentage().alias("tax_percentage"),
        *(load_version(priced) if versions else []),
    )
