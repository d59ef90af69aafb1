"""Table checks and repairs for ``energies`` (SNK-11..SNK-14, J-4, O-9..O-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.config import MEASURE_CONSUMPTION, MEASURE_UNIT_MAX, RESOLUTION_HOUR, RESOLUTION_MAX, TAX_PERCENTAGE, Settings
from meterframe.functions import tariff
from meterframe.operators.contracts import attach_contract
from meterframe.operators.readings import REASON_NO_CONTRACT, REASON_NO_TARIFF, reject_reason
from meterframe.schemas import ENERGY_KEY

NOT_NULL = ("time", "metering_point_code", "measure_type", "contract_type", "measure_unit",
            "tax_percentage", "night", "resolution_duration")


def key_check(energies: DataFrame, key=ENERGY_KEY) -> DataFrame:
    """One row: rows, distinct keys, keys held more than once (SNK-12)."""
    per_key = energies.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
                       F.count_if(F.col("n") > 1).alias("n_duplicate_keys"))


def null_check(energies: DataFrame) -> DataFrame:
    """One pass of NOT NULL and length checks (SNK-13)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in NOT_NULL]
    aggs += [F.count_if(F.length("measure_unit") > MEASURE_UNIT_MAX).alias("long_measure_unit"),
             F.count_if(F.length("resolution_duration") > RESOLUTION_MAX).alias("long_resolution_duration")]
    return energies.agg(*aggs)


def backfill_resolution(energies: DataFrame) -> DataFrame:
    """Rows written before the resolution column existed are hourly (SNK-11)."""
    return energies.withColumn("resolution_duration",
                               F.coalesce(F.col("resolution_duration"), F.lit(RESOLUTION_HOUR)))


def apply_defaults(energies: DataFrame) -> DataFrame:
    """Column defaults on insert: tax 24 %, night false (SNK-14)."""
    return (energies.withColumn("tax_percentage", F.coalesce(F.col("tax_percentage"), F.lit(TAX_PERCENTAGE)))
            .withColumn("night", F.coalesce(F.col("night"), F.lit(False))))


def tagged(readings: DataFrame, contracts, settings: Settings = Settings()) -> DataFrame:
    """All readings with the reason they are rejected for, or none (O-9, O-10, O-11), in one scan.

    Time and quantity checks come first, as in the reference.  A left range
    join against the single-cover segments finds readings with no or several
    contracts, and consumption under contract type *none* (D5); a reading matches at most one segment, so nothing fans out.
    """
    early = reject_reason(readings)
    joined = attach_contract(readings.withColumn("_early", early), contracts, settings, how="left", attrs=False)
    reason = F.coalesce(F.col("_early"), F.when(F.col("contract_type").isNull(), F.lit(REASON_NO_CONTRACT)).when(
        (F.col("measure_type") == MEASURE_CONSUMPTION) & (F.col("contract_type") == tariff.NONE), F.lit(REASON_NO_TARIFF)))
    return joined.withColumn("reason", reason).drop("_early", "contract_type")


def rejects(readings: DataFrame, contracts, settings: Settings = Settings()) -> DataFrame:
    """Rejected readings with their reason."""
    return tagged(readings, contracts, settings).where(F.col("reason").isNotNull())


def rejects_by_reason(readings: DataFrame, contracts, settings: Settings = Settings()) -> DataFrame:
    return (rejects(readings, contracts, settings).groupBy("measure_type", "reason")
            .agg(F.count(F.lit(1)).alias("n_rows")))
