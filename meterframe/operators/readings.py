"""Reading cleanup: reject reasons, accepted rows, last-write-wins (O-9..O-11, SNK-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterframe.config import VALUE_LIMIT
from meterframe.schemas import ENERGY_KEY

REASON_NO_TIME = "no_time"
REASON_DST = "dst_ambiguous_or_missing"
REASON_NO_QUANTITY = "no_quantity"
REASON_OUT_OF_RANGE = "quantity_out_of_range"
REASON_NO_CONTRACT = "no_single_contract"
REASON_NO_TARIFF = "contract_type_none"


def reject_reason(df: DataFrame):
    """First failing check in the reference's order (time, then quantity)."""
    dst = F.col("dst_reject") if "dst_reject" in df.columns else F.lit(False)
    return (F.when(F.col("time").isNull(), F.lit(REASON_NO_TIME))
            .when(dst, F.lit(REASON_DST))
            .when(F.col("value").isNull(), F.lit(REASON_NO_QUANTITY))
            .when(~(F.abs(F.col("value")) < VALUE_LIMIT), F.lit(REASON_OUT_OF_RANGE)))


def accepted(df: DataFrame) -> DataFrame:
    """Readings that pass the time and quantity checks (O-9, O-10)."""
    return df.where(reject_reason(df).isNull())


def last_write_wins(df: DataFrame, key=ENERGY_KEY, order=("seq",)) -> DataFrame:
    """One row per key, the one written last (SNK-5).

    A ``max`` over a struct whose leading fields are the ordering columns is a
    plain aggregate: it is combined map-side before the shuffle, so a key with
    millions of copies never lands whole in one task.
    """
    payload = [c for c in df.columns if c not in key]
    ordered = list(order) + [c for c in payload if c not in order]
    latest = F.max(F.struct(*[F.col(c) for c in ordered])).alias("_latest")
    return df.groupBy(*key).agg(latest).select(*key, *[F.col(f"_latest.{c}").alias(c) for c in payload])


def load_version(df: DataFrame) -> list:
    """``load_time``, ``load_file`` of readings exploded from documents (ST-7); nothing for other readings."""
    kind = df.schema["seq"].dataType if "seq" in df.columns else None
    if not isinstance(kind, StructType) or "_file_time" not in kind.names:
        return []
    return [F.unix_micros(F.col("seq._file_time")).alias("load_time"), F.col("seq._file").alias("load_file")]
