"""Contract validity: elementary segments, the range join, checks (J-1, W-1..W-3)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterframe.config import CONTRACT_TYPE_CODES, Settings
from meterframe.schemas import CONTRACT_ATTRS


def _micro():
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001))


def _second():
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1))


def numbered(contracts: DataFrame) -> DataFrame:
    """Give every contract a stable number within its side."""
    w = Window.partitionBy("side").orderBy("valid_from", F.col("valid_to").asc_nulls_last(),
                                          "contract_type")
    return contracts.withColumn("contract_no", F.row_number().over(w).cast("long"))


def segments(contracts: DataFrame) -> DataFrame:
    """Split the timeline into pieces covered by exactly one contract.

    A sweep over start (+1) and exclusive-end (-1) boundaries gives the number
    of contracts covering each elementary piece; where it is one, the running
    sum of signed contract numbers is that contract's number.  The closed end
    ``valid_to`` becomes the exclusive bound ``valid_to + 1 µs``.  A contract
    without a parsable start matches nothing.  Output: ``side, seg_from,
    seg_to`` (NULL = open), ``contract_no`` and the contract attributes.
    """
    c = numbered(contracts.where(F.col("valid_from").isNotNull()))
    c = c.withColumn("_to_excl", F.col("valid_to") + _micro())
    c = c.where(F.col("_to_excl").isNull() | (F.col("_to_excl") > F.col("valid_from")))
    starts = c.select("side", F.col("valid_from").alias("at"), F.lit(1).alias("d"),
                      F.col("contract_no").alias("s"))
    ends = c.where(F.col("_to_excl").isNotNull()).select(
        "side", F.col("_to_excl").alias("at"), F.lit(-1).alias("d"), (-F.col("contract_no")).alias("s"))
    points = starts.unionByName(ends).groupBy("side", "at").agg(
        F.sum("d").alias("d"), F.sum("s").alias("s"))
    w = Window.partitionBy("side").orderBy("at")
    sweep = points.select(
        "side", F.col("at").alias("seg_from"), F.lead("at").over(w).alias("seg_to"),
        F.sum("d").over(w).alias("cover"), F.sum("s").over(w).alias("contract_no"))
    single = sweep.where(F.col("cover") == 1)
    return single.join(c.select("side", "contract_no", *CONTRACT_ATTRS), ["side", "contract_no"]) \
        .select("side", "seg_from", "seg_to", "contract_no", *CONTRACT_ATTRS)


class ContractTable:
    """Segments of a contract dimension, kept from their first use until ``release``.

    The dimension is configuration (a contract history per side, as in the
    reference), so the sweep's windows run per side.  No job runs here; a lost
    block is recomputed from lineage.
    """

    def __init__(self, contracts: DataFrame):
        self.segments = segments(contracts).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        self.segments.unpersist()


def _segments_of(contracts) -> DataFrame:
    """A kept table's segments, or those of a plain DataFrame, planned where they are used."""
    return contracts.segments if isinstance(contracts, ContractTable) else segments(contracts)


def _day(ts):
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.lit(0), F.lit(0), F.lit(0))


def attach_contract(readings: DataFrame, contracts, settings: Settings = Settings(),
                    how: str = "inner", time_col: str = "time", attrs: bool = True) -> DataFrame:
    """Range join of readings to the single contract valid at their time (J-1).

    ``how='inner'`` keeps matched readings with the contract attributes
    (``attrs=False``: only ``contract_type``); ``how='left'`` keeps unmatched
    readings with NULL attributes; ``how='left_anti'`` returns
    readings with no or several contracts (O-11).

    Segments that end are keyed by (side, UTC day) and joined by hash, so a
    reading meets only the segments of its day however long the history is;
    segments of a side never overlap, so their days add up to the covered span.
    At most one segment of a side is open: it is held against the rest.
    """
    segs = _segments_of(contracts)
    cols = list(CONTRACT_ATTRS) if attrs else ["contract_type"]
    span = ["side", "seg_from", "seg_to"]
    days = F.sequence(_day(F.col("seg_from")), _day(F.col("seg_to") - _micro()), F.make_dt_interval(F.lit(1)))
    ended = (segs.where(F.col("seg_to").isNotNull())
             .select(*(F.col(c).alias(f"_c_{c}") for c in span), F.struct(*cols).alias("_c"), F.explode(days).alias("_c_day")))
    still = (segs.where(F.col("seg_to").isNull())
             .select(F.col("side").alias("_o_side"), F.col("seg_from").alias("_o_from"), F.struct(*cols).alias("_o")))
    t = F.col(time_col)
    out = readings.join(ended, (F.col("measure_type") == F.col("_c_side")) & (_day(t) == F.col("_c_day"))
                        & (t >= F.col("_c_seg_from")) & (t < F.col("_c_seg_to")), "left")
    # One row a side at most.
    out = out.join(F.broadcast(still), (F.col("measure_type") == F.col("_o_side")) & (t >= F.col("_o_from")), "left")
    found = F.coalesce(F.col("_c"), F.col("_o"))
    if how == "left_anti":
        return out.where(found.isNull()).select(*(F.col(f"`{c}`") for c in readings.columns))
    if how == "inner":
        out = out.where(found.isNotNull())
    return out.withColumn("_f", found).select(*(F.col(f"`{c}`") for c in readings.columns), *(F.col(f"_f.{c}") for c in cols))


def violations(contracts: DataFrame) -> DataFrame:
    """Timeline checks per side (W-1, W-3): overlap, gap, open end not last.

    Neighbours in start order must satisfy ``end + 1 s == next start``.
    """
    w = Window.partitionBy("side").orderBy("valid_from")
    c = contracts.select("side", "valid_from", "valid_to",
                         F.lead("valid_from").over(w).alias("next_from"))
    has_next = F.col("next_from").isNotNull()
    problem = (F.when(has_next & F.col("valid_to").isNull(), F.lit("open_end_not_last"))
               .when(has_next & (F.col("valid_to") >= F.col("next_from")), F.lit("overlap"))
               .when(has_next & ((F.col("valid_to") + _second()) != F.col("next_from")), F.lit("gap")))
    return c.withColumn("problem", problem).where(F.col("problem").isNotNull())


def fee_violations(contracts: DataFrame) -> DataFrame:
    """Fee completeness (W-2): fixed/hybrid need day and night fees, spot a margin."""
    ct = F.col("contract_type")
    fixed_like = ct.isin(CONTRACT_TYPE_CODES["fixed"], CONTRACT_TYPE_CODES["hybrid"])
    problem = (F.when(fixed_like & (F.col("energy_day_fee").isNull() | F.col("energy_night_fee").isNull()),
                      F.lit("fixed_without_day_or_night_fee"))
               .when((ct == CONTRACT_TYPE_CODES["spot"]) & F.col("energy_margin").isNull(),
                     F.lit("spot_without_margin")))
    return (contracts.select("side", "valid_from", "valid_to", "contract_type", problem.alias("problem"))
            .where(F.col("problem").isNotNull()))
