"""The ``energies`` fact table: partitioned Parquet with a keyed merge (SNK-1..SNK-6, SNK-10, SNK-13, SNK-14, ST-7).

Layout: one folder per local day (``day=yyyy-MM-dd``), so the scheduled load
touches one partition and a backfill the days it covers.  A merge reads only
the touched partitions (partition pruning on ``day``), combines them with the
batch in a full outer join on the key, and publishes the result all or nothing
(``sinks.publish``): NOT NULL, length and key rules are counted by the job that
stages it, and a batch that breaks one leaves the table as it was.

Each fact keeps the version of the load that wrote it (``load_time``,
``load_file``: when its document's file was written, and its path).  A reading
from an older file that is processed later does not overwrite a newer one.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe.config import DEFAULT_TZ, MEASURE_CONSUMPTION, MEASURE_UNIT_MAX, RESOLUTION_MAX
from meterframe.functions import tariff
from meterframe.functions.timeutil import ntz_lit, utc_to_local
from meterframe.operators.quality import NOT_NULL, apply_defaults, backfill_resolution
from meterframe.operators.readings import last_write_wins
from meterframe.schemas import ENERGIES, ENERGY_COLUMNS, ENERGY_KEY, LOAD_VERSION
from meterframe.sinks.publish import Publisher

PARTITION = "day"
# Time first: a day's rows share row groups, so time-range filters prune them.
_SORT = ["time", "metering_point_code"]
_VALUES = [c for c in ENERGY_COLUMNS if c not in ENERGY_KEY]
_VERSION = [f.name for f in LOAD_VERSION.fields]
_STORED = [*ENERGY_COLUMNS, *_VERSION]
_COPIES = "_copies"


def day_of(time: Column, tz: str = DEFAULT_TZ) -> Column:
    """Local calendar day as ``yyyy-MM-dd`` text (the partition value)."""
    return F.date_format(utc_to_local(time, tz), "yyyy-MM-dd")


def ownership(measure_type: Column, contract_type: Column) -> dict[str, Column]:
    """Columns a writer sets on conflict, by writer variant (SNK-1..SNK-4).

    Production sets the margin but not the energy fee or the night flag;
    consumption fixed/hybrid sets fee and night but not the margin;
    consumption spot sets margin and night but not the fee.  Every other
    column is always set.
    """
    consumption = measure_type == MEASURE_CONSUMPTION
    return {
        "energy_fee": consumption & contract_type.isin(*tariff.FIXED_LIKE),
        "energy_margin": ~consumption | (contract_type == tariff.SPOT),
        "night": consumption,
    }


_INSERT_DEFAULTS = {"energy_fee": None, "energy_margin": None, "night": False}


def rules() -> dict[str, Column]:
    """What no stored row may show: a NULL or an overlong text where the table has none (SNK-13), a second row of its
    key (SNK-12; ``_copies`` is the number of the batch's rows with the key)."""
    found = {f"null_{c}": F.col(c).isNull() for c in NOT_NULL}
    found["long_measure_unit"] = F.length("measure_unit") > MEASURE_UNIT_MAX
    found["long_resolution_duration"] = F.length("resolution_duration") > RESOLUTION_MAX
    found["duplicate_key"] = F.col(_COPIES) > 1
    return found


def _versioned(rows: DataFrame) -> DataFrame:
    """The stored columns of ``rows``; a batch without load versions gets none."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in LOAD_VERSION.fields if f.name not in rows.columns}
    return rows.withColumns(missing).select(*_STORED) if missing else rows.select(*_STORED)


def _version(prefix: str) -> Column:
    return F.struct(F.col(f"{prefix}load_time"), F.coalesce(F.col(f"{prefix}load_file"), F.lit("")))


def merge_rows(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert ``batch`` into ``existing`` on the 4-column key.

    A column the writer does not own keeps the stored value on conflict and
    takes the column default on insert.  A batch row of an older load than the
    stored one (both versions known) changes nothing, but for a fee or margin
    that no load has written yet: the older load would have left it there.
    """
    carried = [_COPIES] if _COPIES in batch.columns else []
    o = existing.select(*[F.col(c).alias(f"o_{c}") for c in _STORED])
    n = batch.select(*[F.col(c).alias(f"n_{c}") for c in _STORED], *carried)
    cond = [o[f"o_{k}"] == n[f"n_{k}"] for k in ENERGY_KEY]
    # A batch row with a NULL key column meets no stored row and goes on to the rules.
    j = o.withColumn("_old", F.lit(True)).join(n.withColumn("_new", F.lit(True)), cond, "full_outer")
    older = (F.col("_old").isNotNull() & F.col("n_load_time").isNotNull() & F.col("o_load_time").isNotNull()
             & (_version("n_") < _version("o_")))
    has_new = F.col("_new").isNotNull() & ~F.coalesce(older, F.lit(False))
    owns = ownership(F.col("n_measure_type"), F.col("n_contract_type"))
    out = [F.coalesce(F.col(f"n_{k}"), F.col(f"o_{k}")).alias(k) for k in ENERGY_KEY]
    for c in [*_VALUES, *_VERSION]:
        new, old = F.col(f"n_{c}"), F.col(f"o_{c}")
        if c in owns:
            default = F.lit(_INSERT_DEFAULTS[c]).cast(ENERGIES[c].dataType)
            kept = F.coalesce(old, default) if _INSERT_DEFAULTS[c] is not None else old
            value = F.when(has_new & owns[c], new).when(has_new, kept).when(owns[c], F.coalesce(old, new)).otherwise(old)
        else:
            value = F.when(has_new, new).otherwise(old)
        out.append(value.alias(c))
    return j.select(*out, *carried)


def prepare_batch(rows: DataFrame, order=("seq",)) -> DataFrame:
    """Last write per key inside one batch (SNK-5)."""
    if all(c in rows.columns for c in order):
        rows = last_write_wins(rows.select(*ENERGY_COLUMNS, *order), order=order)
    return rows.select(*ENERGY_COLUMNS)


class EnergiesTable:
    """Partitioned Parquet ``energies`` at ``path``."""

    def __init__(self, spark: SparkSession, path: str, tz: str = DEFAULT_TZ):
        self.spark, self.path, self.tz = spark, path.rstrip("/"), tz

    def _with_partition(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PARTITION, day_of(F.col("time"), self.tz))

    @property
    def publisher(self) -> Publisher:
        return Publisher(self.spark, self.path, [PARTITION])

    def recover(self) -> None:
        """Finish or discard a batch that an ended job left behind."""
        self.publisher.recover()

    def create(self, rows: DataFrame | None = None) -> "EnergiesTable":
        """Create (or replace) the table, optionally with initial rows (SNK-10); these may lack a resolution (SNK-11)."""
        df = apply_defaults(rows) if rows is not None else self.spark.createDataFrame([], ENERGIES)
        kept = {k: v for k, v in rules().items() if k not in ("null_resolution_duration", "duplicate_key")}
        self.publisher.replace(self._with_partition(_versioned(df)), _SORT, kept, keep_rest=False)
        return self

    def read(self, with_partition: bool = False, time_from=None, time_to=None) -> DataFrame:
        """Facts, optionally of a closed UTC range: only the range's day folders are opened."""
        df = self._stored()
        for bound, inside in ((time_from, Column.__ge__), (time_to, Column.__le__)):
            if bound is not None:
                df = df.where(inside(F.col("time"), ntz_lit(bound)) &
                              inside(F.col(PARTITION), day_of(ntz_lit(bound), self.tz)))
        return df.select(*ENERGY_COLUMNS, PARTITION) if with_partition else df.select(*ENERGY_COLUMNS)

    def _stored(self) -> DataFrame:
        """Facts with their load versions; the schema is given, so that an empty table can be read."""
        fields = [*ENERGIES.fields, *LOAD_VERSION.fields, T.StructField(PARTITION, T.StringType())]
        return self.spark.read.schema(T.StructType(fields)).parquet(self.path)

    def merge(self, batch: DataFrame) -> list[str]:
        """Upsert one batch; only the partitions it touches are read and rewritten.

        The batch is persisted once; its local days (bounded by the batch's
        time span) become a static partition filter on the table scan.
        Returns those days (``yyyy-MM-dd``) for the roll-up refresh.  Raises
        ``RejectedBatch`` and changes nothing if a row breaks a rule.
        """
        self.recover()  # before the table is read
        copies = F.count(F.lit(1)).over(Window.partitionBy(*ENERGY_KEY))
        b = self._with_partition(_versioned(batch)).withColumn(_COPIES, copies).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = [r[0] for r in b.select(PARTITION).distinct().collect()]  # bounded by the batch span
            if not found:
                return []
            days = sorted(d for d in found if d is not None)
            slice_ = self._stored().where(F.col(PARTITION).isin(days))
            merged = self._with_partition(merge_rows(slice_, b))
            self.publisher.replace(merged, _SORT, rules())
            return days
        finally:
            b.unpersist()

    def backfill_resolution(self) -> None:
        """Rewrite rows without a resolution as hourly (SNK-11), in the days that hold such rows."""
        self.recover()
        rows = self._stored()
        days = [r[0] for r in rows.where(F.col("resolution_duration").isNull()).select(PARTITION).distinct().collect()]
        if days:
            old = rows.where(F.col(PARTITION).isin(days))
            self.publisher.replace(backfill_resolution(old), _SORT)
