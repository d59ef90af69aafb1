"""Roll-up invariants."""

import pytest
from pyspark.sql import functions as F

from meterframe.config import Settings
from meterframe.operators.rollups import rollup, rollup_columns
from meterframe.plans import catalog
from meterframe.session import work_path
from meterframe.sinks.energies_table import EnergiesTable
from meterframe.sinks.rollup_store import RollupStore


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def energies(spark, sf_small):
    return catalog.energies(spark, sf_small).checkpoint()


def test_columns_and_night_day_total(spark, energies):
    for side in ("consumption", "production"):
        r = rollup(energies, side, "day")
        assert r.columns == rollup_columns(side) and len(r.columns) == 39
        e = "energy_consumption" if side == "consumption" else "energy_production"
        bad = r.where(F.abs(F.col(f"{e}_night") + F.col(f"{e}_day") - F.col(e)) > 2e-5).count()
        assert bad == 0


def test_independent_of_partitioning_and_zone(spark, energies):
    base = _rows(rollup(energies, "consumption", "hour"))
    prev_p = spark.conf.get("spark.sql.shuffle.partitions")
    prev_z = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert _rows(rollup(energies, "consumption", "hour")) == base
        assert _rows(rollup(energies, "production", "month")) == _rows(
            rollup(energies.repartition(5), "production", "month"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev_p)
        spark.conf.set("spark.sql.session.timeZone", prev_z)


def test_incremental_refresh_equals_full(spark, energies):
    table = EnergiesTable(spark, work_path(spark, "test-inc"))
    first = energies.where(F.col("time") < F.lit("2023-12-31 22:00:00").cast("timestamp_ntz"))
    second = energies.where(F.col("time") >= F.lit("2023-12-31 22:00:00").cast("timestamp_ntz"))
    table.create(first)
    inc = RollupStore(spark, work_path(spark, "test-inc-rollups"))
    inc.refresh_full(table.read())
    days = table.merge(second)
    assert days[0].startswith("2024-01") and len(days) > 1
    inc.refresh_days(table.read(with_partition=True), days)
    full = RollupStore(spark, work_path(spark, "test-full-rollups"))
    full.refresh_full(table.read())
    for side in ("consumption", "production"):
        for grain in ("15min", "hour", "day", "month", "year"):
            assert _rows(inc.read(side, grain)) == _rows(full.read(side, grain)), (side, grain)


def test_chained_equals_direct(spark, energies):
    from meterframe.operators.rollups import chained_rollups
    chained = chained_rollups(energies)  # no persistence: plain lazy frames
    for side in ("consumption", "production"):
        for grain in ("15min", "hour", "day", "month", "year"):
            assert _rows(chained[f"{side}_{grain}"]) == _rows(rollup(energies, side, grain)), (side, grain)


def test_refetch_refresh_in_a_half_hour_zone(spark, energies):
    """Rows of the same days, months and years come in two batches; hours cross local midnight."""
    s = Settings(tz="Asia/Kolkata")
    late = F.pmod(F.xxhash64("time", "metering_point_code"), F.lit(40)) == 0
    table = EnergiesTable(spark, work_path(spark, "test-half"), s.tz).create(energies.where(~late))
    inc = RollupStore(spark, work_path(spark, "test-half-rollups"), s)
    inc.refresh_full(table.read())
    days = table.merge(energies.where(late).withColumn("value", F.col("value") * 2))
    inc.refresh_days(table.read(with_partition=True), days)
    full = RollupStore(spark, work_path(spark, "test-half-full"), s)
    full.refresh_full(table.read())
    for grain in ("15min", "hour", "day", "month", "year"):
        assert _rows(inc.read("consumption", grain)) == _rows(full.read("consumption", grain)), grain


def test_rebuild_replaces_whatever_the_overwrite_mode(spark, energies):
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        one = energies.where(F.to_date("time") == F.lit("2024-01-05"))
        table = EnergiesTable(spark, work_path(spark, "test-rebuild")).create(energies)
        store = RollupStore(spark, work_path(spark, "test-rebuild-rollups"))
        store.refresh_full(table.read())
        table.create(one)
        store.refresh_full(table.read())
        assert table.read().count() == one.count()
        assert _rows(store.read("consumption", "day")) == _rows(rollup(one, "consumption", "day"))
        store.refresh_full(table.read().limit(0))
        assert store.read("consumption", "hour").count() == 0
    finally:
        spark.conf.set(key, before)


def test_range_reads_open_only_their_days(spark, energies):
    import contextlib
    import datetime as dt
    import io

    table = EnergiesTable(spark, work_path(spark, "test-range")).create(energies)
    lo, hi = dt.datetime(2024, 1, 4, 23), dt.datetime(2024, 1, 5, 12)
    got = table.read(time_from=lo, time_to=hi)
    want = energies.where((F.col("time") >= F.lit(str(lo)).cast("timestamp_ntz")) & (F.col("time") <= F.lit(str(hi)).cast("timestamp_ntz")))
    assert got.count() == want.count() > 0
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        got.explain()
    assert "PartitionFilters: [isnotnull(day" in out.getvalue()
