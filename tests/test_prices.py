"""Day-ahead price sources and lookups (SRC-6, SRC-7, J-2..J-5)."""

import datetime as dt

import pytest

from meterframe.operators.pricing import AMBIGUOUS_PRICE, attach_spot_price
from meterframe.schemas import PRICE_POINTS, PRICES
from meterframe.session import work_path
from meterframe.sources.prices import point_prices, read_day_ahead_prices, read_price_points

H = dt.datetime(2024, 1, 1, 10)


def _point(t, type_tag, stamp, price):
    return (t, type_tag, "X", "X", type_tag, "X", "X", "EUR", "MWH", "A01", stamp, price, None)


def test_point_prices_a44_first_row(spark):
    rows = [_point(H, "A44", "2024-01-01T09:00Z", 50.0), _point(H, "A44", "2024-01-01T09:30Z", 55.0),
            _point(H, "A65", "2024-01-01T08:00Z", 99.0)]
    path = work_path(spark, "test-points")
    spark.createDataFrame(rows, PRICE_POINTS).write.parquet(path)
    got = [tuple(r) for r in point_prices(read_price_points(spark, path)).collect()]
    assert got == [(H, 50.0)]


def test_exact_then_hour_fallback_and_duplicates(spark):
    path = work_path(spark, "test-prices")
    spark.createDataFrame([(H, 40.0), (H + dt.timedelta(minutes=15), 80.0)], PRICES).write.parquet(path)
    prices = read_day_ahead_prices(spark, path)
    times = [H, H + dt.timedelta(minutes=15), H + dt.timedelta(minutes=30), H + dt.timedelta(hours=1)]
    readings = spark.createDataFrame([(t,) for t in times], "time timestamp_ntz")
    got = {r.time: r.p for r in attach_spot_price(readings, prices, out="p").collect()}
    assert got == {times[0]: 40.0, times[1]: 80.0, times[2]: 40.0, times[3]: None}
    wide = {r.time: r.p for r in attach_spot_price(readings, prices, hour_fallback=False, out="p").collect()}
    assert wide[times[2]] is None
    dup = prices.unionByName(spark.createDataFrame([(H, 41.0)], PRICES))
    with pytest.raises(Exception, match=AMBIGUOUS_PRICE[:30]):
        attach_spot_price(readings, dup).collect()
    # A duplicate at a time that no reading looks up does no harm.
    unused = prices.unionByName(spark.createDataFrame([(H - dt.timedelta(hours=3), 1.0)] * 2, PRICES))
    assert {r.time: r.p for r in attach_spot_price(readings, unused, out="p").collect()} == got


def test_new_price_file_is_seen(spark):
    path = work_path(spark, "test-prices-new")
    readings = spark.createDataFrame([(H,)], "time timestamp_ntz")
    spark.createDataFrame([(H + dt.timedelta(hours=5), 1.0)], PRICES).write.parquet(path)
    assert attach_spot_price(readings, read_day_ahead_prices(spark, path), out="p").first().p is None
    spark.createDataFrame([(H, 7.0)], PRICES).write.mode("append").parquet(path)
    assert attach_spot_price(readings, read_day_ahead_prices(spark, path), out="p").first().p == 7.0
