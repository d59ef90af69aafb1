"""Time goldens and zone handling."""

import datetime as dt

from pyspark.sql import functions as F

from meterframe.functions import timeutil as T


def _one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_elapsed_hours_over_dst(spark):
    # 2022-03-01 00:00 local + 627 h = 2022-03-27 01:00Z
    start = T.local_text_to_utc(F.lit("2022-03-01T00:00:00"))
    assert _one(spark, T.add_steps(start, F.lit(627), 60)) == dt.datetime(2022, 3, 27, 1, 0)


def test_dst_gap_and_overlap(spark):
    gap = T.parse_local(F.lit("2022-03-27T03:00:00"))
    assert _one(spark, T.dst_gap(gap)) is True
    amb = T.parse_local(F.lit("2023-10-29T03:30:00"))
    assert _one(spark, T.dst_overlap(amb)) is True
    ok = T.parse_local(F.lit("2023-10-29T05:30:00"))
    assert _one(spark, T.dst_gap(ok)) is False
    assert _one(spark, T.dst_overlap(ok)) is False


def test_strict_parse(spark):
    assert _one(spark, T.parse_local(F.lit("2022-08-01"))) is None
    assert _one(spark, T.parse_local(F.lit("2022-08-01T00:00:00+02:00"))) is None
    assert _one(spark, T.parse_local(F.lit("2022-02-30T00:00:00"))) is None
    assert _one(spark, T.parse_local(F.lit("2022-08-01T00:00:00"))) == dt.datetime(2022, 8, 1)


def test_header_start_stop(spark):
    # P1: header start / stop → UTC
    assert _one(spark, T.local_text_to_utc(F.lit("2022-08-01T00:00:00"))) == dt.datetime(2022, 7, 31, 21, 0)
    assert _one(spark, T.local_text_to_utc(F.lit("2022-09-01T00:00:00"))) == dt.datetime(2022, 8, 31, 21, 0)


def test_buckets_independent_of_session_zone(spark):
    t = T.ntz_lit(dt.datetime(2024, 3, 31, 1, 37))
    prev = spark.conf.get("spark.sql.session.timeZone")
    got = []
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got.append(spark.range(1).select(T.quarter_start(t), T.hour_start(t), T.local_day_start(t),
                                         T.local_month_start(t), T.local_year_start(t), T.local_hour(t)).first())
    spark.conf.set("spark.sql.session.timeZone", prev)
    assert got[0] == got[1] == got[2]
    q, h, d, m, y, lh = got[0]
    assert q == dt.datetime(2024, 3, 31, 1, 30) and h == dt.datetime(2024, 3, 31, 1, 0)
    assert d == dt.datetime(2024, 3, 30, 22, 0)          # local midnight, still UTC+2
    assert m == dt.datetime(2024, 2, 29, 22, 0) and y == dt.datetime(2023, 12, 31, 22, 0)
    assert lh == 4                                        # 01:37Z is 04:37 summer time


def test_load_range_fixed_now(spark):
    from meterframe.plans.jobs import load_range
    cases = [(dt.datetime(2024, 3, 31, 3, 30), ("2024-03-30T00:00:00", "2024-03-31T00:00:00")),   # 06:30 EEST
             (dt.datetime(2023, 10, 28, 21, 30), ("2023-10-28T00:00:00", "2023-10-29T00:00:00")),  # 00:30 local
             (dt.datetime(2024, 1, 1, 4, 0), ("2023-12-31T00:00:00", "2024-01-01T00:00:00"))]
    for now, expected in cases:
        start, stop = load_range(T.ntz_lit(now), "Europe/Helsinki")
        assert tuple(spark.range(1).select(start, stop).first()) == expected
