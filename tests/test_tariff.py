"""Contracts and tariff rules: reference goldens, exactly-one rule, checks."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from meterframe.config import Settings
from meterframe.functions import tariff
from meterframe.functions.timeutil import local_hour
from meterframe.operators import contracts as C
from meterframe.sources import contracts as SC

SETTINGS_YAML = os.path.join(os.path.dirname(__file__), "data", "settings.yaml")


@pytest.fixture(scope="module")
def contracts(spark):
    return SC.flatten(SC.config_from_yaml(spark, SETTINGS_YAML))


def _readings(spark, times, side=1):
    rows = [(t, "mp", side, "PT1H", 1.0, "kWh", i) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "time timestamp_ntz, metering_point_code string, measure_type int, "
                                       "resolution_duration string, value double, measure_unit string, seq long")


def test_fixed_fee_golden(spark, contracts):
    # 2014-05-31 22:00Z is 01:00 local: contract 2, night, energy fee 1.23.
    r = C.attach_contract(_readings(spark, [dt.datetime(2014, 5, 31, 22)]), contracts)
    row = r.withColumn("_lh", local_hour("time")).select(
        "contract_type", tariff.energy_night("_lh").alias("night"),
        tariff.energy_fee_fixed("_lh").alias("fee")).first()
    assert (row.contract_type, row.night, round(row.fee, 5)) == (2, True, 1.23)


def test_spot_contract_golden(spark, contracts):
    r = C.attach_contract(_readings(spark, [dt.datetime(2019, 12, 31, 22)]), contracts)
    assert r.first().contract_type == 3


def test_closed_end_and_gap_instants(spark, contracts):
    # End 2013-12-31T23:59:59 local is inclusive; the next contract starts one second later.
    t_end = dt.datetime(2013, 12, 31, 21, 59, 59)
    t_between = dt.datetime(2013, 12, 31, 21, 59, 59, 500000)
    t_next = dt.datetime(2013, 12, 31, 22, 0, 0)
    before = dt.datetime(2013, 8, 1)
    got = {r.time: r.contract_type for r in C.attach_contract(
        _readings(spark, [t_end, t_between, t_next, before]), contracts).collect()}
    assert got == {t_end: 2, t_next: 2}
    anti = C.attach_contract(_readings(spark, [t_between, before]), contracts, how="left_anti")
    assert anti.count() == 2


def test_overlap_matches_nothing(spark, contracts):
    extra = contracts.where(F.col("contract_type") == 3).withColumn(
        "valid_from", F.lit("2014-09-30 00:00:00").cast("timestamp_ntz"))
    both = contracts.unionByName(extra)
    times = [dt.datetime(2014, 9, 30, 12), dt.datetime(2015, 1, 1)]
    got = C.attach_contract(_readings(spark, times), both).collect()
    assert [r.time for r in got] == []          # both instants are covered twice


def test_violations(spark, contracts):
    assert C.violations(contracts).count() == 0
    assert C.fee_violations(contracts).count() == 0
    shifted = contracts.withColumn(
        "valid_to", F.when(F.col("contract_type") == 3, F.col("valid_to"))
                     .otherwise(F.col("valid_to") - F.expr("INTERVAL 1 HOUR")))
    problems = sorted(r.problem for r in C.violations(shifted).collect())
    assert problems == ["gap", "gap", "gap"]
    no_margin = contracts.withColumn("energy_margin", F.lit(None).cast("double"))
    assert [r.problem for r in C.fee_violations(no_margin).collect()] == ["spot_without_margin"]


def test_bound_problems(spark):
    cfg = SC.config_from_records(spark, [
        {"side": "consumption", "start_time": "2022-03-27T03:30:00", "contract_type": "fixed"},
        {"side": "consumption", "start_time": "2023-10-29T03:30:00", "end_time": "2023-13-01T00:00:00",
         "contract_type": "spot"}])
    got = sorted((r.bound, r.problem) for r in SC.bound_problems(cfg).collect())
    assert got == [("end_time", "unparsable"), ("start_time", "dst_gap"), ("start_time", "dst_overlap")]


def test_spot_fee_negative_no_tax(spark):
    df = spark.createDataFrame(
        [(-20.0, 24.0, 0.25, True), (-20.0, 24.0, 0.25, False), (30.0, None, None, True)],
        "spot double, tax_percentage double, energy_margin double, energy_negative_no_tax boolean")
    got = [round(r[0], 6) for r in df.select(tariff.energy_fee_spot("spot")).collect()]
    assert got == [-1.75, round(-2.0 * 1.24 + 0.25, 6), round(3.0 * 1.24, 6)]


def test_contract_type_codes(spark):
    row = spark.range(1).select(tariff.contract_type_code(F.lit("Hybrid")), tariff.contract_type_name(F.lit(3)),
                                tariff.contract_type_code(F.lit("other"))).first()
    assert tuple(row) == (4, "spot", None)


def test_contract_join_keys_by_day(spark, contracts):
    times = [dt.datetime(2014, 5, 31, 22), dt.datetime(2019, 12, 31, 22), dt.datetime(2013, 8, 1)]
    got = sorted((r.time, r.contract_type) for r in C.attach_contract(_readings(spark, times), contracts).collect())
    assert got == [(times[0], 2), (times[1], 3)]
    left = C.attach_contract(_readings(spark, times), contracts, how="left_anti").collect()
    assert [r.time for r in left] == [times[2]]


def test_rejects_one_scan(spark, contracts):
    from meterframe.operators.quality import rejects_by_reason
    rows = [(dt.datetime(2013, 8, 1), "mp", 1, "PT1H", 1.0, "kWh", 1),     # before the first contract
            (dt.datetime(2014, 5, 1), "mp", 1, "PT1H", None, "kWh", 2),    # no quantity
            (None, "mp", 1, "PT1H", 1.0, "kWh", 3),                         # no time
            (dt.datetime(2014, 5, 1), "mp", 1, "PT1H", 2.0, "kWh", 4)]      # accepted
    df = spark.createDataFrame(rows, "time timestamp_ntz, metering_point_code string, measure_type int, "
                                     "resolution_duration string, value double, measure_unit string, seq long")
    got = sorted((r.reason, r.n_rows) for r in rejects_by_reason(df, contracts).collect())
    assert got == [("no_quantity", 1), ("no_single_contract", 1), ("no_time", 1)]


def test_wide_tag_keeps_raw_resolution(spark, contracts, tmp_path):
    import json

    from meterframe.operators.pricing import wide_points
    from meterframe.schemas import PRICES
    from meterframe.sources import payloads as P

    doc = {"getconsumptionsresult": {"consumptiondata": {
        "meteringpointcode": "w1", "sum": {"quantity": 0.3, "start": "2024-01-01T00:00:00",
                                           "stop": "2024-01-02T00:00:00", "unit": "kWh"},
        "timeseries": {"start": "2024-01-01T00:00:00", "stop": "2024-01-02T00:00:00", "resolution": "PT15MIN",
                       "values": {"tsv": [{"quantity": 0.1, "time": "x", "start": "2024-01-01T00:00:00"},
                                          {"quantity": 0.2, "time": "x", "start": "2024-01-01T00:00:00"}]}}}}}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    good, _ = P.split_documents(P.read_payloads(spark, str(tmp_path), 1))
    rows = P.explode_readings(good)
    pts = wide_points(rows, contracts, spark.createDataFrame([], PRICES), 1).collect()
    # Payload quantities are 32-bit floats: compare at float precision.
    assert sorted((r.resolution_duration_tag, round(r.value, 6), r.price, r.timestamp) for r in pts) == [
        ("PT15MIN", 0.1, 0.0, "2023-12-31T22:00:00"), ("PT15MIN", 0.2, 0.0, "2023-12-31T22:15:00")]
