"""Fact-table merge: column ownership, defaults, idempotence (SNK-1..SNK-6)."""

import datetime as dt

from meterframe.schemas import ENERGIES
from meterframe.session import work_path
from meterframe.sinks.energies_table import EnergiesTable

T0 = dt.datetime(2023, 12, 26, 10)


def _row(contract_type, energy_fee=None, energy_margin=None, night=False, value=1.0, mt=1, t=T0):
    return (t, "mp", mt, contract_type, "meter", "kWh", value, 5.5, energy_fee, energy_margin, 14.5, 4.34,
            2.35972, 24.0, night, "PT15M", 1.5)


def _table(spark, rows):
    t = EnergiesTable(spark, work_path(spark, "test-energies"))
    return t.create(spark.createDataFrame(rows, ENERGIES))


def test_fixed_to_spot_keeps_stale_fee(spark):
    table = _table(spark, [_row(4, energy_fee=3.23, night=True)])
    table.merge(spark.createDataFrame([_row(3, energy_margin=0.25, night=False, value=2.0)], ENERGIES))
    r = table.read().first()
    assert (r.contract_type, r.energy_fee, r.energy_margin, r.night, r.value) == (3, 3.23, 0.25, False, 2.0)


def test_spot_to_fixed_keeps_stale_margin(spark):
    table = _table(spark, [_row(3, energy_margin=0.25)])
    table.merge(spark.createDataFrame([_row(2, energy_fee=1.23, night=True)], ENERGIES))
    r = table.read().first()
    assert (r.contract_type, r.energy_fee, r.energy_margin, r.night) == (2, 1.23, 0.25, True)


def test_production_keeps_night_and_inserts_default(spark):
    t1 = T0 + dt.timedelta(hours=1)
    table = _table(spark, [_row(3, energy_margin=0.3, night=True, mt=6)])
    batch = spark.createDataFrame([_row(3, energy_margin=0.4, night=False, mt=6),
                                   _row(3, energy_margin=0.4, night=True, mt=6, t=t1)], ENERGIES)
    table.merge(batch)
    got = {r.time: (r.energy_margin, r.night) for r in table.read().collect()}
    # Production never sets night: kept on conflict, default false on insert.
    assert got == {T0: (0.4, True), t1: (0.4, False)}


def test_merge_is_idempotent(spark):
    table = _table(spark, [_row(2, energy_fee=1.23)])
    batch = spark.createDataFrame([_row(3, energy_margin=0.25, value=7.0),
                                   _row(3, energy_margin=0.25, t=T0 + dt.timedelta(days=40))], ENERGIES)
    table.merge(batch)
    once = sorted(tuple(r) for r in table.read().collect())
    table.merge(batch)
    assert sorted(tuple(r) for r in table.read().collect()) == once
    days = {r.day for r in table.read(with_partition=True).collect()}
    assert days == {"2023-12-26", "2024-02-04"}


def test_wide_upsert_replaces_by_time_and_tags(spark):
    from meterframe.schemas import WIDE
    from meterframe.sinks.wide_table import WideTable

    def pt(t, point, value, tag=None):
        return (t, point, "1", tag, point, "1", tag, "kWh", t.isoformat(), value, 0.05,
                14.5, 4.34, 2.36, 5.5, 1.0, 3, 0.25, 24.0)

    table = WideTable(spark, work_path(spark, "test-wide"))
    table.upsert(spark.createDataFrame([pt(T0, "a", 1.0), pt(T0, "b", 2.0)], WIDE), "consumptions")
    table.upsert(spark.createDataFrame([pt(T0, "a", 9.0), pt(T0, "a", 3.0, "PT15M")], WIDE), "consumptions")
    got = sorted((r.meteringpointcode, r.resolution_duration_tag or "", r.value)
                 for r in table.read("consumptions").collect())
    assert got == [("a", "", 9.0), ("a", "PT15M", 3.0), ("b", "", 2.0)]
