"""Loads: sinks on their own, the outbox, rejects, load versions (SNK-9, ST-3, ST-4, ST-7, O-9..O-11)."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from meterframe.config import Settings
from meterframe.operators.contracts import ContractTable
from meterframe.plans import jobs
from meterframe.session import work_path
from meterframe.sinks.energies_table import EnergiesTable
from meterframe.sinks.rollup_store import RollupStore
from meterframe.sinks.wide_table import WideTable
from meterframe.sources import testdata
from meterframe.sources.landing import land
from meterframe.streaming.ingest import run_ingest
from meterframe.streaming.loads import Loads, read_rejects

T0 = dt.datetime(2024, 1, 2, 10)
HOUR = dt.timedelta(hours=1)
READINGS = ("time timestamp_ntz, metering_point_code string, measure_type int, resolution_duration string, value double, "
            "measure_unit string, seq struct<_file_time:timestamp,_file:string,pos:int>, raw_resolution string")


def readings(spark, *rows, file="f1", at=1):
    """Rows (time, value, side=1, unit='kWh', point='mp') of one file written at hour ``at``."""
    when = dt.datetime(2024, 1, 3, tzinfo=dt.timezone.utc) + at * HOUR
    out = []
    for i, r in enumerate(rows):
        time, value, side, unit, point = (*r, *(1, "kWh", "mp")[len(r) - 2:])
        out.append((time, point, side, "PT15M", value, unit, (when, file, i), "PT15M"))
    return spark.createDataFrame(out, READINGS)


class NoRollups:
    """Notes the days it should refresh; most tests need no more."""

    def __init__(self):
        self.days = []

    def refresh_days(self, energies, days):
        self.days.append(days)


@pytest.fixture
def loads(spark):
    return _loads(spark, lambda root: NoRollups())


@pytest.fixture
def full(spark):
    """With the real roll-ups."""
    return _loads(spark, lambda root: RollupStore(spark, f"{root}/rollups"))


def _loads(spark, rollups):
    root = work_path(spark, "loads")
    prices = spark.createDataFrame([(T0 + i * HOUR, 50.0 + i) for i in range(-48, 48)], "time timestamp_ntz, price double")
    return Loads(spark, f"{root}/outbox", f"{root}/rejects", EnergiesTable(spark, f"{root}/energies").create(),
                 rollups(root), ContractTable(testdata.contracts(spark)), prices, Settings(),
                 WideTable(spark, f"{root}/wide"))


def facts(loads):
    return {(r.time, r.measure_type): r.value for r in loads.table.read().collect()}


def points(loads):
    return {(r.time, int(r.measurementtype)): r.value for r in loads.wide.read().collect()}


def hours(loads, side="consumption"):
    return {r.time: r[f"energy_{side}"] for r in loads.rollups.read(side, "hour").collect()}


def fail(*a, **k):
    raise OSError("no such disk")


def test_all_sinks_take_a_load(spark, full):
    report = full.apply("a", readings(spark, (T0, 1.0), (T0 + HOUR, 2.0), (T0, 3.0, 6)))
    assert (report.errors, report.waiting) == ([], 0) and full.waiting() == []
    assert facts(full) == points(full) == {(T0, 1): 1.0, (T0 + HOUR, 1): 2.0, (T0, 6): 3.0}
    assert hours(full) == {T0: 1.0, T0 + HOUR: 2.0} and hours(full, "production") == {T0: 3.0}


def test_fact_sink_fails_and_the_next_run_mends(spark, full, monkeypatch):
    full.apply("a", readings(spark, (T0, 1.0)))
    monkeypatch.setattr(EnergiesTable, "merge", fail)
    report = full.apply("b", readings(spark, (T0, 5.0), (T0 + HOUR, 2.0), (T0, 4.0, 6), file="f2", at=2))
    assert [e[:2] for e in report.errors] == [("b", "facts")] and report.waiting == 1
    # The wide sinks wrote and the roll-ups were refreshed all the same.
    assert points(full) == {(T0, 1): 5.0, (T0 + HOUR, 1): 2.0, (T0, 6): 4.0}
    assert facts(full) == {(T0, 1): 1.0} and hours(full) == {T0: 1.0} and report.days == {"2024-01-02"}
    monkeypatch.undo()
    again = Loads(spark, full.outbox, full.rejects, full.table, full.rollups, full.contracts, full.prices, wide=full.wide)
    report = again.run()
    assert (report.errors, report.waiting) == ([], 0)
    assert facts(full) == points(full) and hours(full) == {T0: 5.0, T0 + HOUR: 2.0}
    assert hours(full, "production") == {T0: 4.0} and full.waiting() == []


def test_wide_sink_fails_and_later_loads_wait_for_it(spark, loads, monkeypatch):
    upsert = WideTable.upsert
    monkeypatch.setattr(WideTable, "upsert", lambda self, p, kind: fail() if kind == "productions" else upsert(self, p, kind))
    loads.apply("a", readings(spark, (T0, 1.0), (T0, 2.0, 6)))
    report = loads.apply("b", readings(spark, (T0, 3.0), (T0, 4.0, 6), file="f2", at=2))
    assert report.waiting == 2 and {e[1] for e in report.errors} == {"productions"}
    assert points(loads) == {(T0, 1): 3.0} and facts(loads) == {(T0, 1): 3.0, (T0, 6): 4.0}
    assert loads.rollups.days == [["2024-01-02"]] * 2
    monkeypatch.undo()
    assert loads.run().waiting == 0 and points(loads) == facts(loads)


def test_refresh_fails_and_is_tried_again(spark, loads, monkeypatch):
    monkeypatch.setattr(NoRollups, "refresh_days", fail)
    report = loads.apply("a", readings(spark, (T0, 1.0)))
    assert [e[1] for e in report.errors] == ["rollups"] and facts(loads) == {(T0, 1): 1.0}
    monkeypatch.undo()
    assert loads.run().waiting == 0 and loads.rollups.days == [["2024-01-02"]]


def test_a_rejected_batch_stays_in_the_outbox(spark, loads):
    """Rules of the fact table reject the whole load; the other sinks have it, the facts are as they were."""
    loads.apply("a", readings(spark, (T0, 1.0)))
    report = loads.apply("b", readings(spark, (T0, 7.0), (T0 + HOUR, 2.0, 1, "kilowatt"), file="f2", at=2))
    assert [(e[0], e[1]) for e in report.errors] == [("b", "facts")] and "long_measure_unit=1" in report.errors[0][2]
    assert facts(loads) == {(T0, 1): 1.0} and report.waiting == 1


def test_unfinished_outbox_folder_is_dropped(spark, loads):
    readings(spark, (T0, 1.0)).write.parquet(f"{loads.outbox}/broken/readings")
    assert loads.run().errors == [] and loads.files.names(loads.outbox) == [] and facts(loads) == {}


def test_rejects_by_reason_once(spark, loads):
    early = dt.datetime(2020, 1, 1)
    rows = readings(spark, (T0, 1.0), (None, 1.0), (T0 + HOUR, None), (early, 1.0), (early, None))
    for _ in range(2):  # a replayed load leaves one copy
        report = loads.apply("a", rows)
    assert (report.readings, report.empty) == (5, 2)
    got = read_rejects(spark, loads.rejects).groupBy("load", "reason").count().collect()
    assert sorted((r.load, r.reason, r["count"]) for r in got) == [
        ("a", "no_single_contract", 1), ("a", "no_time", 1)]
    assert facts(loads) == points(loads) == {(T0, 1): 1.0}


@pytest.mark.parametrize("order", [(1, 2), (2, 1)])
def test_an_older_file_processed_later_overwrites_nothing(spark, loads, order):
    parts = {1: readings(spark, (T0, 1.0), (T0 + HOUR, 1.0), (T0, 1.0, 6), file="f1", at=1),
             2: readings(spark, (T0, 2.0), (T0 + 2 * HOUR, 2.0), (T0, 2.0, 6), file="f2", at=2)}
    for n in order:
        assert loads.apply(f"{order.index(n)}", parts[n]).waiting == 0
    want = {(T0, 1): 2.0, (T0 + HOUR, 1): 1.0, (T0 + 2 * HOUR, 1): 2.0, (T0, 6): 2.0}
    assert facts(loads) == points(loads) == want


def test_files_of_one_time_go_by_name(spark, loads):
    loads.apply("0", readings(spark, (T0, 2.0), file="f2"))
    loads.apply("1", readings(spark, (T0, 1.0), file="f1"))
    assert facts(loads) == points(loads) == {(T0, 1): 2.0}
    loads.apply("2", readings(spark, (T0, 3.0), file="f2"))  # the same file again
    assert facts(loads) == points(loads) == {(T0, 1): 3.0}


def test_older_load_fills_the_fee_it_would_have_left(spark):
    """Fixed then spot leaves the fixed fee (SNK-4); spot then an older fixed load gives the same."""
    table = EnergiesTable(spark, work_path(spark, "older")).create()
    base = dict(time=T0, metering_point_code="mp", measure_type=1, source="meter", measure_unit="kWh", value=1.0, energy_basic_fee=1.0,
                transfer_basic_fee=1.0, transfer_fee=1.0, transfer_tax_fee=1.0, tax_percentage=24.0, night=True,
                resolution_duration="PT15M", spot_price=1.0)
    schema = ("time timestamp_ntz, metering_point_code string, measure_type int, contract_type short, source string, measure_unit string, "
              "value double, energy_basic_fee double, energy_fee double, energy_margin double, transfer_basic_fee double, "
              "transfer_fee double, transfer_tax_fee double, tax_percentage double, night boolean, resolution_duration string, "
              "spot_price double, load_time long, load_file string")
    names = [c.split()[0] for c in schema.split(", ")]

    def row(**k):
        return spark.createDataFrame([tuple({**base, **k}.get(n) for n in names)], schema)

    fixed = row(contract_type=2, energy_fee=3.0, load_time=1, load_file="a")
    spot = row(contract_type=3, energy_margin=0.5, value=2.0, load_time=2, load_file="b")
    seen = []
    for order in ((fixed, spot), (spot, fixed)):
        table.create()
        for part in order:
            table.merge(part)
        seen.append([tuple(r) for r in table.read().collect()])
    assert seen[0] == seen[1] and seen[0][0][3] == 3 and seen[0][0][8:10] == (3.0, 0.5)


def document(point, day, values, resolution="PT15M", days=1):
    start, stop = f"{day}T00:00:00", (dt.date.fromisoformat(day) + dt.timedelta(days=days)).isoformat() + "T00:00:00"
    entries = [{"quantity": q, "time": "x", "start": start, "unit": "kWh"} for q in values]
    return json.dumps({"getconsumptionsresult": {"consumptiondata": {
        "meteringpointcode": point, "sum": {"quantity": 1.0, "start": start, "stop": stop, "unit": "kWh"},
        "timeseries": {"start": start, "stop": stop, "resolution": resolution, "values": {"tsv": entries}}}}})


def _land(spark, root, *docs):
    land(spark.createDataFrame([(d, 1) for d in docs], "value string, measure_type int").coalesce(1), root)


def test_stream_re_fetches_in_several_batches(spark, full, tmp_path, monkeypatch):
    """Batches of one file each, a later run with a re-fetched day, and a sink that failed in between."""
    root = str(tmp_path / "landing")
    _land(spark, root, document("a", "2024-01-02", [1.0, 1.0, None]), document("a", "2024-01-03", [1.0]), '{"broken')
    land(spark.createDataFrame([(document("a", "2024-01-02", [9.0]), 6)], "value string, measure_type int"), root)

    def run(rollups):
        return run_ingest(spark, root, full.table, rollups, full.contracts, full.prices, str(tmp_path / "ck"),
                          full.rejects, max_files_per_trigger=1, wide_path=full.wide.path, outbox=full.outbox)

    with monkeypatch.context() as m:
        m.setattr(WideTable, "upsert", fail)
        report = run(NoRollups())
    assert report.batches > 1 and report.rejected_documents == 1 and report.waiting == report.batches
    day = dt.datetime(2024, 1, 1, 22)
    quarter = dt.timedelta(minutes=15)
    assert facts(full) == {(day, 1): 1.0, (day + quarter, 1): 1.0, (day + dt.timedelta(days=1), 1): 1.0, (day, 6): 9.0}
    assert points(full) == {}
    _land(spark, root, document("a", "2024-01-02", [5.0, None, 5.0]))
    report = run(full.rollups)
    assert report.errors == [] and report.waiting == 0
    assert facts(full) == points(full) == {
        (day, 1): 5.0, (day + quarter, 1): 1.0, (day + 2 * quarter, 1): 5.0, (day + dt.timedelta(days=1), 1): 1.0, (day, 6): 9.0}
    assert hours(full)[day] == 11.0
    assert (report.readings, report.empty) == (3, 1) and read_rejects(spark, full.rejects).count() == 0
    assert spark.read.parquet(f"{full.rejects}/documents").where("reason = 'malformed'").count() == 1


def test_backfill_clips_documents_that_cross_its_bounds(spark, full, tmp_path):
    root = str(tmp_path / "landing")
    month = [float(i + 1) for i in range(31 * 96)]
    _land(spark, root, document("a", "2024-01-01", month, days=31), document("a", "2024-01-05", [7.0] * 24, "PT1H"),
          document("b", "2024-02-01", [1.0]))
    report = jobs.run_backfill(full, root, "2024-01-10T06:00:00", "2024-01-12T00:00:00", "PT15M")
    assert report.errors == [] and report.days == {"2024-01-10", "2024-01-11"}
    got = facts(full)
    first = dt.datetime(2024, 1, 10, 4)
    assert len(got) == (18 + 24) * 4 and min(got) == (first, 1) and max(got)[0] == dt.datetime(2024, 1, 11, 21, 45)
    assert got[(first, 1)] == float(9 * 96 + 24 + 1) and points(full) == got
    day = {r.time: r.energy_consumption for r in full.rollups.read("consumption", "day").collect()}
    assert day[dt.datetime(2024, 1, 10, 22)] == sum(month[10 * 96:11 * 96])
    with pytest.raises(ValueError):
        jobs.run_backfill(full, root, "2024-01-10", "2024-01-12T00:00:00")


def test_wide_points_come_from_price_points(spark, loads):
    """Corrections and other document types are there; the first A44 point of the time counts."""
    def point(kind, stamp, price, time=T0):
        return (time, kind, "x", "x", kind, "x", "x", "EUR", "MWH", "A01", stamp, price, None)

    from meterframe.schemas import PRICE_POINTS
    loads.points = spark.createDataFrame([point("A44", "2024-01-02T10:00:01", 900.0), point("A44", "2024-01-02T10:00:00", 80.0),
                                          point("A65", "2024-01-01T00:00:00", 5.0)], PRICE_POINTS)
    loads.apply("a", readings(spark, (T0, 1.0), (T0 + HOUR, 2.0)))
    assert {r.time: r.price for r in loads.wide.read().collect()} == {T0: 0.08, T0 + HOUR: 0.0}
    assert {r.time: r.spot_price for r in loads.table.read().collect()} == {T0: 5.0, T0 + HOUR: 5.1}


def test_price_point_store_replaces_by_time_and_tags(spark, loads):
    """Points written between two loads price the second one; a point written again replaces the stored one."""
    from meterframe.schemas import PRICE_POINTS
    from meterframe.sinks.price_points import PricePointStore
    from meterframe.sinks.publish import RejectedBatch

    def point(price, kind="A44", stamp="s1", time=T0, domain=None):
        return (time, kind, domain, "x", kind, "x", "x", "EUR", "MWH", "A01", stamp, price, None)

    def table(*rows):
        return spark.createDataFrame(list(rows), PRICE_POINTS)

    store = loads.points = PricePointStore(spark, work_path(spark, "points"))
    assert store.read().count() == 0
    loads.apply("0", readings(spark, (T0, 1.0)))
    store.upsert(table(point(10.0), point(20.0, "A65"), point(30.0, time=T0 + HOUR * 24)))
    store.upsert(table(point(40.0), point(50.0, stamp="s2")))
    assert sorted(r.price for r in store.read().collect()) == [20.0, 30.0, 40.0, 50.0]
    loads.apply("1", readings(spark, (T0, 2.0), file="f2", at=2))
    assert [(r.value, r.price) for r in loads.wide.read().collect()] == [(2.0, 0.04)]
    with pytest.raises(RejectedBatch):
        store.upsert(table(point(None)))
    assert store.read().count() == 4


def test_quantities_that_no_sum_can_hold_are_rejected(spark, loads):
    rows = readings(spark, (T0, 1.0), (T0 + HOUR, 1e12), (T0 + 2 * HOUR, float("inf")), (T0 + 3 * HOUR, float("nan")), (T0 + 4 * HOUR, -5e8))
    assert loads.apply("a", rows).errors == []
    assert facts(loads) == {(T0, 1): 1.0}
    got = read_rejects(spark, loads.rejects).groupBy("reason").count().collect()
    assert [(r.reason, r["count"]) for r in got] == [("quantity_out_of_range", 4)]
