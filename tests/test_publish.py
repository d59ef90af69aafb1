"""All-or-nothing publishing: ended processes, rejected batches (SNK-6, SNK-13)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterframe.schemas import ENERGIES
from meterframe.session import work_path
from meterframe.sinks import publish
from meterframe.sinks.energies_table import EnergiesTable
from meterframe.sinks.files import Files
from meterframe.sinks.publish import MARK, RUNS, Publisher, RejectedBatch


class Ended(RuntimeError):
    """Stands for the end of the process."""


def rows(spark, values):
    return spark.createDataFrame(values, "day string, x int")


def content(spark, path):
    return sorted((r.day, r.x) for r in spark.read.schema("x int, day string").parquet(path).collect())


@pytest.fixture
def table(spark):
    p = Publisher(spark, work_path(spark, "publish"), ["day"])
    p.replace(rows(spark, [("d1", 1), ("d2", 2), ("d3", 3)]), ["x"])
    return p


def test_replaces_only_the_batch_partitions(spark, table):
    assert table.replace(rows(spark, [("d2", 20), ("d4", 4)]), ["x"]) == ["day=d2", "day=d4"]
    assert content(spark, table.path) == [("d1", 1), ("d2", 20), ("d3", 3), ("d4", 4)]
    table.replace(rows(spark, [("d2", 5)]), ["x"], also=["day=d1", "day=d2"])
    assert content(spark, table.path) == [("d2", 5), ("d3", 3), ("d4", 4)]
    table.replace(rows(spark, [("d9", 9)]), ["x"], keep_rest=False)
    assert content(spark, table.path) == [("d9", 9)]
    table.replace(rows(spark, []), ["x"], keep_rest=False)
    assert content(spark, table.path) == []


@pytest.mark.parametrize("moves", [0, 1, 2])
def test_ends_while_publishing(spark, table, monkeypatch, moves):
    """After the mark, a replay gives the whole batch wherever the process ended."""
    move, left = Files.move, [moves]

    def ends(self, old, new):
        if "/data/" in old:
            if not left[0]:
                raise Ended
            left[0] -= 1
        return move(self, old, new)

    monkeypatch.setattr(Files, "move", ends)
    with pytest.raises(Ended):
        table.replace(rows(spark, [("d1", 10), ("d2", 20), ("d5", 50)]), ["x"])
    monkeypatch.undo()
    again = Publisher(spark, table.path, ["day"])
    assert again.recover() == (1, 0)
    assert content(spark, table.path) == [("d1", 10), ("d2", 20), ("d3", 3), ("d5", 50)]
    assert again.recover() == (0, 0)


def test_ends_before_the_mark(spark, table, monkeypatch):
    """Before the mark, nothing of the batch is in the table and the stage is dropped."""
    before = content(spark, table.path)
    monkeypatch.setattr(Publisher, "mark", lambda *a, **k: (_ for _ in ()).throw(Ended))
    with pytest.raises(Ended):
        table.replace(rows(spark, [("d1", 10), ("d7", 70)]), ["x"])
    monkeypatch.undo()
    assert content(spark, table.path) == before
    assert table.recover() == (0, 1)
    assert content(spark, table.path) == before and not table.files.names(f"{table.path}/{RUNS}")


def test_ends_after_publishing(spark, table, monkeypatch):
    """The run folder is left over: replaying it changes nothing."""
    delete = Files.delete

    def ends(self, path):
        if f"/{RUNS}/" in path:
            raise Ended
        return delete(self, path)

    monkeypatch.setattr(Files, "delete", ends)
    with pytest.raises(Ended):
        table.replace(rows(spark, [("d1", 10)]), ["x"])
    monkeypatch.undo()
    assert content(spark, table.path) == [("d1", 10), ("d2", 2), ("d3", 3)]
    assert table.recover() == (1, 0)
    assert content(spark, table.path) == [("d1", 10), ("d2", 2), ("d3", 3)]


def test_the_next_write_finishes_an_ended_one(spark, table, monkeypatch):
    monkeypatch.setattr(Publisher, "publish", lambda *a: (_ for _ in ()).throw(Ended))
    with pytest.raises(Ended):
        table.replace(rows(spark, [("d1", 10)]), ["x"])
    monkeypatch.undo()
    table.replace(rows(spark, [("d2", 20)]), ["x"])
    assert content(spark, table.path) == [("d1", 10), ("d2", 20), ("d3", 3)]


def test_rules_reject_the_whole_batch(spark, table):
    before = content(spark, table.path)
    rules = {"negative": F.col("x") < 0, "large": F.col("x") > 100, "marked": F.col("_mark") == 1}
    bad = rows(spark, [("d1", -1), ("d2", -5), ("d3", 7), ("d8", 500)]).withColumn("_mark", F.lit(0))
    with pytest.raises(RejectedBatch) as e:
        table.replace(bad, ["x"], rules)
    assert e.value.counts == {"negative": 2, "large": 1}
    assert content(spark, table.path) == before and not table.files.names(f"{table.path}/{RUNS}")
    table.replace(bad.where("x = 7"), ["x"], rules)
    assert content(spark, table.path) == [("d1", 1), ("d2", 2), ("d3", 7)]
    assert "_mark" not in spark.read.parquet(table.path).columns


T0 = dt.datetime(2023, 12, 26, 10)


def fact(**changes):
    base = dict(time=T0, metering_point_code="mp", measure_type=1, contract_type=3, source="meter", measure_unit="kWh", value=1.0,
                energy_basic_fee=5.5, energy_fee=None, energy_margin=0.25, transfer_basic_fee=14.5, transfer_fee=4.34,
                transfer_tax_fee=2.3, tax_percentage=24.0, night=False, resolution_duration="PT15M", spot_price=1.5)
    base.update(changes)
    return tuple(base[f.name] for f in ENERGIES.fields)


def batch(spark, *facts):
    from pyspark.sql import types as T
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in ENERGIES.fields])
    return spark.createDataFrame(list(facts), loose)


@pytest.mark.parametrize("rule,change", [
    ("null_time", {"time": None}), ("null_metering_point_code", {"metering_point_code": None}), ("null_contract_type", {"contract_type": None}),
    ("null_measure_unit", {"measure_unit": None}), ("null_tax_percentage", {"tax_percentage": None}),
    ("long_measure_unit", {"measure_unit": "kilowatt"}), ("long_resolution_duration", {"resolution_duration": "PT15MINUTES"})])
def test_energies_reject_a_batch(spark, rule, change):
    table = EnergiesTable(spark, work_path(spark, "rules")).create(batch(spark, fact()))
    before = sorted(table.read().collect())
    good = fact(time=T0 + dt.timedelta(days=3))
    with pytest.raises(RejectedBatch) as e:
        table.merge(batch(spark, good, fact(value=9.0), fact(**{"time": T0 + dt.timedelta(hours=1), **change})))
    assert e.value.counts == {rule: 1}
    assert sorted(table.read().collect()) == before
    table.merge(batch(spark, good))
    assert table.read().count() == 2


def test_energies_reject_a_repeated_key(spark):
    table = EnergiesTable(spark, work_path(spark, "rules")).create(batch(spark, fact()))
    with pytest.raises(RejectedBatch) as e:
        table.merge(batch(spark, fact(value=2.0), fact(value=3.0)))
    assert e.value.counts == {"duplicate_key": 2}
    assert [r.value for r in table.read().collect()] == [1.0]


def test_merge_ends_and_is_replayed(spark, monkeypatch):
    """A merge that ends while publishing is whole after the next start; merging the batch again changes nothing."""
    table = EnergiesTable(spark, work_path(spark, "replay")).create(batch(spark, fact(), fact(time=T0 + dt.timedelta(days=1))))
    new = batch(spark, fact(value=5.0), fact(time=T0 + dt.timedelta(days=1), value=6.0), fact(time=T0 + dt.timedelta(days=2), value=7.0))
    move, left = Files.move, [1]

    def ends(self, old, to):
        if "/data/" in old:
            if not left[0]:
                raise Ended
            left[0] -= 1
        return move(self, old, to)

    monkeypatch.setattr(Files, "move", ends)
    with pytest.raises(Ended):
        table.merge(new)
    monkeypatch.undo()
    table = EnergiesTable(spark, table.path)
    table.recover()
    assert sorted(r.value for r in table.read().collect()) == [5.0, 6.0, 7.0]
    table.merge(new)
    assert sorted(r.value for r in table.read().collect()) == [5.0, 6.0, 7.0]


def test_files_write_and_read(spark):
    path = work_path(spark, "files")
    f = Files(spark, path)
    f.write(f"{path}/a/{MARK}", "größe\n")
    f.write(f"{path}/a/{MARK}", "two")
    assert f.read(f"{path}/a/{MARK}") == "two" and f.names(f"{path}/a", folders=False) == [MARK]
    assert f.names(f"{path}/none") == [] and publish.MARK == MARK
