"""Plan shapes that the scale design relies on (read from ``explain``)."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from meterframe.operators.contracts import attach_contract
from meterframe.operators.readings import accepted, last_write_wins
from meterframe.operators.rollups import rollup
from meterframe.plans import catalog
from meterframe.plans import registry  # noqa: F401
from meterframe.schemas import ENERGY_KEY
from meterframe.session import work_path
from meterframe.sinks.energies_table import EnergiesTable


def plan(df, mode="simple"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.fixture(scope="module")
def energies(spark, sf_small):
    return catalog.energies(spark, sf_small).checkpoint()


def test_dedupe_combines_before_the_shuffle(spark, sf_small):
    ok = accepted(catalog.readings(spark, sf_small)).select(*ENERGY_KEY, "value", "measure_unit", "seq")
    text = plan(last_write_wins(ok))
    assert "partial_max" in text
    assert text.index("Exchange hashpartitioning") < text.index("partial_max")  # partial below the exchange


def test_contract_range_join_is_broadcast(spark, sf_small):
    ok = accepted(catalog.readings(spark, sf_small))
    text = plan(attach_contract(ok, catalog.contract_table(spark)))
    assert "_c_day" in text[text.index("Join"):] and "NestedLoopJoin" not in text  # equi-key with a value per day
    assert "CartesianProduct" not in text


def test_rollup_has_one_shuffle_and_pushes_filters(spark, energies):
    text = plan(rollup(energies, "consumption", "day"))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in text


def test_merge_reads_only_touched_partitions(spark, energies):
    table = EnergiesTable(spark, work_path(spark, "plan-table")).create(energies)
    scan = table.read(with_partition=True).where(F.col("day").isin(["2024-01-05"]))
    text = plan(scan)
    assert "PartitionFilters: [isnotnull(day" in text and "2024-01-05" in text


def test_events_scan_prunes_columns(spark, sf_small):
    text = plan(catalog.readings(spark, sf_small))
    read_schema = text[text.index("ReadSchema"):].split("\n")[0]
    assert "props" not in read_schema


def test_merge_plan_reads_and_rewrites_touched_days_only(spark, energies, monkeypatch):
    """The published partitions are those of the batch, and no other folder changes."""
    from meterframe.sinks.publish import Publisher
    table = EnergiesTable(spark, work_path(spark, "plan-merge")).create(energies)
    kept, replace = [], Publisher.replace
    monkeypatch.setattr(Publisher, "replace", lambda self, *a, **k: kept.append(replace(self, *a, **k)) or kept[-1])
    days = table.merge(energies.where("day(time) = 5 and hour(time) < 20"))
    assert kept == [[f"day={d}" for d in days]] and days == ["2024-01-05"]


def test_ranged_report_prunes_and_spreads_a_day(spark, energies):
    from meterframe.operators.report import daily_report
    from meterframe.sinks.rollup_store import RollupStore
    store = RollupStore(spark, work_path(spark, "plan-report"))
    store.refresh_full(energies, sides=("consumption",))
    lo, hi = "2024-01-03 22:00:00", "2024-01-05 22:00:00"
    report = daily_report(store.read("consumption", "day", lo, hi), lo, hi)
    text = plan(report)
    assert "PartitionFilters: [isnotnull(period" in text
    assert "rangepartitioning(date" in text and "metering_point_code" in text[text.index("rangepartitioning"):].split("\n")[0]
    assert sorted({str(r.date) for r in report.collect()}) == ["2024-01-03 22:00:00", "2024-01-04 22:00:00", "2024-01-05 22:00:00"]


def test_contracts_run_no_job_and_can_be_released(spark):
    from meterframe.operators.contracts import ContractTable
    from meterframe.sources import testdata
    table = ContractTable(testdata.contracts(spark))
    assert table.segments.storageLevel.useMemory
    table.release()
    assert not table.segments.storageLevel.useMemory
