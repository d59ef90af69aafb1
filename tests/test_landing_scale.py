"""Landing and ingest keep no wide copy of documents: on disk, in a shuffle or in an executor's memory."""

import datetime as dt
import glob
import json
import os

from pyspark.sql import functions as F

from meterframe.plans.documents import documents_from_readings
from meterframe.sources import landing
from meterframe.streaming import loads as loads_module
from meterframe.streaming.ingest import IngestReport, make_batch_handler
from test_loads import T0, NoRollups, _loads, readings


def _many(spark, n):
    return spark.range(n).select(
        (F.lit(T0.isoformat(sep=" ")).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 3).cast("int"))).alias("time"),
        F.concat(F.lit("mp-"), "id").alias("metering_point_code"),
        (1 + F.col("id") % 1).cast("int").alias("measure_type"), F.lit("PT15M").alias("resolution_duration"), (F.col("id") % 9).cast("double").alias("value"),
        F.lit("kWh").alias("measure_unit"))


def test_landed_documents_are_compressed_and_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "FILE_DOCUMENTS", 100)
    n, root = 950, f"{tmp_path}/landing"
    lines = landing.as_lines(documents_from_readings(_many(spark, n)))
    landing.land(lines, root, clustered=True)
    text = lines.agg(F.sum(F.octet_length("value"))).first()[0]
    files = glob.glob(f"{root}/**/part-*", recursive=True)
    assert len(files) >= n / 100 and sum(map(os.path.getsize, files)) * 10 < text
    back = landing.read_landed(spark, root)
    assert sorted(r[0] for r in back.select("_raw").collect()) == sorted(r[0] for r in lines.select("value").collect())
    assert back.agg(F.sum(F.size("getconsumptionsresult.consumptiondata.timeseries.values.tsv"))).first()[0] == 96 * n


def test_documents_are_shuffled_before_their_slots_are_made(spark):
    prices = spark.createDataFrame([(T0, 5.0)], "time timestamp_ntz, price double")
    df = landing.as_lines(documents_from_readings(_many(spark, 50), spot_prices=prices))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    above, below = plan.split("REBALANCE", 1)
    assert "StructsToJson" in above and "sequence" in above and "sequence" not in below


def test_ingest_keeps_no_parsed_documents(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/landing"
    bad = F.regexp_replace("value", '"resolution":"PT15M",', "")
    lines = landing.as_lines(documents_from_readings(_many(spark, 12)))
    landing.land(lines.withColumn("value", F.when(F.col("value").contains('"mp-3"'), bad).otherwise(F.col("value"))), root)
    loads, report = _loads(spark, lambda r: NoRollups()), IngestReport()
    batch = landing.read_landed(spark, root)

    def persisted(*_):
        raise AssertionError("documents are kept")

    monkeypatch.setattr(batch, "persist", persisted)
    make_batch_handler(loads, report)(batch, 0)
    assert (report.batches, report.rejected_documents, report.readings, report.empty) == (1, 1, 11 * 96, 11 * 95)
    assert not report.errors and loads.table.read().count() == 11


def test_empty_slots_meet_no_contract(spark, monkeypatch):
    loads, seen, own = _loads(spark, lambda r: NoRollups()), [], loads_module.tagged
    monkeypatch.setattr(loads_module, "tagged", lambda rows, *a: (seen.append(rows), own(rows, *a))[1])
    rows = readings(spark, (T0, 1.0), (T0 + dt.timedelta(minutes=15), None), (T0 + dt.timedelta(minutes=30), None), (None, 2.0))
    report = loads.apply("a", rows)
    assert (report.readings, report.empty) == (4, 2) and not report.errors
    assert seen[0].count() == 2 and loads.table.read().count() == 1


def test_slot_times_are_worked_out_once_a_period(spark):
    df = landing.as_lines(documents_from_readings(_many(spark, 50)))
    each_document = df._jdf.queryExecution().sparkPlan().toString().split("BroadcastHashJoin", 1)[0]
    assert "StructsToJson" in each_document and "convert_timezone" not in each_document


def test_documents_with_many_readings_few_readings_and_odd_texts(spark):
    midnight, day = dt.datetime(2024, 1, 9, 22), "2024-01-10"

    def at(minutes):
        return (midnight + dt.timedelta(minutes=minutes)).isoformat(sep=" ")

    full = [(at(15 * i), "full", 1, "PT15M", float(i), "kWh") for i in range(96)]
    few = [(at(45), 'q"ü', 6, "PT15M", 0.5, 'k"\\h'), (at(0), 'q"ü', 6, "PT15M", None, 'k"\\h'), (at(60), "no unit", 1, None, 2.0, None)]
    rows = spark.createDataFrame([*full, *few], "time string, metering_point_code string, measure_type int, "
                                 "resolution_duration string, value double, measure_unit string")
    docs = {}
    for (text,) in landing.as_lines(documents_from_readings(rows.withColumn("time", F.col("time").cast("timestamp_ntz")))).select("value").collect():
        series = json.loads(text)["getconsumptionsresult"]["consumptiondata"]
        assert text == json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False)
        docs[series["meteringpointcode"]] = series
    tsv = {code: series["timeseries"]["values"]["tsv"] for code, series in docs.items()}
    assert {code: len(e) for code, e in tsv.items()} == {"full": 96, 'q"ü': 96, "no unit": 24}
    assert {code: [(i, e["quantity"]) for i, e in enumerate(v) if "quantity" in e] for code, v in tsv.items()} == {
        "full": [(i, float(i)) for i in range(96)], 'q"ü': [(3, 0.5)], "no unit": [(1, 2.0)]}
    assert tsv['q"ü'][3] == {"quantity": 0.5, "time": f"{day}T00:45:00", "start": f"{day}T00:00:00",
                             "stop": "2024-01-11T00:00:00", "unit": 'k"\\h'}
    assert "unit" not in tsv["no unit"][0] and "resolution" not in docs["no unit"]["timeseries"]


def test_labels_of_empty_slots_are_not_worked_out(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/landing"
    landing.land(landing.as_lines(documents_from_readings(_many(spark, 12))), root)
    loads, seen, own = _loads(spark, lambda r: NoRollups()), [], loads_module.labelled
    monkeypatch.setattr(loads_module, "labelled", lambda rows, *a: (seen.append(rows.count()), own(rows, *a))[1])
    make_batch_handler(loads, IngestReport())(landing.read_landed(spark, root), 0)
    assert seen == [12]


def test_small_clustered_landings_are_made_by_several_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    root = f"{tmp_path}/landing"
    landing.land(landing.as_lines(documents_from_readings(_many(spark, 30_000))), root, clustered=True)
    parts = {f.split("part-")[1][:5] for f in glob.glob(f"{root}/**/part-*", recursive=True)}
    assert len(parts) > 1 and spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
