"""Payload documents: goldens P1-P3 (FIXTURES §1.1) and the strict check."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from meterframe.plans.documents import documents_from_readings
from meterframe.sources import payloads as P
from meterframe.sources.landing import as_lines, land, read_landed


def _tsv(q, time, start=None, unit="kWh", **extra):
    d = {"quantity": q, "time": time, "unit": unit, **extra}
    if start is not None:
        d["start"] = start
    return d


def _doc(point, resolution, tsv, start="2022-08-01T00:00:00", stop="2022-09-01T00:00:00",
         total=0.06, unit="kWh", spot=None, drop=None):
    cd = {"meteringpointcode": point,
          "sum": {"quantity": total, "start": start, "stop": stop, "unit": unit},
          "timeseries": {"start": start, "stop": stop, "resolution": resolution, "values": {"tsv": tsv}}}
    if drop:
        section, key = drop
        (cd[section] if section else cd).pop(key)
    body = {"consumptiondata": cd}
    if spot is not None:
        body["spotdata"] = spot
    return {"getconsumptionsresult": body}


def _land(tmp_path, docs, name="docs"):
    p = tmp_path / name
    p.mkdir()
    (p / "part.json").write_text("\n".join(json.dumps(d) for d in docs))
    return str(p)


def _readings(spark, path, mt=1):
    good, rejected = P.split_documents(P.read_payloads(spark, path, mt))
    return P.explode_readings(good), rejected


P1_QTY = [0, 0, 0, 0, 0, 0, 0.02, 0.04]


def test_p1_no_start_drops_every_reading(spark, tmp_path):
    tsv = [_tsv(q, f"2022-08-01T{h:02d}:00:00") for h, q in enumerate(P1_QTY)]
    rows, rejected = _readings(spark, _land(tmp_path, [_doc("1337", "PT1H", tsv)]))
    assert rejected.count() == 0
    got = rows.collect()
    assert len(got) == 8 and all(r.time is None for r in got)  # no `start`: time is NULL (O-2)
    from meterframe.operators.readings import accepted
    assert accepted(rows).count() == 0
    hdr = P.read_payloads(spark, str(tmp_path / "docs"), 1).select(
        "getconsumptionsresult.consumptiondata.sum.*").first()
    assert abs(hdr.quantity - 0.06) < 1e-7 and hdr.unit == "kWh"


def test_p2_spot_series(spark, tmp_path):
    tsv = [_tsv(q, f"2022-08-01T{h:02d}:00:00") for h, q in enumerate(P1_QTY)]
    spot_tsv = [_tsv(50.0 + h, f"2022-08-01T{h:02d}:00:00", unit="EUR/MWh") for h in range(8)]
    spot = {"sum": {"quantity": 0.0, "start": "2022-08-01T00:00:00", "stop": "2022-09-01T00:00:00", "unit": "EUR/MWh"},
            "timeseries": {"start": "2022-08-01T00:00:00", "stop": "2022-09-01T00:00:00", "resolution": "PT1H",
                           "values": {"tsv": spot_tsv}}}
    docs = P.read_payloads(spark, _land(tmp_path, [_doc("1337", "PT1H", tsv, spot=spot)]), 1)
    good, _ = P.split_documents(docs)
    s = P.explode_spot(good).collect()
    assert len(s) == 8 and all(r.time is None for r in s) and s[0].unit == "EUR/MWh"


def test_p3_dst_day_positions(spark, tmp_path):
    labels = ["00", "01", "02", "03", "04", "05", "07"]
    tsv = [_tsv(0.1 * (i + 1), f"2023-03-26T{h}:00:00", start="2023-03-01T00:00:00", day=1, night=0)
           for i, h in enumerate(labels)]
    rows, _ = _readings(spark, _land(tmp_path, [_doc("9", "PT1H", tsv, start="2023-03-26T00:00:00",
                                                     stop="2023-03-27T00:00:00")]))
    got = sorted((r.pos, r.time) for r in rows.collect())
    assert [t for _, t in got] == [dt.datetime(2023, 2, 28, 22) + dt.timedelta(hours=i) for i in range(7)]


def test_null_quantity_keeps_positions_and_quarter_alias(spark, tmp_path):
    tsv = [_tsv(0.1, "x", start="2024-01-01T00:00:00"), _tsv(None, "x", start="2024-01-01T00:00:00"),
           _tsv(0.3, "x", start="2024-01-01T00:00:00")]
    rows, _ = _readings(spark, _land(tmp_path, [_doc("7", "PT15MIN", tsv)]))
    from meterframe.operators.readings import accepted
    got = sorted((r.time, r.resolution_duration) for r in accepted(rows).collect())
    base = dt.datetime(2023, 12, 31, 22)
    assert got == [(base, "PT15M"), (base + dt.timedelta(minutes=30), "PT15M")]


@pytest.mark.parametrize("raw,norm", [("PT1H", "PT1H"), ("PT15M", "PT15M"), ("PT15MIN", "PT15M"), ("P1D", "PT1H")])
def test_resolution_normalise(spark, raw, norm):
    from pyspark.sql import functions as F
    from meterframe.functions.tariff import normalise_resolution
    assert spark.range(1).select(normalise_resolution(F.lit(raw))).first()[0] == norm


def test_strict_document_check(spark, tmp_path):
    tsv = [_tsv(0.1, "x", start="2024-01-01T00:00:00")]
    good = _doc("1", "PT1H", tsv)
    no_unit = _doc("2", "PT1H", tsv, drop=("sum", "unit"))
    no_point = _doc("3", "PT1H", tsv, drop=(None, "meteringpointcode"))
    bad_type = _doc("4", "PT1H", tsv)
    bad_type["getconsumptionsresult"]["consumptiondata"]["sum"]["quantity"] = "lots"
    untimed = _doc("5", "PT1H", [{"quantity": 0.1, "start": "2024-01-01T00:00:00"}])
    docs = P.read_payloads(spark, _land(tmp_path, [good, no_unit, no_point, bad_type, untimed]), 1)
    ok, rejected = P.split_documents(docs)
    assert [r.meteringpointcode for r in ok.select("getconsumptionsresult.consumptiondata.*").collect()] == ["1"]
    reasons = sorted(r.reason for r in rejected.collect())
    assert reasons == ["malformed", "missing meteringpointcode", "missing sum.unit", "missing tsv.time"]


def test_dst_start_rejected(spark, tmp_path):
    tsv = [_tsv(0.1, "x", start="2022-03-27T03:00:00")]
    rows, _ = _readings(spark, _land(tmp_path, [_doc("1", "PT1H", tsv)]))
    from meterframe.operators.readings import REASON_DST, reject_reason
    assert rows.select(reject_reason(rows).alias("r")).first().r == REASON_DST


def test_dst_day_document_roundtrip(spark, tmp_path):
    # 2023-10-29 has 25 local hours in Helsinki; 2023-03-26 has 23.
    rows = []
    for start, hours in ((dt.datetime(2023, 10, 28, 21), 25), (dt.datetime(2023, 3, 25, 22), 23)):
        rows += [(start + dt.timedelta(hours=h), "mp-1", 1, "PT1H", float(h), "kWh", h) for h in range(hours)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, metering_point_code string, measure_type int, "
                                     "resolution_duration string, value double, measure_unit string, seq long")
    root = str(tmp_path / "landing")
    land(as_lines(documents_from_readings(df)), root)
    docs = P.read_payloads(spark, P.side_path(root, 1), 1)
    sizes = sorted(len(r.tsv) for r in docs.select(
        F.col("getconsumptionsresult.consumptiondata.timeseries.values.tsv").alias("tsv")).collect())
    assert sizes == [23, 25]
    from meterframe.operators.readings import accepted
    back = sorted((r.time, r.value) for r in accepted(P.explode_readings(P.split_documents(docs)[0])).collect())
    assert back == sorted((r[0], r[4]) for r in rows)


def test_multiline_document(spark, tmp_path):
    tsv = [_tsv(0.5, "2024-01-01T00:00:00", start="2024-01-01T00:00:00")]
    p = tmp_path / "ml"
    p.mkdir()
    (p / "doc.json").write_text(json.dumps(_doc("42", "PT1H", tsv), indent=2))
    rows, rejected = P.explode_readings(P.read_payloads(spark, str(p), 6, multi_line=True)), None
    got = rows.collect()
    assert [(r.metering_point_code, r.measure_type, r.time) for r in got] == [("42", 6, dt.datetime(2023, 12, 31, 22))]


def test_backfill_selects_range_and_resolution(spark, tmp_path):
    from meterframe.plans.jobs import documents_in_range
    tsv = [_tsv(0.1, "x", start="2024-01-02T00:00:00")]
    docs = [_doc("a", "PT1H", tsv, start="2024-01-02T00:00:00", stop="2024-01-03T00:00:00"),
            _doc("b", "PT15M", tsv, start="2024-01-02T00:00:00", stop="2024-01-03T00:00:00"),
            _doc("c", "PT1H", tsv, start="2024-01-09T00:00:00", stop="2024-01-10T00:00:00"),
            _doc("d", "PT1H", tsv, start="2024-01-01T00:00:00", stop="2024-01-02T00:00:00")]
    df = P.read_payloads(spark, _land(tmp_path, docs), 1)

    def points(sel):
        return sorted(r[0] for r in sel.select("getconsumptionsresult.consumptiondata.meteringpointcode").collect())

    assert points(documents_in_range(df, "2024-01-01T00:00:00", "2024-01-08T00:00:00")) == ["a", "d"]
    # A document that crosses a bound overlaps the range.
    assert points(documents_in_range(df, "2024-01-01T12:00:00", "2024-01-02T12:00:00")) == ["a", "d"]
    assert points(documents_in_range(df, "2024-01-02T00:00:00", "2024-01-08T00:00:00", "PT15M")) == ["b"]


def test_text_fields_must_be_text(spark, tmp_path):
    """A number or a truth value in a text field rejects the document, though a lenient reader makes it text."""
    tsv = [_tsv(0.1, "x", start="2024-01-02T00:00:00"), _tsv(0.2, "y", start="2024-01-02T00:00:00")]
    spot = {"sum": {"quantity": 1.0, "start": "a", "stop": "b", "unit": "c"},
            "timeseries": {"start": "a", "stop": "b", "resolution": "PT1H", "values": {"tsv": tsv}}}
    fine = _doc("1", "PT1H", tsv, spot=spot)
    cd = ("getconsumptionsresult", "consumptiondata")
    wrong = {
        "mistyped meteringpointcode": (*cd, "meteringpointcode", 12345), "mistyped sum.unit": (*cd, "sum", "unit", True),
        "mistyped timeseries.resolution": (*cd, "timeseries", "resolution", 15),
        "mistyped tsv.time": (*cd, "timeseries", "values", "tsv", 1, "time", 7),
        "mistyped tsv.unit": (*cd, "timeseries", "values", "tsv", 0, "unit", {"kWh": 1}),
        "mistyped tsv.start": (*cd, "timeseries", "values", "tsv", 1, "start", ["2024"]),
        "mistyped spotdata.sum.unit": ("getconsumptionsresult", "spotdata", "sum", "unit", 1.5),
        "mistyped spotdata.tsv.time": ("getconsumptionsresult", "spotdata", "timeseries", "values", "tsv", 0, "time", 0)}
    docs = [fine, {**fine, "note": {"time": 5}}]
    for path in wrong.values():
        doc = json.loads(json.dumps(fine))
        at = doc
        for k in path[:-2]:
            at = at[k]
        at[path[-2]] = path[-1]
        docs.append(doc)
    # Optional fields may be null or absent, and unknown fields of any kind.
    loose = json.loads(json.dumps(fine))
    loose["getconsumptionsresult"]["consumptiondata"]["timeseries"]["values"]["tsv"][0].update(unit=None, start=None, day=3)
    good, rejected = P.split_documents(P.read_payloads(spark, _land(tmp_path, [*docs, loose]), 1))
    assert good.count() == 3
    assert sorted(r.reason for r in rejected.collect()) == sorted(wrong)


def test_landing_by_covered_days(spark, tmp_path):
    """A reader of a range opens only folders of documents that overlap it."""
    tsv = [_tsv(0.1, "x", start="2024-01-02T00:00:00")]
    spans = {"jan": ("2024-01-01T00:00:00", "2024-02-01T00:00:00"), "feb": ("2024-02-01T00:00:00", "2024-03-01T00:00:00"),
             "day": ("2024-01-31T00:00:00", "2024-02-01T00:00:00"), "odd": ("soon", "later"), "none": ("2024-03-05T00:00:00", "2024-03-05T00:00:00")}
    lines = [(json.dumps(_doc(p, "PT1H", tsv, start=a, stop=b)), 1) for p, (a, b) in spans.items()] + [('{"broken', 6)]
    root = str(tmp_path / "landing")
    land(spark.createDataFrame(lines, "value string, measure_type int"), root)

    def found(lo, hi):
        docs = read_landed(spark, root, lo, hi)
        return sorted(r[0] or "broken" for r in docs.select("getconsumptionsresult.consumptiondata.meteringpointcode").collect())

    assert found(None, None) == ["broken", "day", "feb", "jan", "none", "odd"]
    assert found("2024-01-31", "2024-01-31") == ["broken", "day", "jan", "odd"]
    assert found("2024-02-01", "2024-02-10") == ["broken", "feb", "odd"]
    assert found("2024-01-05", "2024-02-01") == ["broken", "day", "feb", "jan", "odd"]
    plan = read_landed(spark, root, "2024-02-01", "2024-02-10")._jdf.queryExecution().executedPlan().toString()
    assert "first_day" in plan and "PartitionFilters: []" not in plan


def test_clip_keeps_the_range(spark):
    from meterframe.plans.jobs import clip
    t = dt.datetime
    times = [t(2024, 1, 1, 21, 59), t(2024, 1, 1, 22), t(2024, 1, 2, 21, 45), t(2024, 1, 2, 22), None]
    rows = spark.createDataFrame([(x,) for x in times], "time timestamp_ntz")
    got = [r.time for r in clip(rows, "2024-01-02T00:00:00", "2024-01-03T00:00:00").collect()]
    assert got == [times[1], times[2], None]


def test_a_start_is_worked_out_once_a_document_and_own_starts_count(spark, tmp_path):
    a, b, gap, twice = "2023-03-01T00:00:00", "2023-03-05T00:00:00", "2023-03-26T03:30:00", "2023-10-29T03:30:00"
    tsv = [_tsv(1, "x", start=s) for s in (a, a, b, None, gap, twice, "soon", a)]
    docs = [_doc("1", "PT1H", tsv), _doc("2", "PT1H", tsv[3:] + tsv[:3]), _doc("3", "PT1H", tsv[4:5] + tsv[:2])]
    rows, _ = _readings(spark, _land(tmp_path, docs))
    below = rows._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode", 1)[1]
    assert "convert_timezone" in below
    first, later = dt.datetime(2023, 2, 28, 22), dt.datetime(2023, 3, 4, 22)
    own = {a: first, b: later, None: None, gap: dt.datetime(2023, 3, 26, 1, 30), twice: dt.datetime(2023, 10, 29, 0, 30), "soon": None}
    got = {(r.metering_point_code, r.pos): (r.time, r.dst_reject) for r in rows.collect()}
    for d in docs:
        cd = d["getconsumptionsresult"]["consumptiondata"]
        for i, e in enumerate(cd["timeseries"]["values"]["tsv"]):
            s = e.get("start")
            want = own[s] and own[s] + dt.timedelta(hours=i)
            assert got[cd["meteringpointcode"], i] == (want, None if own[s] is None else s in (gap, twice)), (cd["meteringpointcode"], i)


def test_few_sound_documents_are_parsed_twice_and_no_mistyped_one_is_missed(spark, tmp_path):
    entry = {"quantity": 1.0, "time": "2024-01-01T00:00:00", "start": "2024-01-01T00:00:00", "stop": "2024-01-02T00:00:00", "unit": "kWh"}
    day = {"start": entry["start"], "stop": entry["stop"]}

    def doc(point="mp-1", spot=None, **entry_fields):
        return _doc(point, "PT1H", [entry, entry | entry_fields], **day, spot=spot)

    def spot(**fields):
        return {"sum": {**day, "unit": "EUR/MWh", **fields}, "timeseries": {**day, "resolution": "PT1H", "values": {"tsv": [entry]}}}

    sound = [doc(), doc("643007574000000001"), doc(spot=spot()), doc(unit=None, start=None), doc("mp-2", day=1, night=0)]
    hidden = doc(643007574000000001)
    hidden["getconsumptionsresult"]["other"] = {"meteringpointcode": "643007574000000001"}
    odd = [hidden, doc(5), doc(True), doc({"a": 1}), *(doc(**{f: x}) for f in ("time", "start", "stop", "unit") for x in (5, -1.5, False, {"xxxxxx": "T"}, ["xxxxxxxT"])),
           doc(spot=spot(unit=7)), doc(spot=spot(start=[1]))]
    docs = P.read_payloads(spark, _land(tmp_path, [*sound, *odd]), 1)
    rows = docs.select(P._suspect("getconsumptionsresult").alias("suspect"), P.MISTYPED, P.mistyped(F.try_parse_json(P.RAW)).alias("whole")).collect()
    assert [r.suspect for r in rows] == [False] * len(sound) + [True] * len(odd)
    assert [r[P.MISTYPED] for r in rows] == [r.whole for r in rows] and sum(r.whole is not None for r in rows) == len(odd)


def test_one_pass_gives_readings_and_rejected_documents(spark, tmp_path):
    tsv = [_tsv(q, f"2024-01-01T{i:02d}:00:00", start="2024-01-01T00:00:00") for i, q in enumerate((1.0, None, 2.0))]
    docs = [_doc("1", "PT1H", tsv), _doc("2", "PT1H", []), _doc("3", "PT1H", tsv, drop=("sum", "unit")), _doc("4", "PT1H", tsv)]
    path = _land(tmp_path, docs)
    read = P.read_payloads(spark, path, 1)
    rows = P.labelled(P.explode_checked(read))
    good, rejected = P.split_documents(read)
    reading = F.col(P.DOCUMENT).isNull()
    assert sorted(map(str, rows.where(reading).drop(P.DOCUMENT).collect())) == sorted(map(str, P.explode_readings(good).collect()))
    assert rows.where(reading).count() == 6
    assert rows.where(~reading).select(f"{P.DOCUMENT}.*").collect() == rejected.select("measure_type", "_file", "reason", P.RAW).collect()
    assert rows._jdf.queryExecution().sparkPlan().toString().count("FileScan text") == 1


def test_a_truncated_document_loses_its_last_characters_only(spark):
    from meterframe.plans import payload_queries as Q
    wednesday = "2024-01-10T00:00:00"
    texts = [f'{{"timeseries":{{"start":"{wednesday}","resolution":"{r}","x":"{x}"}}}}' for r in ("PT1H", "PT15M") for x in ("a" * 500, "\u00fc\u2028" * 30 + "b" * 30)]
    lines = spark.createDataFrame([(t, 6) for t in texts], "value string, measure_type int")
    assert [r.value for r in Q.with_faults(lines).select("value").collect()] == [t[:-20] for t in texts]
    assert next(f[3] for f in Q._FAULTS if ".{20}" in f[3]).startswith("^")  # else each character is tried
