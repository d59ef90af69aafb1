"""Meter payload documents: read, strict check, explode (SRC-1..SRC-4, O-1..O-7).

Payloads are JSON documents landed per side (``measure_type`` 1 or 6); one
document carries a metering point's series for a range.  The reading time is
the series ``start`` (local wall clock) converted to UTC plus position × step,
so a DST change inside the range does not shift readings; the per-reading
``time`` label is ignored, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterframe import schemas
from meterframe.config import DEFAULT_TZ
from meterframe.functions.tariff import normalise_resolution, resolution_minutes
from meterframe.functions.timeutil import (
    add_steps, dst_gap, dst_overlap, local_to_utc, parse_local,
)

CORRUPT = "_corrupt_record"
RAW, MISTYPED = "_raw", "_mistyped"
#: A rejected document among the readings of sound ones (``explode_checked``).
DOCUMENT = "_document"
LABEL = "_label"
#: Folder columns of a landing by covered days.
COVER = ("first_day", "last_day")
PAYLOAD_READ = T.StructType(schemas.PAYLOAD.fields + [T.StructField(CORRUPT, T.StringType())])

REQUIRED = {
    "meteringpointcode": "getconsumptionsresult.consumptiondata.meteringpointcode",
    "sum.quantity": "getconsumptionsresult.consumptiondata.sum.quantity",
    "sum.start": "getconsumptionsresult.consumptiondata.sum.start",
    "sum.stop": "getconsumptionsresult.consumptiondata.sum.stop",
    "sum.unit": "getconsumptionsresult.consumptiondata.sum.unit",
    "timeseries.start": "getconsumptionsresult.consumptiondata.timeseries.start",
    "timeseries.stop": "getconsumptionsresult.consumptiondata.timeseries.stop",
    "timeseries.resolution": "getconsumptionsresult.consumptiondata.timeseries.resolution",
    "timeseries.values.tsv": "getconsumptionsresult.consumptiondata.timeseries.values.tsv",
}
_TSV = "getconsumptionsresult.consumptiondata.timeseries.values.tsv"


#: Text fields: a number or a truth value there is a fault, though a lenient reader would turn it into text.
_SERIES_TEXTS = ("sum.start", "sum.stop", "sum.unit", "timeseries.start", "timeseries.stop", "timeseries.resolution")
_ENTRY_TEXTS = ("time", "start", "stop", "unit")


def read_payloads(spark: SparkSession, path: str, measure_type: int, multi_line: bool = False) -> DataFrame:
    """Typed payload documents of one side with file lineage (SRC-1/2), one a line or (``multi_line``) one a file.

    ``_file`` and ``_file_time`` (modification time) order documents for
    last-write-wins; unknown JSON keys are ignored.
    """
    return typed_documents(spark.read.text(path, wholetext=multi_line), measure_type)


def typed_documents(lines: DataFrame, measure_type: int) -> DataFrame:
    """Documents of a text source, batch or stream: the typed read, the raw text and the first mistyped field.

    The folder columns of a landing by covered days (``sources.landing``) stay.
    """
    folders = [F.col(c).cast("string").alias(c) for c in COVER if c in lines.columns]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowNonNumericNumbers": "false"}
    # Rows of a generator: conditions on the parsed fields stay above it, so a document is parsed once.
    parsed = F.inline(F.array(F.struct(F.from_json("value", PAYLOAD_READ, options).alias("_doc"))))
    df = lines.where(F.trim("value") != "").select(
        F.col("value").alias(RAW), F.lit(measure_type).alias("measure_type"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_modification_time").alias("_file_time"), *folders, parsed)
    return df.select("_doc.*", *(c for c in df.columns if c != "_doc"),
                     F.when(_suspect("_doc.getconsumptionsresult"), mistyped(F.try_parse_json(RAW))).alias(MISTYPED))


#: How a number, a truth value, an object or a list begins, read as text.
_NO_TEXT = [*"0123456789-tf{["]


def _may_be_no_text(x: Column) -> Column:
    """Whether a field read as text may have been something else; what can't be told is left to ``mistyped``."""
    return F.substring(x, 1, 1).isin(_NO_TEXT)


def _may_be_no_time(x: Column) -> Column:
    # No number has a T, and what begins with a truth value or a bracket comes after all digits.
    return (F.substring(x, 11, 1) != "T") | (x >= "[")


def _suspect(result: str) -> Column:
    """Whether a document may hold a mistyped field, by what the typed read made of the fields: this spares most
    documents the second parse.  (A metering point may well be named by digits: where its name stands once and nothing is
    written in escapes, the text tells.)"""
    code, raw, name = F.col(f"{result}.consumptiondata.meteringpointcode"), F.col(RAW), '"meteringpointcode"'
    quoted = [raw.contains(F.concat(F.lit(f'{name}:{space}"'), code, F.lit('"'))) for space in ("", " ")]
    once = F.length(F.replace(raw, F.lit(name), F.lit(""))) == F.length(raw) - len(name)
    found = F.coalesce(_may_be_no_text(code) & ~((quoted[0] | quoted[1]) & once & ~raw.contains("\\u")), F.lit(False))
    for part in ("consumptiondata", "spotdata"):
        series = F.col(f"{result}.{part}")
        for f in _SERIES_TEXTS:
            section, field = f.split(".")
            found = found | F.coalesce(_may_be_no(field)(series[section][field]), F.lit(False))
        for f in _ENTRY_TEXTS:
            values, odd = series["timeseries"]["values"]["tsv"][f], _may_be_no(f)
            any_odd = F.exists(values, odd)
            if f != "time":
                # The entries of a series mostly say the same.
                least = F.array_min(values)
                any_odd = F.when(least == F.array_max(values), odd(least)).otherwise(any_odd)
            found = found | F.coalesce(any_odd, F.lit(False))
    return found


def _may_be_no(field: str):
    return _may_be_no_text if field in ("unit", "resolution") else _may_be_no_time


def _not_text(variant: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return F.coalesce(~kind.isin("STRING", "VOID"), F.lit(False))


def _entry_not_text(field: str):
    return lambda entry: _not_text(entry, f"$.{field}")


def mistyped(document: Column) -> Column:
    """The first text field that holds something else, NULL if there is none (SRC-3).

    The typed read turns numbers into text, so the kinds are asked of the
    document as VARIANT.  A document that can't be held as one is left to the
    typed read.
    """
    root = "$.getconsumptionsresult"
    fields = [("meteringpointcode", f"{root}.consumptiondata.meteringpointcode")]
    fields += [(f"{name}{f}", f"{root}.{part}.{f}") for name, part in (("", "consumptiondata"), ("spotdata.", "spotdata"))
               for f in _SERIES_TEXTS]
    found = F.when(F.lit(False), F.lit(""))
    for name, path in fields:
        found = found.when(_not_text(document, path), F.lit(name))
    for name, part in (("", "consumptiondata"), ("spotdata.", "spotdata")):
        entries = F.try_variant_get(document, f"{root}.{part}.timeseries.values.tsv", "array<variant>")
        for f in _ENTRY_TEXTS:
            found = found.when(F.exists(entries, _entry_not_text(f)), F.lit(f"{name}tsv.{f}"))
    return found


def document_problem(doc: DataFrame) -> Column:
    """Why a whole document is rejected, NULL when it is valid (SRC-3)."""
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed"))
    for name, path in REQUIRED.items():
        reason = reason.when(F.col(path).isNull(), F.lit(f"missing {name}"))
    # A text is not found (NULL) among others and NULLs: generated code, where ``exists`` goes from entry to entry.
    times, none = F.col(f"{_TSV}.time"), F.array_contains(F.col(f"{_TSV}.time"), "")
    untimed = none.isNull() | (none & F.exists(times, lambda t: t.isNull()))
    reason = reason.when(untimed, F.lit("missing tsv.time"))
    # The spot block is optional; where it stands, it must hold a whole series.
    spot = "getconsumptionsresult.spotdata"
    for part in ("timeseries.start", "timeseries.stop", "timeseries.resolution", "timeseries.values.tsv"):
        reason = reason.when(F.col(spot).isNotNull() & F.col(f"{spot}.{part}").isNull(), F.lit(f"missing spotdata.{part}"))
    return reason.when(F.col(MISTYPED).isNotNull(), F.concat(F.lit("mistyped "), F.col(MISTYPED)))


def split_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) documents; rejected carry ``reason``."""
    tagged = docs.withColumn("reason", document_problem(docs))
    good = tagged.where(F.col("reason").isNull()).drop("reason", CORRUPT, RAW, MISTYPED)
    return good, tagged.where(F.col("reason").isNotNull())


def _explode(docs: DataFrame, series: str, tz: str, keep: list, where: Column | None = None) -> DataFrame:
    """One row per entry of a series; given ``where``, documents that do not meet it keep one row without an entry."""
    ts = f"getconsumptionsresult.{series}.timeseries"
    res_raw = F.col(f"{ts}.resolution")
    tsv = F.col(f"{ts}.values.tsv")
    entries = F.posexplode(tsv) if where is None else F.posexplode_outer(F.when(where, tsv))
    # The entries of a series as a rule name the same start: the first one's is worked out once a document.
    docs = docs.select("*", F.get(tsv, F.lit(0))["start"].alias("_start"))
    docs = docs.select("*", parse_local(F.col("_start")).alias("_local"))
    docs = docs.select("*", local_to_utc(F.col("_local"), tz).alias("_utc"), _dst(F.col("_local"), tz).alias("_reject"))
    rows = docs.select(*keep, res_raw.alias("raw_resolution"),
                       normalise_resolution(res_raw).alias("resolution_duration"),
                       resolution_minutes(normalise_resolution(res_raw)).alias("_step"),
                       "_start", "_local", "_utc", "_reject", entries.alias("pos", "tsv"))
    same = F.col("tsv.start") == F.col("_start")
    own = parse_local(F.col("tsv.start"))
    return rows.select(
        "*",
        F.when(same, F.col("_local")).otherwise(own).alias("start_local"),
        F.when(same, F.col("_reject")).otherwise(_dst(own, tz)).alias("dst_reject"),
        add_steps(F.when(same, F.col("_utc")).otherwise(local_to_utc(own, tz)), F.col("pos"), F.col("_step")).alias("time"),
    )


def _dst(local: Column, tz: str) -> Column:
    """Whether a local time does not exist or occurs twice (O-6)."""
    return dst_gap(local, tz) | dst_overlap(local, tz)


def explode_readings(docs: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """One row per series position, before any filter (O-1, O-2).

    Output follows ``schemas.READINGS`` plus ``pos``, ``raw_resolution``,
    ``label_time`` (the deprecated per-reading label, O-3) and ``dst_reject``.
    ``seq`` orders copies of a key: later file, then later position.
    """
    return labelled(_entries(docs, tz), tz)


def labelled(rows: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Rows with the time of their label in place of its text."""
    time = local_to_utc(parse_local(F.col(LABEL)), tz).alias("label_time")
    return rows.select(*(time if c == LABEL else c for c in rows.columns))


def _entries(docs: DataFrame, tz: str) -> DataFrame:
    cd = "getconsumptionsresult.consumptiondata"
    keep = ["measure_type", "_file", "_file_time",
            F.col(f"{cd}.meteringpointcode").alias("metering_point_code"),
            F.col(f"{cd}.sum.unit").alias("measure_unit")]
    checked = DOCUMENT in docs.columns
    rows = _explode(docs, "consumptiondata", tz, [*keep, DOCUMENT] if checked else keep, F.col(DOCUMENT).isNull() if checked else None)
    if checked:
        rows = rows.where(F.col(DOCUMENT).isNotNull() | F.col("pos").isNotNull())
    return rows.select(
        "time", "metering_point_code", "measure_type", "resolution_duration",
        F.col("tsv.quantity").cast("double").alias("value"), "measure_unit",
        F.struct(F.col("_file_time"), F.col("_file"), F.col("pos")).alias("seq"),
        "pos", "raw_resolution",
        F.col("tsv.time").alias(LABEL),
        "dst_reject", *([DOCUMENT] if checked else []),
    )


def explode_checked(docs: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Readings of the sound documents and, in the same pass, a row for each rejected one.

    That row has nothing but ``DOCUMENT`` (side, file, reason and text of the document), which readings have not.
    Labels stay texts: most slots are empty, and dropped before ``labelled`` makes times of the others' labels.
    """
    reason = document_problem(docs)
    rejected = F.struct("measure_type", "_file", reason.alias("reason"), RAW)
    return _entries(docs.withColumn(DOCUMENT, F.when(reason.isNotNull(), rejected)), tz)


def explode_spot(docs: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Embedded spot series rows of documents that carry one (SRC-4)."""
    cd = "getconsumptionsresult.consumptiondata"
    has = docs.where(F.col("getconsumptionsresult.spotdata").isNotNull())
    keep = ["measure_type", F.col(f"{cd}.meteringpointcode").alias("metering_point_code"),
            F.col("getconsumptionsresult.spotdata.sum.unit").alias("unit")]
    rows = _explode(has, "spotdata", tz, keep)
    return rows.select("metering_point_code", "measure_type", "resolution_duration", "pos", "time",
                       F.col("tsv.quantity").cast("double").alias("price"), "unit")


def side_path(root: str, measure_type: int) -> str:
    return f"{root.rstrip('/')}/measure_type={measure_type}"
