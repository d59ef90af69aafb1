"""Queries over payload documents that Spark derives from ``events``.

The documents are landed once per application below ``spark.checkpoint.dir``
and read back through the payload reader, so every query here exercises the
JSON source, the strict check and the position-based explode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.config import MEASURE_CONSUMPTION, MEASURE_PRODUCTION, RESOLUTION_HOUR, RESOLUTION_QUARTER
from meterframe.functions.timeutil import local_text_to_utc
from meterframe.operators.readings import accepted, last_write_wins
from meterframe.plans import oracles as O
from meterframe.plans.catalog import SETTINGS, prices, readings, register
from meterframe.plans.documents import documents_from_readings
from meterframe.session import work_path
from meterframe.sources import landing
from meterframe.sources import payloads as P
from meterframe.schemas import ENERGY_KEY

_LANDED: dict[tuple[str, str, str], str] = {}


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = accepted(readings(spark, sf_dir)).select(*ENERGY_KEY, "value", "measure_unit", "seq")
    return last_write_wins(ok)


def _once(spark: SparkSession, sf_dir: str, kind: str, lines: Callable[[], DataFrame]) -> str:
    """Land documents once per application; return the root."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _LANDED:
        for old in [k for k in _LANDED if k[:2] != key[:2]]:
            del _LANDED[old]
        root = work_path(spark, f"landing-{kind}")
        landing.land(lines(), root, clustered=True)
        _LANDED[key] = root
    return _LANDED[key]


def landed(spark: SparkSession, sf_dir: str) -> str:
    """Sound documents of a local day each."""
    return _once(spark, sf_dir, "days", lambda: landing.as_lines(
        documents_from_readings(_latest(spark, sf_dir), SETTINGS.tz, prices(spark, sf_dir))))


def landed_months(spark: SparkSession, sf_dir: str) -> str:
    """Sound documents of a local month each."""
    return _once(spark, sf_dir, "months", lambda: landing.as_lines(
        documents_from_readings(_latest(spark, sf_dir), SETTINGS.tz, months=True)))


#: Faults by (weekday of the document, 1 = Sunday; side or None; resolution or None): what the text is changed to.
_FAULTS = (
    (1, None, None, r'^(.*?),"unit":"kWh"', "$1"),
    (7, MEASURE_PRODUCTION, None, r'"sum":\{"quantity":([^,]+),', '"sum":{"quantity":"$1",'),
    (7, MEASURE_CONSUMPTION, None, r'"meteringpointcode":"mp-(\d+)"', '"meteringpointcode":$1'),
    (6, None, RESOLUTION_HOUR, r'^(.*?)"time":"[^"]*"', '$1"time":5'),
    (6, None, RESOLUTION_QUARTER, r'^(.*?)"time":"[^"]*",', "$1"),
    (5, MEASURE_CONSUMPTION, None, r'("spotdata":.*?)"resolution":"PT1H",', "$1"),
    (5, MEASURE_PRODUCTION, None, r'("timeseries":\{"start":"[^"]*"),"stop":"[^"]*"', "$1"),
    # All of the text first, then back: looked for from the left, each character would be tried.
    (4, MEASURE_PRODUCTION, None, r"^((?s:.*)).{20}$", "$1"),
    (4, MEASURE_CONSUMPTION, RESOLUTION_HOUR, r'("spotdata":.*?"timeseries":\{"start":)"[^"]*"', "$1true"),
)
_POINT, _RESOLUTION = r'"meteringpointcode":"?(?:mp-)?(\d+)', r'"resolution":"(PT\w+)"'
_START = r'"timeseries":\{"start":"([^"]*)"'


def with_faults(lines: DataFrame) -> DataFrame:
    """Documents of some weekdays lose a field, change its type or end early, so the strict check has every kind of work."""
    weekday = F.dayofweek(F.to_date(F.regexp_extract("value", _START, 1)))
    resolution = F.regexp_extract("value", _RESOLUTION, 1)
    changed = F.when(F.lit(False), F.lit(""))
    for day, side, res, pattern, to in _FAULTS:
        here = weekday == day
        here = here & (F.col("measure_type") == side) if side else here
        here = here & (resolution == res) if res else here
        changed = changed.when(here, F.regexp_replace("value", pattern, to))
    return lines.withColumn("value", F.coalesce(changed, F.col("value")))


def landed_faulty(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, sf_dir, "faulty", lambda: with_faults(landing.as_lines(
        documents_from_readings(_latest(spark, sf_dir), SETTINGS.tz, prices(spark, sf_dir)))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.read_landed(spark, landed(spark, sf_dir))


def good_documents(spark, sf_dir):
    return P.split_documents(documents(spark, sf_dir))[0]


# Documents in DuckDB: one per (point, side, resolution, local day) of the deduped readings.
_DAY_DOCS = """
docs AS (SELECT DISTINCT metering_point_code, measure_type, resolution_duration,
    date_trunc('day', time + INTERVAL 2 HOUR) - INTERVAL 2 HOUR AS day FROM r),
"""
_DOCS = _DAY_DOCS + "doc_state AS (SELECT *, CAST(NULL AS VARCHAR) AS reason FROM docs)"
_FAULTY_DOCS = _DAY_DOCS + """
doc_state AS (SELECT *, CASE dayofweek(day + INTERVAL 2 HOUR)
    WHEN 0 THEN 'missing sum.unit'
    WHEN 6 THEN CASE measure_type WHEN 6 THEN 'malformed' ELSE 'mistyped meteringpointcode' END
    WHEN 5 THEN CASE resolution_duration WHEN 'PT1H' THEN 'mistyped tsv.time' ELSE 'missing tsv.time' END
    WHEN 4 THEN CASE measure_type WHEN 6 THEN 'missing timeseries.stop' ELSE 'missing spotdata.timeseries.resolution' END
    WHEN 3 THEN CASE WHEN measure_type = 6 THEN 'malformed' WHEN resolution_duration = 'PT1H' THEN 'mistyped spotdata.timeseries.start' END
    END AS reason FROM docs)
"""


@register("src_payload_roundtrip", O.with_base(
    f"SELECT r.time, r.metering_point_code, r.measure_type, r.resolution_duration, "
    f"CAST(CAST(r.quantity AS FLOAT) AS DOUBLE) AS value, 'kWh' AS measure_unit "
    f"FROM r JOIN doc_state d ON d.metering_point_code = r.metering_point_code AND d.measure_type = r.measure_type "
    f"AND d.resolution_duration = r.resolution_duration "
    f"AND d.day = date_trunc('day', r.time + INTERVAL 2 HOUR) - INTERVAL 2 HOUR WHERE d.reason IS NULL", _DOCS))
def q_src_payload_roundtrip(spark, sf_dir):
    rows = accepted(P.explode_readings(good_documents(spark, sf_dir), SETTINGS.tz))
    return rows.select(*ENERGY_KEY, "value", "measure_unit")


@register("src_strict_reject", O.with_base(
    "SELECT metering_point_code, measure_type, resolution_duration, day, reason FROM doc_state "
    "WHERE reason IS NOT NULL", _FAULTY_DOCS))
def q_src_strict_reject(spark, sf_dir):
    _, rejected = P.split_documents(landing.read_landed(spark, landed_faulty(spark, sf_dir)))
    # A faulty document may be no JSON at all: the identifying fields come from its text.
    return rejected.select(F.concat(F.lit("mp-"), F.regexp_extract(P.RAW, _POINT, 1)).alias("metering_point_code"),
                           "measure_type", F.regexp_extract(P.RAW, _RESOLUTION, 1).alias("resolution_duration"),
                           local_text_to_utc(F.regexp_extract(P.RAW, _START, 1), SETTINGS.tz).alias("day"), "reason")


@register("src_reject_counts", O.with_base(
    "SELECT measure_type, reason, count(*) AS n_documents FROM doc_state WHERE reason IS NOT NULL GROUP BY 1, 2", _FAULTY_DOCS))
def q_src_reject_counts(spark, sf_dir):
    _, rejected = P.split_documents(landing.read_landed(spark, landed_faulty(spark, sf_dir)))
    return rejected.groupBy("measure_type", "reason").agg(F.count(F.lit(1)).alias("n_documents"))


@register("readings_explode_time", O.with_base(
    "SELECT d.metering_point_code, d.measure_type, d.resolution_duration, CAST(s.pos AS INTEGER) AS pos, "
    "d.day + s.pos * (CASE WHEN d.resolution_duration = 'PT1H' THEN INTERVAL 60 MINUTE ELSE INTERVAL 15 MINUTE END) AS time "
    "FROM doc_state d, LATERAL (SELECT unnest(range(0, CASE WHEN d.resolution_duration = 'PT1H' THEN 24 ELSE 96 END)) AS pos) s "
    "WHERE d.reason IS NULL", _DOCS))
def q_readings_explode_time(spark, sf_dir):
    rows = P.explode_readings(good_documents(spark, sf_dir), SETTINGS.tz)
    return rows.select("metering_point_code", "measure_type", "resolution_duration", "pos", "time")


@register("src_spot_series", O.with_base(
    "SELECT d.metering_point_code, d.measure_type, 'PT1H' AS resolution_duration, CAST(s.pos AS INTEGER) AS pos, "
    "d.day + s.pos * INTERVAL 1 HOUR AS time, CAST(CAST(p.price AS FLOAT) AS DOUBLE) AS price, 'EUR/MWh' AS unit "
    "FROM (SELECT DISTINCT metering_point_code, measure_type, day FROM doc_state WHERE reason IS NULL AND measure_type = 1) d "
    "JOIN doc_state d2 USING (metering_point_code, measure_type, day), "
    "LATERAL (SELECT unnest(range(0, 24)) AS pos) s "
    "LEFT JOIN day_ahead_prices p ON p.time = d.day + s.pos * INTERVAL 1 HOUR "
    "WHERE d2.reason IS NULL", _DOCS))
def q_src_spot_series(spark, sf_dir):
    return P.explode_spot(good_documents(spark, sf_dir), SETTINGS.tz)


@register("resolution_normalise", O.with_base(
    "SELECT resolution_duration AS raw_resolution, resolution_duration, count(*) AS n_documents "
    "FROM doc_state WHERE reason IS NULL GROUP BY 1, 2", _DOCS))
def q_resolution_normalise(spark, sf_dir):
    from meterframe.functions.tariff import normalise_resolution
    ts = "getconsumptionsresult.consumptiondata.timeseries.resolution"
    docs = good_documents(spark, sf_dir)
    return (docs.select(F.col(ts).alias("raw_resolution"), normalise_resolution(F.col(ts)).alias("resolution_duration"))
            .groupBy("raw_resolution", "resolution_duration").agg(F.count(F.lit(1)).alias("n_documents")))


@register("readings_label_check", O.with_base(
    "SELECT d.measure_type, count(*) AS n_slots, "
    "count(*) FILTER (WHERE s.pos = 0 AND dayofweek(d.day + INTERVAL 2 HOUR) = 1) AS n_label_drift, "
    "count(*) FILTER (WHERE s.pos = 0 AND dayofweek(d.day + INTERVAL 2 HOUR) = 2) AS n_label_missing "
    "FROM doc_state d, LATERAL (SELECT unnest(range(0, CASE WHEN d.resolution_duration = 'PT1H' THEN 24 ELSE 96 END)) AS pos) s "
    "GROUP BY 1", _DOCS))
def q_readings_label_check(spark, sf_dir):
    """The deprecated per-reading label time (O-3) against the position-based time (O-2).

    The first label of Monday's documents is another time, that of Tuesday's is no time.
    """
    def relabelled() -> DataFrame:
        lines = landing.as_lines(documents_from_readings(_latest(spark, sf_dir), SETTINGS.tz, prices(spark, sf_dir)))
        weekday = F.dayofweek(F.to_date(F.regexp_extract("value", _START, 1)))
        first = r'^(?<head>.*?"tsv":\[\{(?:"quantity":[^,]*,)?"time":")[^"]*'
        return lines.withColumn("value", F.when(weekday == 2, F.regexp_replace("value", first, "${head}2000-01-01T00:00:00"))
                                .when(weekday == 3, F.regexp_replace("value", first, "${head}soon")).otherwise(F.col("value")))

    docs = landing.read_landed(spark, _once(spark, sf_dir, "relabelled", relabelled))
    rows = P.explode_readings(P.split_documents(docs)[0], SETTINGS.tz)
    return rows.groupBy("measure_type").agg(
        F.count(F.lit(1)).alias("n_slots"),
        F.count_if(F.col("label_time") != F.col("time")).alias("n_label_drift"),
        F.count_if(F.col("label_time").isNull()).alias("n_label_missing"))
