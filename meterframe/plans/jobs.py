"""Job-level steps: load a batch, backfill a range, refresh roll-ups (E1, E2; O-34, O-35, ST-1..ST-4)."""

from __future__ import annotations

import datetime as _dt
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.config import Settings
from meterframe.functions.tariff import normalise_resolution
from meterframe.functions.timeutil import local_text_to_utc, ntz_lit, parse_local, utc_to_local
from meterframe.operators.pricing import build_energies
from meterframe.sources import payloads as P
from meterframe.sources.landing import read_landed
from meterframe.streaming.loads import Loads, Report

_TS = "getconsumptionsresult.consumptiondata.timeseries"


def load_range(now_utc: Column, tz: str) -> tuple[Column, Column]:
    """The scheduled load's ``[yesterday 00:00, today 00:00)`` local range as
    text (O-34)."""
    today = F.to_date(utc_to_local(now_utc, tz))
    fmt = "yyyy-MM-dd'T'00:00:00"
    return F.date_format(F.date_sub(today, 1), fmt), F.date_format(today, fmt)


def _bound(text: str) -> _dt.datetime:
    return _dt.datetime.strptime(text, "%Y-%m-%dT%H:%M:%S")


def documents_in_range(docs: DataFrame, start_local: str, stop_local: str,
                       resolution: str = "PT1H") -> DataFrame:
    """Documents whose series overlaps ``[start, stop)`` local, at one resolution
    (O-35; the backfill request's default resolution is PT1H).  A series without
    a readable range may overlap it."""
    s, e = parse_local(F.col(f"{_TS}.start")), parse_local(F.col(f"{_TS}.stop"))
    overlaps = (s < ntz_lit(_bound(stop_local))) & (e > ntz_lit(_bound(start_local)))
    same = normalise_resolution(F.col(f"{_TS}.resolution")) == F.lit(resolution)
    return docs.where(F.coalesce(overlaps, F.lit(True)) & same)


def clip(readings: DataFrame, start_local: str, stop_local: str, settings: Settings = Settings()) -> DataFrame:
    """Readings of ``[start, stop)`` local; those without a time (and rejected documents among them) stay, to be rejected as such."""
    lo, hi = (local_text_to_utc(F.lit(x), settings.tz) for x in (start_local, stop_local))
    return readings.where(F.col("time").isNull() | ((F.col("time") >= lo) & (F.col("time") < hi)))


def readings_in_range(docs: DataFrame, start_local: str, stop_local: str, resolution: str = "PT1H",
                      settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(readings of the range, rejected documents) of documents that may cross its bounds."""
    good, rejected = P.split_documents(documents_in_range(docs, start_local, stop_local, resolution))
    return clip(P.explode_readings(good, settings.tz), start_local, stop_local, settings), rejected


def backfill(docs: DataFrame, start_local: str, stop_local: str, contracts, prices: DataFrame,
             resolution: str = "PT1H", settings: Settings = Settings()) -> DataFrame:
    """Priced rows for a caller-given range (O-35)."""
    readings, _ = readings_in_range(docs, start_local, stop_local, resolution, settings)
    return build_energies(readings, contracts, prices, settings)


def run_backfill(loads: Loads, landing: str, start_local: str, stop_local: str, resolution: str = "PT1H") -> Report:
    """Load a range again from the landing (E2): both sinks, rejects, and both sides' roll-ups (ST-4).

    Only folders of documents that overlap the range are opened.
    """
    _bound(start_local), _bound(stop_local)  # the request's format is checked first
    last = (_bound(stop_local) - _dt.timedelta(seconds=1)).date().isoformat()
    docs = read_landed(loads.spark, landing, start_local[:10], last)
    rows = P.explode_checked(documents_in_range(docs, start_local, stop_local, resolution), loads.settings.tz)
    name = f"{time.time_ns() // 1000:020d}-backfill"
    return loads.apply(name, clip(rows, start_local, stop_local, loads.settings), f"{loads.rejects}/documents/epoch={name}")
