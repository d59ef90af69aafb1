"""Time handling on TIMESTAMP_NTZ values that hold UTC.

Only ``convert_timezone`` crosses zones, so results do not depend on the
session time zone.  Buckets are built with ``make_timestamp_ntz`` rather than
``date_trunc``/``window`` because those go through the session zone or allow
one window per projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterframe.config import DEFAULT_TZ, LOCAL_TEXT_FORMAT, LOCAL_TEXT_PATTERN
from meterframe.functions._col import col, lit



def ntz_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a ``datetime`` or text.

    ``F.lit(datetime)`` would make a session-zone TIMESTAMP; going through text
    keeps the wall-clock value whatever the session zone is.
    """
    text = value.strftime("%Y-%m-%d %H:%M:%S.%f") if hasattr(value, "strftime") else str(value)
    return F.lit(text).cast("timestamp_ntz")


def parse_local(text) -> Column:
    """Strict ``YYYY-MM-DDTHH:MM:SS`` parse into a local TIMESTAMP_NTZ (O-5).

    Anything else (a bare date, a zone suffix, an impossible date) is NULL.
    """
    t = col(text)
    return F.when(t.rlike(LOCAL_TEXT_PATTERN), t.try_cast("timestamp_ntz"))


def local_to_utc(local, tz: str = DEFAULT_TZ) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), col(local))


def utc_to_local(utc, tz: str = DEFAULT_TZ) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), col(utc))


def local_text_to_utc(text, tz: str = DEFAULT_TZ) -> Column:
    """Header/reading start and stop as UTC, NULL when unparsable (O-4)."""
    return local_to_utc(parse_local(text), tz)


def dst_gap(local, tz: str = DEFAULT_TZ) -> Column:
    """True when the local wall-clock time does not exist (spring forward)."""
    x = col(local)
    return utc_to_local(local_to_utc(x, tz), tz) != x


def dst_overlap(local, tz: str = DEFAULT_TZ) -> Column:
    """True when the local wall-clock time occurs twice (fall back)."""
    x = col(local)
    later = local_to_utc(x, tz) + F.make_dt_interval(F.lit(0), F.lit(1), F.lit(0), F.lit(0))
    return utc_to_local(later, tz) == x


def add_steps(ts, pos, step_minutes) -> Column:
    """``ts + pos * step`` as elapsed time, DST-safe on UTC values (O-2)."""
    minutes = col(pos).cast("int") * lit(step_minutes)
    return col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))


def local_hour(utc, tz: str = DEFAULT_TZ) -> Column:
    """Hour of day on the local clock (O-16)."""
    return F.hour(utc_to_local(utc, tz))


def utc_text(utc) -> Column:
    """``%Y-%m-%dT%H:%M:%S`` rendering (O-14)."""
    return F.date_format(col(utc), LOCAL_TEXT_FORMAT)


def _floor_ntz(t: Column, minutes_step: int | None) -> Column:
    minute = F.lit(0) if minutes_step is None else F.floor(F.minute(t) / minutes_step) * minutes_step
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t),
                                minute.cast("int"), F.lit(0))


def quarter_start(utc) -> Column:
    """15-minute UTC bucket start (AG-7)."""
    return _floor_ntz(col(utc), 15)


def hour_start(utc) -> Column:
    """Hour UTC bucket start (AG-7, J-3)."""
    return _floor_ntz(col(utc), None)


def _local_start(utc, tz: str, unit: str) -> Column:
    loc = utc_to_local(utc, tz)
    month = F.month(loc) if unit in ("day", "month") else F.lit(1)
    day = F.dayofmonth(loc) if unit == "day" else F.lit(1)
    start = F.make_timestamp_ntz(F.year(loc), month, day, F.lit(0), F.lit(0), F.lit(0))
    return local_to_utc(start, tz)


def local_day_start(utc, tz: str = DEFAULT_TZ) -> Column:
    """Local-day bucket as the UTC instant of local midnight (AG-8)."""
    return _local_start(col(utc), tz, "day")


def local_month_start(utc, tz: str = DEFAULT_TZ) -> Column:
    """Local-month bucket as a UTC instant (AG-9)."""
    return _local_start(col(utc), tz, "month")


def local_year_start(utc, tz: str = DEFAULT_TZ) -> Column:
    """Local-year bucket as a UTC instant (AG-9)."""
    return _local_start(col(utc), tz, "year")
