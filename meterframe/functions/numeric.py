"""Exact sums and rounding.

Each term is fixed to 8 decimals as a whole number of 1e-8 units
(``rint(x * 1e8)`` as BIGINT), so sums are exact integers: independent of the
order in which partial aggregates are combined, and free of the double→decimal
text conversion.  Groups with a bounded number of rows (a quarter-hour, hour
or day of one meter holds at most one fact per slot and resolution) sum in
BIGINT; wide groups (month, year) sum in DECIMAL(38,0), which cannot
overflow.  Any overflow raises under ANSI mode instead of wrapping.  The sum
goes back to DOUBLE before the one division and the five-decimal rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterframe.functions._col import col

SCALE = 100_000_000.0
WIDE = "decimal(38,0)"


def r5(x) -> Column:
    """Round half-to-even to five decimals (O-29); ``round`` would be half-up."""
    return F.rint(col(x) * 100000.0) / 100000.0


def fixed(x) -> Column:
    """A term as an integer count of 1e-8 units (fails loudly beyond ±9.2e10)."""
    return F.rint(col(x) * SCALE).cast("long")


def widen(total) -> Column:
    """A BIGINT partial sum as DECIMAL(38,0) before summing many of them."""
    return col(total).cast(WIDE)


def unfix(total) -> Column:
    """An exact sum of ``fixed`` terms back to DOUBLE."""
    return col(total).cast("double") / SCALE


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` only when ``den`` is non-zero (O-30)."""
    return F.when(den != 0, num / den)
