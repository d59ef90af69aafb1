"""The ten 39-column roll-ups of ``energies`` (A-1..A-10, §2.6) and the cut-over.

One builder, parameterised by side and grain.  Per-row terms (``spot``,
``fee``, ``total``) are projected once before the aggregate; every sum is exact
(DECIMAL) and rounded once at the end, so the result does not depend on how
partial aggregates are combined.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterframe.config import (
    GRAINS, MEASURE_CONSUMPTION, RESOLUTION_HOUR, RESOLUTION_QUARTER, SIDES, Settings,
)
from meterframe.functions.numeric import fixed, r5, safe_ratio, unfix, widen
from meterframe.functions.tariff import FIXED_LIKE, SPOT
from meterframe.functions.timeutil import (
    hour_start, ntz_lit, local_day_start, local_month_start, local_year_start, quarter_start,
)

SIX_KEYS = ("metering_point_code", "measure_type", "contract_type", "source", "measure_unit")
THREE_KEYS = ("metering_point_code", "measure_type")
MEASURES = ("energy_fee", "energy_margin", "transfer_fee", "transfer_tax_fee", "price")


def rollup_columns(side: str) -> list[str]:
    """Output column order of a roll-up."""
    e = "energy_consumption" if side == "consumption" else "energy_production"
    cols = ["time", "metering_point_code", "measure_type", "contract_type", "source", "measure_unit",
            "tax_percentage", "night", "spot_price", "spot_price_tax", "spot_price_with_tax",
            "energy_basic_fee", "transfer_basic_fee", e, f"{e}_night", f"{e}_day", f"{e}_avg"]
    for m in MEASURES:
        cols += [m, f"{m}_night", f"{m}_day", f"{m}_avg"]
    return cols + ["energy_fee_spot_no_margin", "price_spot_no_margin"]


def cutover_filter(cutover: _dt.datetime) -> Column:
    """Hourly history before the cut-over, quarter-hours from it on (O-26)."""
    t = F.col("time")
    res = F.col("resolution_duration")
    return (((res == RESOLUTION_HOUR) & (t < ntz_lit(cutover)))
            | ((res == RESOLUTION_QUARTER) & (t >= ntz_lit(cutover))))


def derive_cutover(energies: DataFrame) -> DataFrame:
    """First quarter-hour reading (O-27)."""
    return (energies.where(F.col("resolution_duration") == RESOLUTION_QUARTER)
            .agg(F.min("time").alias("cutover")))


def bucket(grain: str, tz: str) -> Column:
    t = F.col("time")
    return {
        "15min": quarter_start(t), "hour": hour_start(t), "day": local_day_start(t, tz),
        "month": local_month_start(t, tz), "year": local_year_start(t, tz),
    }[grain]


def _terms(side: str) -> dict[str, Column]:
    """Per-row priced terms before weighting by ``value``."""
    ct = F.col("contract_type")
    spot = F.col("spot_price") * (F.col("tax_percentage") / 100.0 + 1.0)
    fee_e, mrg = F.col("energy_fee"), F.col("energy_margin")
    tr, tx = F.col("transfer_fee"), F.col("transfer_tax_fee")
    if side == "consumption":
        fee = F.when(ct.isin(*FIXED_LIKE), fee_e).when(ct == SPOT, spot + mrg)
        total = F.when(ct.isin(*FIXED_LIKE), fee_e + tr + tx).when(ct == SPOT, spot + mrg + tr + tx)
        spot_total = spot + tr + tx
    else:
        z = F.lit(0.0)
        fee = F.when(ct == SPOT, spot + mrg)
        total = F.when(ct == SPOT, spot - F.coalesce(mrg, z) - F.coalesce(tr, z) - F.coalesce(tx, z))
        spot_total = spot - F.coalesce(tr, z) - F.coalesce(tx, z)
    return {"spot": spot, "energy_fee": fee, "energy_margin": mrg, "transfer_fee": tr,
            "transfer_tax_fee": tx, "price": total, "spot_total": spot_total}


def _side_terms() -> dict[str, Column]:
    """Terms of both sides in one projection, chosen by ``measure_type``."""
    c, p = _terms("consumption"), _terms("production")
    is_c = F.col("measure_type") == MEASURE_CONSUMPTION
    return {k: F.when(is_c, c[k]).otherwise(p[k]) for k in c}


def _z_split(side: str, grain: str) -> bool:
    """Whether ``*_night`` / ``*_day`` become 0 instead of NULL."""
    return side == "production" or grain == "day"


def _z_avg(side: str, grain: str) -> bool:
    """Whether the weighted averages become 0 instead of NULL."""
    return side == "consumption" and grain in ("15min", "hour")


# ---------------------------------------------------------------------------
# Mergeable state: exact DECIMAL sums, counts and an OR.  Summing states of
# finer buckets gives exactly the state of the coarser bucket, so every grain
# can be finished from the state below it.
# ---------------------------------------------------------------------------

def _prepare(energies: DataFrame, bucket_col: Column) -> DataFrame:
    t = _side_terms()
    v = F.col("value")
    return energies.select(
        bucket_col.alias("bucket"), *SIX_KEYS, "resolution_duration", "tax_percentage", "night",
        "spot_price", "energy_basic_fee", "transfer_basic_fee", "value",
        (F.col("spot_price") * (F.col("tax_percentage") / 100.0)).alias("_spot_tax"),
        t["spot"].alias("_spot"),
        (t["spot"] * v).alias("_spot_v"),
        (t["spot_total"] * v).alias("_spot_total_v"),
        *[(t[m] * v).alias(f"_w_{m}") for m in MEASURES],
    )


def _state_aggs(wide: bool = False) -> list[Column]:
    def s(x: Column, name: str) -> Column:
        term = widen(fixed(x)) if wide else fixed(x)
        return F.sum(term).alias(name)

    night = F.col("night") == F.lit(True)
    day = F.col("night") == F.lit(False)
    aggs = [F.bool_or("night").alias("night_any")]
    for src, name in (("tax_percentage", "tax"), ("spot_price", "spot"), ("_spot_tax", "spot_tax"),
                      ("_spot", "spot_wt"), ("energy_basic_fee", "ebf"), ("transfer_basic_fee", "tbf"),
                      ("value", "v")):
        aggs += [F.count(src).alias(f"n_{name}"), s(F.col(src), f"s_{name}")]
    for src, name in [("value", "v")] + [(f"_w_{m}", m) for m in MEASURES]:
        x = F.col(src)
        aggs += [s(F.when(night, x), f"s_{name}_n"), s(F.when(day, x), f"s_{name}_d")]
    for m in MEASURES:
        aggs.append(s(F.col(f"_w_{m}"), f"s_{m}"))
    aggs += [s(F.col("_spot_v"), "s_spot_v"), s(F.col("_spot_total_v"), "s_spot_total_v")]
    return aggs


def _coarsen_aggs(state_cols: list[str], wide: bool) -> list[Column]:
    out = []
    for c in state_cols:
        if c == "night_any":
            out.append(F.bool_or(c).alias(c))
        elif c.startswith("s_") and wide:
            out.append(F.sum(widen(c)).alias(c))
        else:
            out.append(F.sum(c).alias(c))
    return out


STATE_KEYS = ("bucket",) + SIX_KEYS


def states(prepared: DataFrame, keys=SIX_KEYS, wide: bool = False) -> DataFrame:
    """Exact state per ``(bucket, *keys)`` from prepared fact rows.

    ``wide`` sums in DECIMAL(38,0) for buckets of a month or more.
    """
    return prepared.groupBy("bucket", *keys).agg(*_state_aggs(wide))


def coarsen(state: DataFrame, bucket_fn, keys, wide: bool = False) -> DataFrame:
    """State of coarser buckets: ``bucket_fn(bucket)`` and a subset of keys."""
    cols = [c for c in state.columns if c not in ("bucket", "resolution_duration") + SIX_KEYS]
    return state.groupBy(bucket_fn(F.col("bucket")).alias("bucket"), *keys).agg(*_coarsen_aggs(cols, wide))


def finish(state: DataFrame, side: str, grain: str) -> DataFrame:
    """The 39 output columns of one roll-up from its state, in one projection."""
    d = unfix
    zero = F.lit(0.0)

    def avg(name: str) -> Column:
        return F.when(F.col(f"n_{name}") > 0, d(f"s_{name}") / F.col(f"n_{name}"))

    def split(name: str, out: str) -> dict[str, Column]:
        n, dd = r5(d(f"s_{name}_n")), r5(d(f"s_{name}_d"))
        if _z_split(side, grain):
            n, dd = F.coalesce(n, zero), F.coalesce(dd, zero)
        return {f"{out}_night": n, f"{out}_day": dd}

    e = "energy_consumption" if side == "consumption" else "energy_production"
    sum_v = d("s_v")
    cols: dict[str, Column] = {
        "time": F.col("bucket"),
        "tax_percentage": avg("tax"), "night": F.col("night_any"),
        "spot_price": r5(avg("spot")), "spot_price_tax": r5(avg("spot_tax")),
        "spot_price_with_tax": r5(avg("spot_wt")),
        "energy_basic_fee": r5(avg("ebf")), "transfer_basic_fee": r5(avg("tbf")),
        e: r5(sum_v), **split("v", e), f"{e}_avg": r5(avg("v")),
    }
    for m in MEASURES:
        a = r5(safe_ratio(d(f"s_{m}"), sum_v))
        if _z_avg(side, grain):
            a = F.coalesce(a, zero)
        cols.update({m: r5(d(f"s_{m}")), **split(m, m), f"{m}_avg": a})
    cols["energy_fee_spot_no_margin"] = r5(d("s_spot_v"))
    cols["price_spot_no_margin"] = r5(d("s_spot_total_v"))
    if grain in ("month", "year"):
        cols.update({"contract_type": F.lit(None).cast("short"), "source": F.lit(None).cast("string"),
                     "measure_unit": F.lit(None).cast("string")})
    st = state.where(F.col("measure_type") == SIDES[side])
    return st.select(*[(cols[c].alias(c) if c in cols else F.col(c)) for c in rollup_columns(side)])


def rollup(energies: DataFrame, side: str, grain: str, settings: Settings = Settings()) -> DataFrame:
    """One roll-up of ``energies``, a single aggregate."""
    if side not in SIDES or grain not in GRAINS:
        raise ValueError(f"unknown roll-up {side}/{grain}")
    rows = energies.where(F.col("measure_type") == SIDES[side])
    if grain == "15min":
        rows = rows.where(F.col("resolution_duration") == RESOLUTION_QUARTER)
    else:
        rows = rows.where(cutover_filter(settings.cutover))
    wide = grain in ("month", "year")
    keys = THREE_KEYS if wide else SIX_KEYS
    return finish(states(_prepare(rows, bucket(grain, settings.tz)), keys, wide), side, grain)


def whole_hour_zone(tz: str) -> bool:
    """Whether every UTC offset of ``tz`` is a whole hour (checked on the driver)."""
    import datetime as dt
    from zoneinfo import ZoneInfo
    z = ZoneInfo(tz)
    for year in range(1970, 2040):
        for month in (1, 4, 7, 10):
            off = dt.datetime(year, month, 1, tzinfo=z).utcoffset()
            if off.total_seconds() % 3600:
                return False
    return True


def fine_states(energies: DataFrame, settings: Settings = Settings(), keep=None) -> dict[str, DataFrame]:
    """Quarter-hour, hour and day states from facts: one scan, one large shuffle.

    Quarter-hour states are keyed by resolution too: the 15-minute roll-up
    takes the quarter-hour rows, the coarser ones the rows inside the
    cut-over.  ``keep`` (e.g. a persist) is applied to levels with two
    consumers.
    """
    keep = keep or (lambda df: df)
    quarter = keep(states(_prepare(energies, quarter_start(F.col("time"))),
                          SIX_KEYS + ("resolution_duration",)))
    q15 = quarter.where(F.col("resolution_duration") == RESOLUTION_QUARTER)
    cut = (quarter.withColumnRenamed("bucket", "time").where(cutover_filter(settings.cutover))
           .withColumnRenamed("time", "bucket"))
    hour = keep(coarsen(cut, hour_start, SIX_KEYS))
    day_src = hour if whole_hour_zone(settings.tz) else cut
    day = coarsen(day_src, lambda b: local_day_start(b, settings.tz), SIX_KEYS)
    return {"15min": q15, "hour": hour, "day": day}


def coarse_states(day: DataFrame, settings: Settings = Settings(), keep=None) -> dict[str, DataFrame]:
    """Month and year states from day states."""
    keep = keep or (lambda df: df)
    month = keep(coarsen(day, lambda b: local_month_start(b, settings.tz), THREE_KEYS, wide=True))
    year = coarsen(month, lambda b: local_year_start(b, settings.tz), THREE_KEYS, wide=True)
    return {"month": month, "year": year}


def finish_all(levels: dict[str, DataFrame], sides=tuple(SIDES)) -> dict[str, DataFrame]:
    return {f"{side}_{grain}": finish(st, side, grain) for side in sides for grain, st in levels.items()}


def chained_rollups(energies: DataFrame, settings: Settings = Settings(), keep=None) -> dict[str, DataFrame]:
    """All ten roll-ups from one scan and one large shuffle (ST-1, ST-2).

    Each grain is finished from the state of the grain below it; exact sums
    make this identical to aggregating the facts directly.
    """
    keep_ = keep or (lambda df: df)
    fine = fine_states(energies, settings, keep_)
    day = keep_(fine["day"])
    return finish_all({**fine, "day": day, **coarse_states(day, settings, keep_)})
