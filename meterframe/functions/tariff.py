"""Tariff rules of one contract row as column expressions (O-7, O-8, O-16..O-22).

Contract columns follow ``meterframe.schemas.CONTRACTS``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterframe.config import (
    CONTRACT_TYPE_CODES, NIGHT_END_HOUR, NIGHT_START_HOUR, QUARTER_ALIASES,
    RESOLUTION_HOUR, RESOLUTION_QUARTER, TAX_PERCENTAGE,
)
from meterframe.functions._col import col

FIXED_LIKE = (CONTRACT_TYPE_CODES["fixed"], CONTRACT_TYPE_CODES["hybrid"])
SPOT = CONTRACT_TYPE_CODES["spot"]
NONE = CONTRACT_TYPE_CODES["none"]


def normalise_resolution(raw) -> Column:
    """``PT15M``/``PT15MIN`` → ``PT15M``; anything else → ``PT1H`` (O-7)."""
    return (F.when(col(raw).isin(*QUARTER_ALIASES), F.lit(RESOLUTION_QUARTER))
            .otherwise(F.lit(RESOLUTION_HOUR)))


def resolution_minutes(normalised) -> Column:
    return F.when(col(normalised) == RESOLUTION_QUARTER, F.lit(15)).otherwise(F.lit(60))


def _map(pairs) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs))


def contract_type_code(name) -> Column:
    """Contract type name → SMALLINT code (O-8); unknown names are NULL."""
    return F.try_element_at(_map(CONTRACT_TYPE_CODES.items()), F.lower(col(name))).cast("short")


def contract_type_name(code) -> Column:
    return F.try_element_at(_map((v, k) for k, v in CONTRACT_TYPE_CODES.items()), col(code).cast("int"))


def is_night(hour, start=None, end=None) -> Column:
    """``hour < end or hour >= start`` with defaults 22 / 7 (O-17)."""
    h = col(hour)
    s = F.coalesce(col(start), F.lit(NIGHT_START_HOUR)) if start is not None else F.lit(NIGHT_START_HOUR)
    e = F.coalesce(col(end), F.lit(NIGHT_END_HOUR)) if end is not None else F.lit(NIGHT_END_HOUR)
    return (h < e) | (h >= s)


def transfer_fee(hour) -> Column:
    """Night or day transfer fee by the transfer night hours (O-18)."""
    night = is_night(hour, "transfer_night_start_hour", "transfer_night_end_hour")
    return F.when(night, F.col("transfer_night_fee")).otherwise(F.col("transfer_day_fee"))


def energy_night(hour) -> Column:
    return is_night(hour, "energy_night_start_hour", "energy_night_end_hour")


def energy_fee_fixed(hour) -> Column:
    """Night or day energy fee, a missing fee counts as 0 (O-19)."""
    return (F.when(energy_night(hour), F.coalesce(F.col("energy_night_fee"), F.lit(0.0)))
            .otherwise(F.coalesce(F.col("energy_day_fee"), F.lit(0.0))))


def tax_percentage() -> Column:
    return F.coalesce(F.col("tax_percentage"), F.lit(TAX_PERCENTAGE))


def energy_margin() -> Column:
    return F.coalesce(F.col("energy_margin"), F.lit(0.0))


def energy_fee_spot(spot_eur_mwh) -> Column:
    """Spot energy fee in c/kWh (O-20).

    ``spot/10 * (1 + tax/100) + margin``; without tax when the contract sets
    ``negative_no_tax`` and the price is negative.
    """
    spot = col(spot_eur_mwh)
    untaxed = F.coalesce(F.col("energy_negative_no_tax"), F.lit(False)) & (spot < 0)
    return (F.when(untaxed, spot / 10.0 + energy_margin())
            .otherwise(spot / 10.0 * (tax_percentage() / 100.0 + 1.0) + energy_margin()))


def energy_fee(contract_type, spot_eur_mwh, hour) -> Column:
    """Dispatch by contract type: none 0, fixed/hybrid O-19, spot O-20 (O-21)."""
    ct = col(contract_type)
    return (F.when(ct == NONE, F.lit(0.0))
            .when(ct.isin(*FIXED_LIKE), energy_fee_fixed(hour))
            .when(ct == SPOT, energy_fee_spot(spot_eur_mwh)))
