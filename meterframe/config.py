"""Job parameters and the fixed values the results depend on."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------
DEFAULT_TZ = "Europe/Helsinki"
# First instant priced at quarter-hour resolution (local midnight 2024-01-01).
DEFAULT_CUTOVER = _dt.datetime(2023, 12, 31, 22, 0, 0)
MEASURE_CONSUMPTION = 1
MEASURE_PRODUCTION = 6
CONTRACT_TYPE_CODES = {"none": 1, "fixed": 2, "spot": 3, "hybrid": 4}
NIGHT_START_HOUR = 22
NIGHT_END_HOUR = 7
TAX_PERCENTAGE = 24.0
RESOLUTION_HOUR = "PT1H"
RESOLUTION_QUARTER = "PT15M"
QUARTER_ALIASES = ("PT15M", "PT15MIN")
LOCAL_TEXT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
LOCAL_TEXT_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"
SOURCE = "meter"
PRICE_DOCUMENT_TYPE = "A44"
MEASURE_UNIT_MAX = 3
RESOLUTION_MAX = 10
# ---------------------------------------------------------------------------

# Not of the reference: a reading beyond this (or no finite number, as a quantity over the 32-bit range becomes) can't be
# summed exactly with any price below 920 per kWh, and would end the job that sums it; it is rejected.
VALUE_LIMIT = 1e8

SIDES = {"consumption": MEASURE_CONSUMPTION, "production": MEASURE_PRODUCTION}
GRAINS = ("15min", "hour", "day", "month", "year")


@dataclass(frozen=True)
class Settings:
    """Parameters shared by every job."""

    tz: str = DEFAULT_TZ
    cutover: _dt.datetime = DEFAULT_CUTOVER
    source: str = SOURCE
