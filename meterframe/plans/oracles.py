"""DuckDB SQL twins of the registered queries (the correctness oracle).

The tables ``events`` … are views in the checker's DuckDB session.  Helsinki
is UTC+2 over the whole test span, so local time is ``time + INTERVAL 2 HOUR``.
Sums are exact over terms fixed to 1e-8 units, with half-even rounding, like
the Spark side.
"""

from __future__ import annotations

# Readings, prices, contracts and energies from ``events`` (FIXTURES §3).
CONTRACT_ROWS = """
  (1, TIMESTAMP '2023-01-01 00:00:00', TIMESTAMP '2023-12-24 21:59:59', 2, 4.5E0, 2.23E0, 1.23E0, CAST(NULL AS DOUBLE), 13.5E0, 3.34E0, 2.34E0, 2.35972E0, 24.0E0),
  (1, TIMESTAMP '2023-12-24 22:00:00', TIMESTAMP '2023-12-31 21:59:59', 4, 5.5E0, 3.23E0, 2.23E0, CAST(NULL AS DOUBLE), 14.5E0, 4.34E0, 3.34E0, 2.35972E0, 24.0E0),
  (1, TIMESTAMP '2023-12-31 22:00:00', CAST(NULL AS TIMESTAMP), 3, 5.5E0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0.25E0, 14.5E0, 4.34E0, 3.34E0, 2.35972E0, 24.0E0),
  (6, TIMESTAMP '2023-01-01 00:00:00', CAST(NULL AS TIMESTAMP), 3, 0.0E0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0.3E0, 0.0E0, 0.07E0, 0.07E0, 0.0E0, 24.0E0)
"""
CONTRACT_COLUMNS = ("side, valid_from, valid_to, contract_type, energy_basic_fee, day_fee, night_fee, energy_margin, "
                    "transfer_basic_fee, transfer_day, transfer_night, transfer_tax_fee, tax_percentage")


def contracts_cte(name: str = "contracts", rows: str = CONTRACT_ROWS) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {rows.strip()}) AS c({CONTRACT_COLUMNS}))"


def shared(shift: str = "- INTERVAL 15 DAY") -> str:
    """Shifted events ``b`` and the prices made of them."""
    return f"""
b AS (SELECT event_id, ts, user_id, event_type, value,
        time_bucket(INTERVAL '15 minutes', t) AS t15, date_trunc('hour', t) AS t60
      FROM (SELECT *, ts {shift} AS t FROM events)),
day_ahead_prices AS (
  SELECT t60 AS time, round(avg(value) * 100) / 100 - 40 AS price FROM b
    WHERE EXTRACT(hour FROM t60) % 7 <> 3 GROUP BY t60
  UNION ALL
  SELECT t15, max(value) - 60 FROM b WHERE event_id % 2 = 0 AND t15 <> t60 GROUP BY t15)
"""


_NIGHT = "lh < 7 OR lh >= 22"


def energies_ctes(p: str = "", where: str = "TRUE", contracts: str = "contracts", local: str = "time + INTERVAL 2 HOUR",
                  energy_night: str = _NIGHT, transfer_night: str = _NIGHT) -> str:
    """Readings ``{p}readings``, deduped ``{p}r``, local hour ``{p}h``, facts ``{p}energies``."""
    return f"""
{p}readings AS (SELECT event_id, 'mp-' || CAST(user_id AS VARCHAR) AS metering_point_code,
        CAST(CASE WHEN event_type IN ('view','click','signup') THEN 1 ELSE 6 END AS INTEGER) AS measure_type,
        CASE WHEN event_id % 3 = 0 THEN 'PT1H' ELSE 'PT15M' END AS resolution_duration,
        CASE WHEN event_id % 3 = 0 THEN t60 ELSE t15 END AS time, t60 AS hour_start,
        CASE WHEN event_id % 50 = 7 THEN NULL ELSE value / 100 END AS quantity FROM b WHERE {where}),
{p}r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY time, metering_point_code, measure_type,
        resolution_duration ORDER BY event_id DESC) AS rn FROM {p}readings WHERE quantity IS NOT NULL) WHERE rn = 1),
{p}h AS (SELECT *, EXTRACT(hour FROM {local}) AS lh FROM {p}r),
{p}energies AS (SELECT h.time, h.metering_point_code, h.measure_type, CAST(c.contract_type AS SMALLINT) AS contract_type,
  'meter' AS source, 'kWh' AS measure_unit, h.quantity AS value, c.energy_basic_fee,
  CASE WHEN c.contract_type IN (2,4) THEN CASE WHEN {energy_night} THEN night_fee ELSE day_fee END END AS energy_fee,
  c.energy_margin, c.transfer_basic_fee,
  CASE WHEN {transfer_night} THEN transfer_night ELSE transfer_day END AS transfer_fee,
  c.transfer_tax_fee, c.tax_percentage,
  CASE WHEN h.measure_type = 1 THEN ({energy_night}) ELSE FALSE END AS night,
  h.resolution_duration, COALESCE(p1.price, p2.price) / 10 AS spot_price
  FROM {p}h h JOIN {contracts} c ON c.side = h.measure_type AND h.time >= c.valid_from
    AND (c.valid_to IS NULL OR h.time <= c.valid_to)
  LEFT JOIN day_ahead_prices p1 ON p1.time = h.time
  LEFT JOIN day_ahead_prices p2 ON p2.time = h.hour_start
  WHERE NOT (h.measure_type = 1 AND c.contract_type = 1))
"""


BASE = ",\n".join([shared().strip(), contracts_cte(), energies_ctes().strip()])


def with_base(select: str, *extra_ctes: str) -> str:
    ctes = ",\n".join([BASE.strip(), *[c.strip() for c in extra_ctes]])
    return f"WITH {ctes}\n{select.strip()}"


ENERGY_KEY_COLS = ("time", "metering_point_code", "measure_type", "resolution_duration")
ENERGY_COLUMNS = ("time, metering_point_code, measure_type, contract_type, source, measure_unit, value, "
                  "energy_basic_fee, energy_fee, energy_margin, transfer_basic_fee, transfer_fee, "
                  "transfer_tax_fee, tax_percentage, night, resolution_duration, spot_price")

CUTOVER = "TIMESTAMP '2023-12-31 22:00:00'"
CUTOVER_FILTER = (f"((resolution_duration = 'PT1H' AND time < {CUTOVER}) OR "
                  f"(resolution_duration = 'PT15M' AND time >= {CUTOVER}))")

_BUCKETS = {
    "15min": "time_bucket(INTERVAL '15 minutes', time)",
    "hour": "date_trunc('hour', time)",
    "day": "date_trunc('day', time + INTERVAL 2 HOUR) - INTERVAL 2 HOUR",
    "month": "date_trunc('month', time + INTERVAL 2 HOUR) - INTERVAL 2 HOUR",
    "year": "date_trunc('year', time + INTERVAL 2 HOUR) - INTERVAL 2 HOUR",
}


def _r5(x: str) -> str:
    return f"round_even(CAST({x} AS DOUBLE) * 100000, 0) / 100000"


def _sum(x: str) -> str:
    """Exact sum of terms fixed to 1e-8 units, back to DOUBLE."""
    return f"CAST(SUM(CAST(round_even(CAST({x} AS DOUBLE) * 100000000, 0) AS BIGINT)) AS DOUBLE) / 100000000"


def _avg(x: str) -> str:
    return f"CASE WHEN COUNT({x}) > 0 THEN ({_sum(x)}) / COUNT({x}) END"


def rollup_sql(side: str, grain: str, source: str = "energies", buckets: dict[str, str] = _BUCKETS) -> str:
    """SELECT of one roll-up over a relation named ``source``."""
    mt = 1 if side == "consumption" else 6
    spot = "spot_price * (tax_percentage / 100.0 + 1.0)"
    if side == "consumption":
        fee = f"CASE WHEN contract_type IN (2, 4) THEN energy_fee WHEN contract_type = 3 THEN {spot} + energy_margin END"
        total = (f"CASE WHEN contract_type IN (2, 4) THEN energy_fee + transfer_fee + transfer_tax_fee "
                 f"WHEN contract_type = 3 THEN {spot} + energy_margin + transfer_fee + transfer_tax_fee END")
        spot_total = f"{spot} + transfer_fee + transfer_tax_fee"
        e = "energy_consumption"
    else:
        fee = f"CASE WHEN contract_type = 3 THEN {spot} + energy_margin END"
        total = (f"CASE WHEN contract_type = 3 THEN {spot} - COALESCE(energy_margin, 0) "
                 f"- COALESCE(transfer_fee, 0) - COALESCE(transfer_tax_fee, 0) END")
        spot_total = f"{spot} - COALESCE(transfer_fee, 0) - COALESCE(transfer_tax_fee, 0)"
        e = "energy_production"
    where = f"measure_type = {mt} AND " + ("resolution_duration = 'PT15M'" if grain == "15min" else CUTOVER_FILTER)
    split_z = side == "production" or grain == "day"
    avg_z = side == "consumption" and grain in ("15min", "hour")
    measures = {"energy_fee": fee, "energy_margin": "energy_margin", "transfer_fee": "transfer_fee",
                "transfer_tax_fee": "transfer_tax_fee", "price": total}

    def split(x: str, name: str) -> list[str]:
        out = []
        for part, cond in (("night", "night = TRUE"), ("day", "night = FALSE")):
            s = _r5(_sum(f"CASE WHEN {cond} THEN {x} END"))
            if split_z:
                s = f"COALESCE({s}, 0)"
            out.append(f"{s} AS {name}_{part}")
        return out

    cols = [
        f"{_avg('tax_percentage')} AS tax_percentage",
        "bool_or(night) AS night",
        f"{_r5(_avg('spot_price'))} AS spot_price",
        f"{_r5(_avg('spot_price * (tax_percentage / 100.0)'))} AS spot_price_tax",
        f"{_r5(_avg(spot))} AS spot_price_with_tax",
        f"{_r5(_avg('energy_basic_fee'))} AS energy_basic_fee",
        f"{_r5(_avg('transfer_basic_fee'))} AS transfer_basic_fee",
        f"{_r5(_sum('value'))} AS {e}", *split("value", e), f"{_r5(_avg('value'))} AS {e}_avg",
    ]
    for m, x in measures.items():
        w = f"({x}) * value"
        avg = f"CASE WHEN {_sum('value')} <> 0 THEN {_r5(f'({_sum(w)}) / ({_sum('value')})')} END"
        if avg_z:
            avg = f"COALESCE({avg}, 0)"
        cols += [f"{_r5(_sum(w))} AS {m}", *split(w, m), f"{avg} AS {m}_avg"]
    cols += [f"{_r5(_sum(f'({spot}) * value'))} AS energy_fee_spot_no_margin",
             f"{_r5(_sum(f'({spot_total}) * value'))} AS price_spot_no_margin"]
    if grain in ("month", "year"):
        keys = "metering_point_code, measure_type, CAST(NULL AS SMALLINT) AS contract_type, " \
               "CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS measure_unit"
        group = "1, metering_point_code, measure_type"
    else:
        keys = "metering_point_code, measure_type, contract_type, source, measure_unit"
        group = "1, metering_point_code, measure_type, contract_type, source, measure_unit"
    body = ",\n  ".join(cols)
    return (f"SELECT {buckets[grain]} AS time, {keys},\n  {body}\n"
            f"FROM {source} WHERE {where} GROUP BY {group}")
