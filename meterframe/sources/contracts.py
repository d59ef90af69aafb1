"""Contract configuration → the flat contract dimension (SRC-5, O-5, O-6, O-8).

Users write contracts as in a YAML/JSON configuration: a side
(``consumption``/``production``), local wall-clock ``start_time`` /
``end_time`` and nested ``energy`` and ``transfer`` blocks.  Bounds are parsed
strictly and converted to UTC; a bound that falls in a DST gap or overlap is
reported by ``bound_problems`` instead of being shifted silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe import schemas
from meterframe.config import DEFAULT_TZ, SIDES
from meterframe.functions.tariff import contract_type_code
from meterframe.functions.timeutil import dst_gap, dst_overlap, local_to_utc, parse_local


def read_contract_config(spark: SparkSession, path: str) -> DataFrame:
    """Contract configuration stored as JSON lines (one contract per line)."""
    return spark.read.schema(schemas.CONTRACT_CONFIG).json(path)


def config_from_yaml(spark: SparkSession, path: str) -> DataFrame:
    """A settings file with ``consumption.contracts`` and ``production.contracts``."""
    import yaml  # configuration files are small and read once on the driver

    with open(path, encoding="utf-8") as fh:
        doc = yaml.safe_load(fh)
    return config_from_records(spark, [
        {**c, "side": side} for side in SIDES for c in (doc.get(side) or {}).get("contracts", [])])


def config_from_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    rows = []
    for r in records:
        e, t = r.get("energy") or {}, r.get("transfer") or {}
        rows.append((
            r.get("side"), r.get("start_time"), r.get("end_time"), r.get("contract_type"), r.get("tax_percentage"),
            tuple(e.get(k) for k in ("night_start_hour", "night_end_hour", "basic_fee", "day_fee",
                                     "night_fee", "margin", "negative_no_tax")),
            tuple(t.get(k) for k in ("night_start_hour", "night_end_hour", "basic_fee", "day_fee",
                                     "night_fee", "tax_fee", "negative_no_tax")),
        ))
    return spark.createDataFrame(rows, schemas.CONTRACT_CONFIG)


def _side_code():
    return F.when(F.lower("side") == "consumption", F.lit(SIDES["consumption"])) \
            .when(F.lower("side") == "production", F.lit(SIDES["production"]))


def flatten(config: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Configuration rows → ``schemas.CONTRACTS`` (bounds in UTC)."""
    def f(block, name, dtype="double"):
        return F.col(f"{block}.{name}").cast(dtype)
    return config.select(
        _side_code().alias("side"),
        local_to_utc(parse_local(F.col("start_time")), tz).alias("valid_from"),
        local_to_utc(parse_local(F.col("end_time")), tz).alias("valid_to"),
        contract_type_code(F.col("contract_type")).alias("contract_type"),
        F.col("tax_percentage").cast("double").alias("tax_percentage"),
        f("energy", "night_start_hour", "int").alias("energy_night_start_hour"),
        f("energy", "night_end_hour", "int").alias("energy_night_end_hour"),
        f("energy", "basic_fee").alias("energy_basic_fee"),
        f("energy", "day_fee").alias("energy_day_fee"),
        f("energy", "night_fee").alias("energy_night_fee"),
        f("energy", "margin").alias("energy_margin"),
        f("energy", "negative_no_tax", "boolean").alias("energy_negative_no_tax"),
        f("transfer", "night_start_hour", "int").alias("transfer_night_start_hour"),
        f("transfer", "night_end_hour", "int").alias("transfer_night_end_hour"),
        f("transfer", "basic_fee").alias("transfer_basic_fee"),
        f("transfer", "day_fee").alias("transfer_day_fee"),
        f("transfer", "night_fee").alias("transfer_night_fee"),
        f("transfer", "tax_fee").alias("transfer_tax_fee"),
    ).where(F.col("side").isNotNull())


def unusable(config: DataFrame) -> DataFrame:
    """Contracts that ``flatten`` would lose: an unknown side or type, no start (a malformed line has none of them)."""
    problem = (F.when(_side_code().isNull(), F.lit("unknown_side"))
               .when(contract_type_code(F.col("contract_type")).isNull(), F.lit("unknown_contract_type"))
               .when(F.col("start_time").isNull(), F.lit("no_start_time")))
    return config.withColumn("problem", problem).where(F.col("problem").isNotNull())


def bound_problems(config: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Bounds that do not parse, or fall in a DST gap or overlap (O-5, O-6)."""
    out = None
    for col in ("start_time", "end_time"):
        local = parse_local(F.col(col))
        problem = (F.when(F.col(col).isNull(), F.lit(None))
                   .when(local.isNull(), F.lit("unparsable"))
                   .when(dst_gap(local, tz), F.lit("dst_gap"))
                   .when(dst_overlap(local, tz), F.lit("dst_overlap")))
        part = config.select("side", F.lit(col).alias("bound"), F.col(col).alias("text"), problem.alias("problem"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("problem").isNotNull())
