"""Fixed schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _F, _D = T.StringType(), T.FloatType(), T.DoubleType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


TSV = T.StructType([
    _f("quantity", _F), _f("time", _S), _f("start", _S), _f("stop", _S), _f("unit", _S),
])
SUM = T.StructType([_f("quantity", _F), _f("start", _S), _f("stop", _S), _f("unit", _S)])
TIMESERIES = T.StructType([
    _f("start", _S), _f("stop", _S), _f("resolution", _S),
    _f("values", T.StructType([_f("tsv", T.ArrayType(TSV))])),
])
SERIES_DATA = T.StructType([_f("sum", SUM), _f("timeseries", TIMESERIES)])
CONSUMPTION_DATA = T.StructType([
    _f("meteringpointcode", _S), _f("sum", SUM), _f("timeseries", TIMESERIES),
])
# One meter payload document (SRC-1/2).  Unknown keys are ignored by the JSON
# reader, as by the reference's deserializer.
PAYLOAD = T.StructType([
    _f("getconsumptionsresult", T.StructType([
        _f("consumptiondata", CONSUMPTION_DATA),
        _f("spotdata", SERIES_DATA),
    ])),
])

# Flat contract dimension, bounds already in UTC; ``side`` is the measure type.
CONTRACTS = T.StructType([
    _f("side", T.IntegerType(), False),
    _f("valid_from", T.TimestampNTZType()),
    _f("valid_to", T.TimestampNTZType()),
    _f("contract_type", T.ShortType()),
    _f("tax_percentage", _D),
    _f("energy_night_start_hour", T.IntegerType()),
    _f("energy_night_end_hour", T.IntegerType()),
    _f("energy_basic_fee", _D),
    _f("energy_day_fee", _D),
    _f("energy_night_fee", _D),
    _f("energy_margin", _D),
    _f("energy_negative_no_tax", T.BooleanType()),
    _f("transfer_night_start_hour", T.IntegerType()),
    _f("transfer_night_end_hour", T.IntegerType()),
    _f("transfer_basic_fee", _D),
    _f("transfer_day_fee", _D),
    _f("transfer_night_fee", _D),
    _f("transfer_tax_fee", _D),
])
CONTRACT_ATTRS = [f.name for f in CONTRACTS.fields if f.name not in ("side", "valid_from", "valid_to")]

# Contract configuration as written by users: local wall-clock bounds and
# nested energy / transfer blocks (SRC-5).
_ENERGY_CFG = T.StructType([
    _f("night_start_hour", T.IntegerType()), _f("night_end_hour", T.IntegerType()),
    _f("basic_fee", _D), _f("day_fee", _D), _f("night_fee", _D), _f("margin", _D),
    _f("negative_no_tax", T.BooleanType()),
])
_TRANSFER_CFG = T.StructType([
    _f("night_start_hour", T.IntegerType()), _f("night_end_hour", T.IntegerType()),
    _f("basic_fee", _D), _f("day_fee", _D), _f("night_fee", _D), _f("tax_fee", _D),
    _f("negative_no_tax", T.BooleanType()),
])
CONTRACT_CONFIG = T.StructType([
    _f("side", _S), _f("start_time", _S), _f("end_time", _S), _f("contract_type", _S),
    _f("tax_percentage", _D), _f("energy", _ENERGY_CFG), _f("transfer", _TRANSFER_CFG),
])

# Readings after explode, before pricing.
READINGS = T.StructType([
    _f("time", T.TimestampNTZType()),
    _f("metering_point_code", _S),
    _f("measure_type", T.IntegerType()),
    _f("resolution_duration", _S),
    _f("value", _D),
    _f("measure_unit", _S),
    _f("seq", T.LongType()),
])

ENERGY_KEY = ["time", "metering_point_code", "measure_type", "resolution_duration"]
ENERGIES = T.StructType([
    _f("time", T.TimestampNTZType(), False),
    _f("metering_point_code", _S, False),
    _f("measure_type", T.IntegerType(), False),
    _f("contract_type", T.ShortType(), False),
    _f("source", _S),
    _f("measure_unit", _S, False),
    _f("value", _D),
    _f("energy_basic_fee", _D),
    _f("energy_fee", _D),
    _f("energy_margin", _D),
    _f("transfer_basic_fee", _D),
    _f("transfer_fee", _D),
    _f("transfer_tax_fee", _D),
    _f("tax_percentage", _D, False),
    _f("night", T.BooleanType(), False),
    _f("resolution_duration", _S, False),
    _f("spot_price", _D),
])
# Kept beside each stored fact: the load that wrote it (file time in microseconds, file).
LOAD_VERSION = T.StructType([_f("load_time", T.LongType()), _f("load_file", _S)])
ENERGY_COLUMNS = [f.name for f in ENERGIES.fields]

PRICES = T.StructType([_f("time", T.TimestampNTZType()), _f("price", _D)])
# Point form of day-ahead prices (SRC-7).
PRICE_POINTS = T.StructType([
    _f("time", T.TimestampNTZType()), _f("type_tag", _S), _f("in_domain_tag", _S),
    _f("out_domain_tag", _S), _f("document_type", _S), _f("in_domain", _S),
    _f("out_domain", _S), _f("currency", _S), _f("price_measure", _S),
    _f("curve_type", _S), _f("timestamp", _S), _f("price", _D), _f("dirty", T.IntegerType()),
])

# Denormalised priced point (SNK-7/8).
WIDE = T.StructType([
    _f("time", T.TimestampNTZType()), _f("meteringpointcode_tag", _S),
    _f("measurementtype_tag", _S), _f("resolution_duration_tag", _S),
    _f("meteringpointcode", _S), _f("measurementtype", _S), _f("resolution_duration", _S),
    _f("unit", _S), _f("timestamp", _S), _f("value", _D), _f("price", _D),
    _f("transfer_basic_fee", _D), _f("transfer_fee", _D), _f("tax_fee", _D),
    _f("basic_fee", _D), _f("energy_fee", _D), _f("contract_type", T.ShortType()),
    _f("spot_margin", _D), _f("tax_percentage", _D),
])
