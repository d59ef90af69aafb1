"""meterframe: electricity metering and tariff analytics on Spark.

Meter payloads become priced readings in an ``energies`` fact table, which is
rolled up per 15 minutes, hour, local day, month and year.  Everything is
expressed with DataFrames and built-in Spark SQL functions.
"""

from meterframe.config import Settings

__all__ = ["Settings"]
