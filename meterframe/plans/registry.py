"""Every registered query: importing the query modules registers them in the catalog."""

from meterframe.plans import catalog
from meterframe.plans import clock_queries  # noqa: F401
from meterframe.plans import operator_queries  # noqa: F401
from meterframe.plans import payload_queries  # noqa: F401
from meterframe.plans import store_queries  # noqa: F401
from meterframe.plans import stream_queries  # noqa: F401
from meterframe.plans import wide_queries  # noqa: F401

QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES
