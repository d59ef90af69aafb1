"""Write layout shared by the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def for_write(df: DataFrame, partition_cols: list[str], sort_cols: list[str]) -> DataFrame:
    """Rebalance on the folder columns, then sort inside each task.

    The REBALANCE hint lets adaptive execution merge small pieces and split a
    folder that holds a large share of the rows (for instance one month with a
    third of all readings) across several writers, so files stay near the
    advisory size instead of one file per task and folder.  Sorting by meter
    and time keeps a meter's rows together for compression and for the
    partial aggregation of later roll-ups.
    """
    return df.hint("rebalance", *partition_cols).sortWithinPartitions(*sort_cols)
