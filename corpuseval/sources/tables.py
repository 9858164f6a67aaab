"""Table input."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpuseval.operators.keyed import planned_bytes

SMALL_BYTES = 64 * 2**20
TINY_BYTES = 2**20


def spread_small(df: DataFrame, small: int = SMALL_BYTES, tiny: int = TINY_BYTES) -> DataFrame:
    """Use all cores on an input of one or few row groups.

    A file of a single row group is read by a single task, whatever the split size. Between
    ``tiny`` and ``small`` planned bytes the rows are dealt out to the cores, which costs less than
    it saves. Larger inputs come in many splits and pass unchanged: no exchange is added.
    """
    if tiny < planned_bytes(df) <= small:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df
