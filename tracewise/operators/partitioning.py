"""Parallelism helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Inputs below this estimate are dealt to all cores: their files may have a single row group.
SMALL_INPUT_BYTES = 64 << 20


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Round-robin a small ``df`` over ``factor`` x the default parallelism
    before CPU-heavy text work.  The optimizer's estimate of the size decides,
    so nothing runs while planning; results are the same either way.  Large
    inputs already have more splits than cores and are returned unchanged.
    Round-robin repartitioning sorts first, so a retried task gets the same
    rows."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate >= SMALL_INPUT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * factor)
