"""Spreading small inputs over the cores there are."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

PIECE = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it is a scan that comes in fewer and has PIECE bytes for each.

    A table of many files or row groups stays as it is; one file with a single
    row group would otherwise be one task.
    """
    execution = df._jdf.queryExecution()
    if execution.executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df  # it has shuffles of its own
    size = int(str(execution.optimizedPlan().stats().sizeInBytes()))
    want = min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / PIECE))
    if want < 2 or execution.toRdd().getNumPartitions() >= want:
        return df
    return df.repartition(want)
