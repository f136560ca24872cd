"""Even work for small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

SPLITS_PER_CORE = 2


def spread(rows: DataFrame) -> DataFrame:
    """Deal out an input that comes in fewer splits than the cores could work on.

    Parquet is read by row groups, so a small table may be one task however many cores there are, and
    the text passes are pure computation. Inputs of ordinary size have far more splits than cores and
    are left as they are: for them no exchange is added.
    """
    wanted = SPLITS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows
