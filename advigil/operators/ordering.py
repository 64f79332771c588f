"""Row numbers over a total order without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from advigil.session import stored

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row in the low 33 bits


def numbered_by_group(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """1-based position of every row within its group, for groups of any size.

    A window over the group would sort it in one task. Here Spark range-partitions
    the whole input by (group, order); each partition numbers its own rows, and the
    counts of the partitions before it are added. The sorted rows are written to the
    shared folder once, because positions and counts have to come from the same
    partitioning. The counts have one row per partition and group part, and the
    running sum over them needs one small window per group.
    """
    key = F.coalesce(F.col(group).cast("string"), F.lit("\u0000"))
    sorted_once = stored(
        df.withColumn("_group", key)
        .orderBy(F.col("_group"), *order)
        .withColumn("_row", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_part", F.shiftright("_row", _LOCAL_BITS))
    parts = sorted_once.groupBy("_group", "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
    )
    before = W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        "_group", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        sorted_once.join(offsets, ["_group", "_part"])
        .withColumn(out, F.col("_before") + F.col("_row") - F.col("_first") + 1)
        .drop("_group", "_part", "_row", "_first", "_before")
    )
