"""Consecutive numbers for a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.scratch import written

RANGES = 256


def number_rows(df: DataFrame, order_col: str, start: int, out_col: str) -> DataFrame:
    """Number rows ``start``, ``start + 1``, ... in the order of a unique long column.

    Rows are numbered within ranges of ``order_col`` that hold about as many
    rows each, however sparse its values (one job finds the ranges); only the
    row counts per range go through one task. Unlike a numbering by partition
    this gives the same numbers when a lost task is run again. A number beyond
    the int range is an error.
    """
    steps = [k / RANGES for k in range(1, RANGES)]
    marks = df.agg(F.percentile_approx(F.col(order_col).cast("long"), steps, 100_000)).first()[0] or []
    bounds = F.array(*[F.lit(m).cast("long") for m in sorted(set(marks))]).cast("array<long>")
    # The place of the value among the bounds; without a lambda, which the optimizer loses sight of across the join.
    value = F.col(order_col).cast("long")
    bucketed = df.withColumn("_bucket", F.coalesce(F.array_position(F.sort_array(F.array_append(bounds, value)), value), F.lit(0)))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(order_col))
    return (
        bucketed.join(offsets, "_bucket")
        .withColumn(out_col, (F.lit(start - 1) + F.col("_offset") + inside).cast("int"))
        .drop("_bucket", "_offset")
    )


def number_within(df: DataFrame, groups: list[str], order: list[str], out_col: str) -> DataFrame:
    """Number the rows of each group 1, 2, ... by ``order``, which no two rows of a group share.

    For groups of any size: rows are dealt out by ranges of ``order`` and written down,
    so that a range stays what it is when a task is run again; they are counted by range
    and group, and only these counts are summed up along a group.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    keys = [*groups, "_range"]
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*keys).agg(F.count("*").alias("_n"))
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return ranged.join(offsets, keys).withColumn(out_col, F.col("_offset") + inside).drop("_range", "_offset")
