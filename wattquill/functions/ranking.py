"""Row numbers that do not put a large group into one task."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_row_number(
    df: DataFrame, keys: Sequence[str], levels: Sequence[str], order: Sequence[str | Column], name: str
) -> DataFrame:
    """`row_number()` over (keys ORDER BY levels, order).

    `levels` are columns of `df` that follow the order, from coarse to fine: day, minute, second; the
    digits of a hash. Rows are numbered within their finest bucket; what lies in earlier buckets comes
    from the bucket counts, level by level, so that no window holds more than the rows of one finest
    bucket or the buckets within one coarser bucket. There is one plan for groups of any size.
    """
    keys, levels = list(keys), list(levels)
    every = [*keys, *levels]
    sizes = df.groupBy(*every).agg(F.count(F.lit(1)).alias("_n"))
    offsets = None
    for depth in range(1, len(levels) + 1):
        outer, at = [*keys, *levels[: depth - 1]], levels[depth - 1]
        earlier = Window.partitionBy(*outer).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        counted = sizes if depth == len(levels) else sizes.groupBy(*outer, at).agg(F.sum("_n").alias("_n"))
        before = counted.select(*outer, at, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        if offsets is not None:
            joined = _null_safe_join(before, offsets.withColumnRenamed("_before", "_outer"), outer)
            before = joined.select(*outer, at, (F.col("_before") + F.col("_outer")).alias("_before"))
        offsets = before
    within = Window.partitionBy(*every).orderBy(*order)
    numbered = df.withColumn(name, F.row_number().over(within))
    joined = _null_safe_join(numbered, offsets, every)
    return joined.select(*df.columns, (F.col(name) + F.col("_before")).alias(name))


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join in which NULL keys meet; keeps the keys of the left side."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    return left.join(renamed, same).drop(*[f"_right_{c}" for c in on])
