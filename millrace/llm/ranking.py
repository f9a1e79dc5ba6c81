"""Numbers of rows inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 4_000


def with_slices(df: DataFrame, rows: int, order: Column) -> DataFrame:
    """Add ``_slice``: the place of a row's ``order`` (any long) among equal parts of its value range, ``rows`` in all."""
    parts = max(1, -(-rows // SLICE_ROWS))
    # the upper 31 bits, from 0
    high = F.shiftright(order, 33) + F.lit(1 << 30)
    return df.withColumn("_slice", F.floor(high * F.lit(parts) / F.lit(1 << 31)).cast("long"))


def running(df: DataFrame, groups: list[str], amount: Column, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the rows of the same group before this one, in (``_slice``, ``order``) order.

    Slices of a group are summed on their own; the sums of the slices before are added by a join on (group, slice), whose
    right side has one row per slice.
    """
    df = df.withColumn("_amount", amount.cast("long"))
    sums = df.groupBy(*groups, "_slice").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    base = F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")
    sums = sums.select(*keys, F.col("_slice").alias("_at"), base)
    inner = Window.partitionBy(*groups, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inner", F.coalesce(F.sum("_amount").over(inner), F.lit(0)))
    same = F.col("_slice") == F.col("_at")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = df.join(sums, same).withColumn(name, F.col("_inner") + F.col("_base"))
    return out.drop("_slice", "_at", "_base", "_inner", "_amount", *[f"_g{i}" for i in range(len(groups))])
