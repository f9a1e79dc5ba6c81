"""Value counts of many columns in one shuffle, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import FRACTIONAL, col, is_number

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, sort_value, n)`` for every non-null value of every column.

    Whole numbers and doubles are grouped as such, everything else as text; ``value`` is
    the text form and ``sort_value`` orders numbers as numbers. Counting combines on the
    map side, so a value held by a third of all rows costs one row per task.
    """
    entries, numeric_text = [], []
    for i, name in enumerate(columns):
        dtype = df.schema[name].dataType
        whole, number = isinstance(dtype, WHOLE), isinstance(dtype, T.DoubleType)
        if is_number(dtype) and not (whole or number):
            numeric_text.append(i)
        entries.append(
            F.struct(
                F.lit(i).alias("at"),
                (col(name) if whole else F.lit(None)).cast("long").alias("whole"),
                (_present(df, name) if number else F.lit(None)).cast("double").alias("number"),
                (F.lit(None) if whole or number else _present(df, name)).cast("string").alias("text"),
            )
        )
    counts = (
        df.select(F.inline(F.array(*entries)))
        .where("whole IS NOT NULL OR number IS NOT NULL OR text IS NOT NULL")
        .groupBy("at", "whole", "number", "text")
        .agg(F.count("*").alias("n"))
    )
    order = F.coalesce("number", F.col("whole").cast("double"))
    if numeric_text:
        order = F.coalesce(order, F.when(F.col("at").isin(numeric_text), F.col("text").cast("double")))
    return counts.select(
        F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("at") + 1).alias("column"),
        F.coalesce("text", F.col("whole").cast("string"), F.col("number").cast("string")).alias("value"),
        order.alias("sort_value"),
        "n",
    )


def _present(df: DataFrame, name: str) -> Column:
    value = col(name)
    if isinstance(df.schema[name].dataType, FRACTIONAL):
        return F.when(~F.isnan(value), value)
    return value


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on ties; absent for all-null columns."""
    if not columns:
        return {}
    rows = (
        value_counts(df, columns)
        .groupBy("column")
        .agg(F.min_by("value", F.struct(-F.col("n"), "sort_value", "value")).alias("value"))
        .collect()
    )
    found = {r["column"]: r["value"] for r in rows}
    return {c: found[c] for c in columns if c in found}


def typed_literal(df: DataFrame, name: str, text: str) -> Column:
    """A literal of the column's type from the text form ``value_counts`` uses."""
    return F.lit(text).cast(df.schema[name].dataType)


def distinct_counts(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> dict[str, int]:
    """Distinct values per column; ``counts`` are their value counts, if at hand."""
    if not columns:
        return {}
    counts = value_counts(df, columns) if counts is None else counts
    rows = counts.groupBy("column").agg(F.count("*").alias("n")).collect()
    found = {r["column"]: r["n"] for r in rows}
    return {c: found.get(c, 0) for c in columns}


def top_values(df: DataFrame, columns: list[str], k: int, counts: DataFrame | None = None) -> DataFrame:
    """``(column, rank, value, n)``: the k most frequent values, ties by value.

    The window runs on value counts, cut to k rows per column and hash slice before the
    final ranking so that no task ranks all values of a wide column.
    """
    order = [F.col("n").desc(), F.col("sort_value"), F.col("value")]
    counts = value_counts(df, columns) if counts is None else counts
    counts = counts.withColumn("_slice", F.pmod(F.xxhash64("value"), F.lit(256)))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column", "_slice").orderBy(*order)))
    best = ranked.where(F.col("rank") <= k).drop("rank")
    return (
        best.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
        .where(F.col("rank") <= k)
        .select("column", F.col("rank").cast("long").alias("rank"), "value", "n")
    )


def categories(df: DataFrame, name: str, limit: int | None = None) -> list:
    """Sorted distinct non-null values; with ``limit``, at most one more than that."""
    values = df.where(col(name).isNotNull()).select(col(name)).distinct().orderBy(col(name))
    return [r[0] for r in (values if limit is None else values.limit(limit + 1)).collect()]
