"""The numbers behind the plots, over all rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, col, column_kinds, number_columns, without_nan
from millrace.functions.counts import value_counts
from millrace.functions.quantiles import quantiles
from millrace.functions.ranking import exact_sample

BINS = 30
TOP_CATEGORIES = 20
MANY_CATEGORIES = 50
PLOT_ROWS = 10_000
SCATTER_ROWS = 1_500
GRID_ROWS = 4_096  # rows measured against the grid at once


def _numeric(df: DataFrame, column: str) -> Column:
    if column not in number_columns(df):
        raise ValueError(f"column {column!r} does not hold numbers")
    return as_double(df, column)


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """``(bin, low, high, n)``: equal-width bins, the last one closed, empty ones included.

    A constant column gets bins half a unit to either side.
    """
    x = _numeric(df, column)
    ends = df.agg(F.min(x).alias("low"), F.max(x).alias("high")).first()
    spark = df.sparkSession
    if ends["low"] is None:
        return spark.createDataFrame([], "bin bigint, low double, high double, n bigint")
    low, high = ends["low"], ends["high"]
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins

    def edge(i: Column) -> Column:
        return F.lit(low) + i * F.lit(width)

    guess = F.least(F.floor((x - low) / width), F.lit(bins - 1))
    rows = df.select(x.alias("x"), guess.alias("g")).where("x IS NOT NULL")
    # rounding may put a value that sits on an edge one bin off
    settled = (
        F.when(F.col("x") < edge(F.col("g")), F.col("g") - 1)
        .when((F.col("x") >= edge(F.col("g") + 1)) & (F.col("g") < bins - 1), F.col("g") + 1)
        .otherwise(F.col("g"))
    )
    counts = rows.groupBy(settled.alias("bin")).agg(F.count("*").alias("n"))
    return (
        spark.range(bins)
        .withColumnRenamed("id", "bin")
        .join(counts, "bin", "left")
        .select(
            "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n")
        )
    )


def density(df: DataFrame, column: str, points: int = 200, cut: float = 0.0, reach: float | None = None) -> DataFrame:
    """``(point, x, density)``: Gaussian kernel density with Scott's bandwidth.

    The grid runs ``cut`` bandwidths (or ``reach`` value ranges) beyond the data. Every task adds its rows up on the grid,
    batch by batch, and hands on one row per point.
    """
    x = _numeric(df, column)
    s = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high")).first()
    spark = df.sparkSession
    if not s["n"] or not s["sd"]:
        return spark.createDataFrame([], "point bigint, x double, density double")
    width = s["sd"] * s["n"] ** (-1 / 5)
    margin = cut * width if reach is None else reach * (s["high"] - s["low"])
    low, high = s["low"] - margin, s["high"] + margin
    step = (high - low) / (points - 1)
    grid = low + np.arange(points) * step

    def on_grid(batches):
        total = np.zeros(points)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), GRID_ROWS):
                z = (grid[:, None] - values[None, at : at + GRID_ROWS]) / width
                total += np.exp(-0.5 * z * z).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(points)), pa.array(total)], ["point", "k"])

    values = df.select(x.alias("v")).where("v IS NOT NULL")
    sums = values.mapInArrow(on_grid, "point long, k double").groupBy("point").agg(F.sum("k").alias("k"))
    scale = 1.0 / (s["n"] * width * math.sqrt(2 * math.pi))
    return (
        spark.range(points)
        .withColumnRenamed("id", "point")
        .join(sums, "point", "left")
        .select(
            "point",
            (F.lit(low) + F.col("point") * F.lit(step)).alias("x"),
            (F.coalesce("k", F.lit(0.0)) * scale).alias("density"),
        )
    )


def box_stats(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    """One row: quartiles, whiskers (furthest values within 1.5 IQR) and outlier count."""
    x = _numeric(df, column)
    q1, q2, q3 = quantiles(df, {column: x}, [0.25, 0.5, 0.75], accuracy)[column]
    inside, outside = _fences(x, q1, q3)
    return df.agg(
        F.lit(q1).cast("double").alias("q1"),
        F.lit(q2).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(outside).alias("outliers"),
    )


def box_outliers(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    """The points beyond the whiskers, as a filter."""
    x = _numeric(df, column)
    q1, q3 = quantiles(df, {column: x}, [0.25, 0.75], accuracy)[column]
    return df.select(x.alias("value")).where(_fences(F.col("value"), q1, q3)[1])


def _fences(x: Column, q1: float | None, q3: float | None) -> tuple[Column, Column]:
    if q1 is None:
        return F.lit(False), F.lit(False)
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return (x >= low) & (x <= high), (x < low) | (x > high)


def violin(df: DataFrame, column: str, points: int = 100, cut: float = 2.0) -> DataFrame:
    """Density rows with the quartiles next to them."""
    q1, q2, q3 = quantiles(df, {column: _numeric(df, column)}, [0.25, 0.5, 0.75])[column]
    return density(df, column, points, cut).select(
        "*",
        F.lit(q1).cast("double").alias("q1"),
        F.lit(q2).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"),
    )


def top_category_rows(df: DataFrame, column: str, k: int = TOP_CATEGORIES) -> DataFrame:
    """Rows whose value is one of the ``k`` most frequent, ties by value."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col("value")).limit(k)
    return df.join(F.broadcast(top.select(F.col("value").alias("_top"))), col(column) == F.col("_top"), "left_semi")


def count_plot(df: DataFrame, column: str) -> DataFrame:
    """``(value, n)`` per category; only the top 20 when there are more than 50."""
    seen = (
        df.where(col(column).isNotNull()).select(col(column)).distinct().limit(MANY_CATEGORIES + 1).count()
    )
    if seen > MANY_CATEGORIES:
        counts = value_counts(df, [column])
        return counts.orderBy(F.col("n").desc(), "sort_value", "value").limit(TOP_CATEGORIES).select("value", "n")
    return without_nan(df.select(col(column))).groupBy(col(column).cast("string").alias("value")).agg(
        F.count("*").alias("n")
    )


def plot_sample(df: DataFrame, key: list[str], rows: int = PLOT_ROWS, seed: int = 42) -> DataFrame:
    return exact_sample(df, key, rows, seed)


def scatter(
    df: DataFrame,
    columns: list[str],
    key: list[str],
    colour: str | None = None,
    rows: int | None = SCATTER_ROWS,
    seed: int = 42,
) -> DataFrame:
    """Points of two or three number columns without gaps, an exact sample when there are many.

    ``rows=None`` keeps all points.
    """
    if not 2 <= len(columns) <= 3:
        raise ValueError("a scatter plot needs two or three columns")
    numbers = number_columns(df, columns)
    if numbers != list(columns):
        raise ValueError(f"columns {[c for c in columns if c not in numbers]} do not hold numbers")
    wanted = list(columns) + ([colour] if colour and colour not in columns else [])
    narrow = without_nan(df.select(*[col(c) for c in dict.fromkeys([*key, *wanted])])).na.drop("any", subset=wanted)
    picked = narrow if rows is None else exact_sample(narrow, key, rows, seed)
    return picked.select(*[col(c) for c in wanted])


def colour_classes(points: DataFrame, colour: str) -> DataFrame:
    """``(class, n)``: one series per distinct colour value."""
    return points.groupBy(col(colour).cast("string").alias("class")).agg(F.count("*").alias("n"))


PLOTS = ("histogram", "box", "violin", "density")


def compare_columns(
    left: DataFrame, left_column: str, right: DataFrame, right_column: str, plot: str = "histogram"
) -> DataFrame:
    """The same plot data for a column of each of two versions, told apart by ``side``."""
    if plot not in PLOTS:
        raise ValueError(f"plot must be one of {', '.join(PLOTS)}")

    def data(df: DataFrame, column: str) -> DataFrame:
        if plot == "histogram":
            return histogram(df, column)
        if plot == "box":
            return box_stats(df, column)
        if plot == "violin":
            return violin(df, column)
        return density(df, column, points=1_000, reach=0.5)

    return data(left, left_column).withColumn("side", F.lit(1)).unionByName(
        data(right, right_column).withColumn("side", F.lit(2))
    )


def compare_scatter(
    left: DataFrame,
    left_columns: list[str],
    right: DataFrame,
    right_columns: list[str],
    left_colour: str | None = None,
    right_colour: str | None = None,
) -> DataFrame:
    """``(side, x, y, colour_value, colour_class)`` of both versions, all points.

    A number colours continuously, anything else by class; a colour equal to x or y is
    ignored, and points without a colour stay.
    """

    def side(df: DataFrame, columns: list[str], colour: str | None, number: int) -> DataFrame:
        x, y = columns[:2]
        kinds = column_kinds(df)
        if colour in (x, y) or colour not in kinds:
            colour = None
        value = as_double(df, colour) if colour and kinds[colour] in ("numeric", "boolean") else F.lit(None)
        name = col(colour) if colour and kinds[colour] not in ("numeric", "boolean") else F.lit(None)
        return df.select(
            F.lit(number).alias("side"),
            _numeric(df, x).alias("x"),
            _numeric(df, y).alias("y"),
            value.cast("double").alias("colour_value"),
            name.cast("string").alias("colour_class"),
        ).where("x IS NOT NULL AND y IS NOT NULL")

    return side(left, left_columns, left_colour, 1).unionByName(side(right, right_columns, right_colour, 2))
