"""How close a synthetic table is to the real one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, col, is_number, is_temporal
from millrace.functions.ranking import running_sums
from millrace.operators.clean import correlation
from millrace.session import cut_lineage

PAIR_BINS = 10
CELL = "pair int, va string, vb string, n long"


def continuous_columns(df: DataFrame) -> list[str]:
    """Numbers and timestamps: compared by distribution function and correlation."""
    return [f.name for f in df.schema.fields if is_number(f.dataType) or is_temporal(f.dataType)]


def discrete_columns(df: DataFrame) -> list[str]:
    known = set(continuous_columns(df))
    return [c for c in df.columns if c not in known]


def as_number(df: DataFrame, name: str) -> Column:
    """A continuous column as double; times as seconds since 1970."""
    dtype = df.schema[name].dataType
    if is_temporal(dtype):
        # via text-free arithmetic that is the same for zoned and zone-less times
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(dtype.simpleString()), col(name)) / 1e6 if (
            dtype.simpleString() != "date"
        ) else F.datediff(col(name), F.lit("1970-01-01")).cast("double") * 86400.0
    return as_double(df, name)


def _both(real: DataFrame, synthetic: DataFrame, entries) -> DataFrame:
    """Both tables unpivoted by ``entries(df)`` under a 0/1 ``is_real`` flag."""

    def side(df: DataFrame, flag: int) -> DataFrame:
        return df.select(F.inline(F.array(*entries(df)))).withColumn("is_real", F.lit(flag))

    return side(real, 1).unionByName(side(synthetic, 0))


def _tallied(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("is_real").alias("real_n"), F.sum(1 - F.col("is_real")).alias("synthetic_n")
    )


def continuous_shapes(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, metric, score)``: one minus the Kolmogorov-Smirnov distance.

    Equal values merge before ordering; the running counts are range-partitioned.
    """
    names = continuous_columns(real) if columns is None else columns

    def entries(df):
        return [F.struct(F.lit(c).alias("column"), as_number(df, c).alias("value")) for c in names]

    steps = _tallied(_both(real, synthetic, entries).where("value IS NOT NULL"), ["column", "value"])
    steps = running_sums(steps, "value", ["real_n", "synthetic_n"], group="column")
    totals = steps.groupBy("column").agg(F.sum("real_n").alias("r"), F.sum("synthetic_n").alias("s"))
    gap = F.abs(F.try_divide("cum_real_n", "r") - F.try_divide("cum_synthetic_n", "s"))
    return (
        steps.join(F.broadcast(totals), "column")
        .groupBy("column")
        .agg((1 - F.max(gap)).alias("score"))
        .select("column", F.lit("KSComplement").alias("metric"), "score")
    )


def discrete_shapes(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, metric, score)``: one minus the total variation distance; null is a category."""
    names = discrete_columns(real) if columns is None else columns

    def entries(df):
        return [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in names]

    counts = _tallied(_both(real, synthetic, entries), ["column", "value"])
    return _variation(counts, F.col("column") == names[0], ["column"], "TVComplement")


def _variation(counts: DataFrame, one: Column, by: list[str], metric: str) -> DataFrame:
    """One minus half the summed differences of shares. A row of either table is counted once per group, so the counts of the group ``one`` add up
    to the rows of the tables, which are not read again."""
    counts = cut_lineage(counts)
    rows = counts.where(one).agg(F.sum("real_n").alias("real"), F.sum("synthetic_n").alias("synthetic")).first()
    gap = F.abs(F.col("real_n") / float(rows["real"] or 1) - F.col("synthetic_n") / float(rows["synthetic"] or 1))
    return counts.groupBy(*by).agg((1 - F.sum(gap) / 2).alias("score")).select(
        *by, F.lit(metric).alias("metric"), "score"
    )


def correlation_trends(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(a, b, metric, score)``: ``1 - |r_real - r_synthetic| / 2``; null if either r is undefined."""
    names = continuous_columns(real) if columns is None else columns

    def frame(df):
        return df.select(*[as_number(df, c).alias(c) for c in names])

    r, s = correlation(frame(real)), correlation(frame(synthetic))
    return real.sparkSession.createDataFrame(
        [
            (a, b, "CorrelationSimilarity", None if v is None or s[(a, b)] is None else 1 - abs(v - s[(a, b)]) / 2)
            for (a, b), v in r.items()
        ],
        "a string, b string, metric string, score double",
    )


def contingency_trends(real: DataFrame, synthetic: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(a, b, metric, score)``: total variation over the joint shares of two columns.

    A continuous side is cut into ten equal bins of the real range; values of the other
    table beyond it fall into the outer bins.
    """
    if pairs is None:
        numbers = set(continuous_columns(real))
        names = real.columns
        pairs = [
            (a, b) for i, a in enumerate(names) for b in names[i + 1 :] if not (a in numbers and b in numbers)
        ]
    binned = sorted({c for pair in pairs for c in pair if c in continuous_columns(real)})
    ranges = {}
    if binned:
        row = real.agg(
            *[f(as_number(real, c)).alias(f"{t}{i}") for i, c in enumerate(binned) for t, f in (("l", F.min), ("h", F.max))]
        ).first()
        ranges = {c: (row[f"l{i}"], row[f"h{i}"]) for i, c in enumerate(binned)}

    def value(df: DataFrame, c: str) -> Column:
        if c not in ranges:
            return col(c).cast("string")
        low, high = ranges[c]
        if low is None or low == high:
            return F.when(as_number(df, c).isNotNull(), "0")
        place = F.floor((as_number(df, c) - low) / ((high - low) / PAIR_BINS))
        return F.greatest(F.lit(0), F.least(F.lit(PAIR_BINS - 1), place)).cast("string")

    if not pairs:
        return real.sparkSession.createDataFrame([], "a string, b string, metric string, score double")
    names = sorted({c for pair in pairs for c in pair})
    at = [(names.index(a), names.index(b)) for a, b in pairs]

    def cells(df: DataFrame, flag: int) -> DataFrame:
        coded = df.select(*[value(df, c).alias(f"v{i}") for i, c in enumerate(names)])
        return coded.mapInArrow(_pair_counter(at), CELL).withColumn("flag", F.lit(flag))

    counts = cells(real, 1).unionByName(cells(synthetic, 0)).groupBy("pair", "va", "vb")
    counts = counts.agg(F.sum(F.col("n") * F.col("flag")).alias("real_n"), F.sum(F.col("n") * (1 - F.col("flag"))).alias("synthetic_n"))
    scores = _variation(counts, F.col("pair") == 0, ["pair"], "ContingencySimilarity")
    sides = [F.element_at(F.array(*[F.lit(p[i]) for p in pairs]), F.col("pair") + 1).alias(n) for i, n in enumerate("ab")]
    return scores.select(*sides, "metric", "score")


def _pair_counter(pairs: list[tuple[int, int]]):
    """Counts of the value pairs of each batch: a column is coded once, a pair of columns is one count over joined codes.

    A batch hands on one row per pair of columns and cell that occurs in it; Spark adds these up within the task before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = [c.cast(pa.string()).dictionary_encode(null_encoding="encode") for c in batch.columns]
            codes = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in coded]
            for at, (i, j) in enumerate(pairs):
                width = len(coded[j].dictionary)
                joined = codes[i] * width + codes[j]
                if len(coded[i].dictionary) * width <= 4 * batch.num_rows:
                    n = np.bincount(joined)
                    found = np.flatnonzero(n)
                    n = n[found]
                else:
                    found, n = np.unique(joined, return_counts=True)
                sides = [coded[i].dictionary.take(pa.array(found // width)), coded[j].dictionary.take(pa.array(found % width))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), at, np.int32)), *sides, pa.array(n.astype(np.int64))], ["pair", "va", "vb", "n"])

    return run


def quality_report(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """``(property, a, b, metric, score)`` details plus one row per property and an overall row."""
    shapes = [f(real, synthetic) for f, c in ((continuous_shapes, continuous_columns), (discrete_shapes, discrete_columns)) if c(real)]
    details = []
    for part in shapes:
        details.append(
            part.select(F.lit("Column Shapes").alias("property"), F.col("column").alias("a"), F.lit(None).cast("string").alias("b"), "metric", "score")
        )
    for part in (correlation_trends(real, synthetic), contingency_trends(real, synthetic)):
        details.append(part.select(F.lit("Column Pair Trends").alias("property"), "a", "b", "metric", "score"))
    rows = [r for part in details for r in part.collect()]
    by_property: dict[str, list[float]] = {}
    for r in rows:
        by_property.setdefault(r["property"], [])
        if r["score"] is not None:
            by_property[r["property"]].append(r["score"])
    scores = {p: sum(v) / len(v) if v else None for p, v in by_property.items()}
    known = [v for v in scores.values() if v is not None]
    out = [tuple(r) for r in rows]
    out += [(p, None, None, "Property", v) for p, v in scores.items()]
    out.append(("Overall", None, None, "Overall", sum(known) / len(known) if known else None))
    return real.sparkSession.createDataFrame(out, "property string, a string, b string, metric string, score double")
