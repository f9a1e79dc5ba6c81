"""Synthetic rows from a Gaussian copula."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import FRACTIONAL, as_double, col, is_number, is_temporal, without_nan
from millrace.functions.counts import distinct_counts, value_counts
from millrace.functions.ranking import running_sums
from millrace.operators.clean import correlation
from millrace.operators.quality import as_number, quality_report
from millrace.session import cut_lineage

GRID = 1_000
MAX_DECIMALS = 6
BUCKETS = 64
BELOW_ONE = 1 - 2**-53


def detect_roles(df: DataFrame) -> dict[str, str]:
    """Column -> ``numerical``, ``datetime``, ``categorical``, ``id`` or ``unknown``.

    Whole non-negative numbers with at most ten values count as categories; columns of
    all-different whole numbers or texts as ids; texts with a distinct value for more than
    every fifth row are free text. The thresholds are those of the metadata detection of a public synthesis library.
    """
    numeric = [f.name for f in df.schema.fields if is_number(f.dataType)]
    temporal = [f.name for f in df.schema.fields if is_temporal(f.dataType)]
    counted = [c for c in df.columns if c not in temporal]
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(numeric):
        x = as_double(df, c)
        aggs.append(F.count_if((x != F.floor(x)) | (x < 0)).alias(f"odd{i}"))
        aggs.append(F.count(x).alias(f"n{i}"))
    row = df.agg(*aggs).first()
    unique = distinct_counts(df, counted) if counted else {}
    rows = row["rows"]
    roles = {}
    for c in df.columns:
        dtype = df.schema[c].dataType
        if c in temporal:
            roles[c] = "datetime"
        elif c in numeric:
            i = numeric.index(c)
            plain = row[f"odd{i}"] == 0 and row[f"n{i}"] == rows and rows > 5
            if plain and unique[c] <= min(round(rows / 10), 10):
                roles[c] = "categorical"
            elif plain and unique[c] == rows:
                roles[c] = "id"
            else:
                roles[c] = "numerical"
        elif isinstance(dtype, T.BooleanType):
            roles[c] = "categorical"
        elif rows > 5 and unique[c] == rows:
            roles[c] = "id"
        elif rows <= 5 or unique[c] <= max(round(rows / 5), 1):
            roles[c] = "categorical"
        else:
            roles[c] = "unknown"
    return roles


def roles_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(list(detect_roles(df).items()), "column string, role string")


@dataclass
class Copula:
    """Marginals and the correlation of normal scores.

    Grids and correlations are small whatever the table's size. ``shares`` has a table per category column, ``(value, start,
    end, middle)``: the value's part of the unit interval, and the normal score of its middle.
    """

    columns: list[str]
    types: dict[str, T.DataType]
    roles: dict[str, str]
    grids: dict[str, list[float]]
    shares: dict[str, DataFrame]
    gaps: dict[str, float]
    decimals: dict[str, int | None]
    cholesky: list[list[float]]

    @property
    def modelled(self) -> list[str]:
        return [c for c in self.columns if c in self.grids or c in self.shares]


def _probabilities() -> np.ndarray:
    """Grid probabilities, the ends pulled in by half a step so their normal scores are finite."""
    p = np.linspace(0.0, 1.0, GRID + 1)
    p[0], p[-1] = 0.25 / GRID, 1 - 0.25 / GRID
    return p


def _scores() -> np.ndarray:
    return np.array([NormalDist().inv_cdf(float(p)) for p in _probabilities()])


def fit_copula(df: DataFrame) -> Copula:
    """Learn marginals and dependence in a fixed number of passes.

    Quantile grids, gaps and decimals share one aggregate; category shares another; the
    correlation of normal scores a third, for which each batch looks its values up in the
    grids.
    """
    df = without_nan(df)
    roles = detect_roles(df)
    numbers = [c for c in df.columns if roles[c] in ("numerical", "datetime")]
    labels = [c for c in df.columns if roles[c] == "categorical"]
    probs = [float(p) for p in np.linspace(0, 1, GRID + 1)]
    # each number is worked out once per row, below the aggregates that share it
    flat = df.select(
        *[as_number(df, c).alias(f"x{i}") for i, c in enumerate(numbers)],
        *[col(c).isNotNull().alias(f"p{i}") for i, c in enumerate(df.columns)],
    )
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(f"p{i}").alias(f"n{i}"))
    for i, c in enumerate(numbers):
        x = F.col(f"x{i}")
        aggs += [F.percentile_approx(x, probs, 10 * GRID).alias(f"q{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
        aggs += [F.count_if(x != F.round(x, d)).alias(f"d{i}_{d}") for d in range(MAX_DECIMALS + 1)]
    row = flat.agg(*aggs).first()
    rows = row["rows"]
    if rows < 2:
        raise ValueError("learning a distribution needs at least two rows")
    gaps = {c: 1 - row[f"n{i}"] / rows for i, c in enumerate(df.columns)}
    grids, decimals = {}, {}
    for i, c in enumerate(numbers):
        if row[f"q{i}"] is None:
            continue
        grids[c] = [row[f"l{i}"], *row[f"q{i}"][1:-1], row[f"h{i}"]]
        decimals[c] = next((d for d in range(MAX_DECIMALS + 1) if row[f"d{i}_{d}"] == 0), None)
    labels = [c for c in labels if gaps[c] < 1]
    shares = category_shares(df, labels) if labels else {}
    fitted = Copula(df.columns, {f.name: f.dataType for f in df.schema.fields}, roles, grids, shares, gaps, decimals, [])
    fitted.cholesky = _factor(df, fitted)
    return fitted


def category_shares(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """The parts of the unit interval, the most frequent value first, for any number of values; fixed in shared storage."""
    counts = value_counts(df, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    ordered = counts.join(F.broadcast(totals), "column")  # one row per column
    ordered = ordered.select("column", F.struct((-F.col("n")).alias("fewer"), "value").alias("place"), "n", "total")
    ends = running_sums(ordered, "place", ["n"], "column")
    parts = ends.select(
        "column",
        F.col("place.value").alias("value"),
        ((F.col("cum_n") - F.col("n")) / F.col("total")).alias("start"),
        (F.col("cum_n") / F.col("total")).alias("end"),
    )

    def with_middle(batches):
        for batch in batches:
            middle = ((batch["start"] + batch["end"]) / 2).clip(1e-9, 1 - 1e-9)
            yield batch.assign(middle=[NormalDist().inv_cdf(p) for p in middle])

    kind = "column string, value string, start double, end double, middle double"
    table = cut_lineage(parts.mapInPandas(with_middle, kind))
    return {c: table.where(F.col("column") == c).drop("column") for c in columns}


def normal_scores(df: DataFrame, fitted: Copula) -> DataFrame:
    """``z0..zk``: each modelled value as a standard normal score."""
    names = fitted.modelled
    rows = df.select(
        *[
            (as_number(df, c) if c in fitted.grids else col(c).cast("string")).alias(f"v{i}")
            for i, c in enumerate(names)
        ]
    )
    tables = {}
    z = _scores()
    for i, c in enumerate(names):
        if c in fitted.grids:
            points, at = np.unique(np.array(fitted.grids[c]), return_inverse=True)
            tables[i] = (points, np.bincount(at, weights=z) / np.bincount(at))
        else:
            middles = fitted.shares[c].select(F.col("value").alias("_value"), F.col("middle").alias("_middle"))
            rows = rows.join(middles, F.col(f"v{i}") == F.col("_value"), "left").withColumn(f"v{i}", F.col("_middle"))
            rows = rows.drop("_value", "_middle")

    def look_up(batches):
        for batch in batches:
            out = {}
            for i in range(len(names)):
                values = batch[f"v{i}"]
                if i in tables:
                    x = values.to_numpy(dtype=float, na_value=np.nan)
                    out[f"z{i}"] = np.where(np.isnan(x), np.nan, np.interp(x, *tables[i]))
                else:
                    out[f"z{i}"] = values.to_numpy(dtype=float, na_value=np.nan)
            yield pd.DataFrame(out)

    return rows.mapInPandas(look_up, ", ".join(f"z{i} double" for i in range(len(names))))


def _factor(df: DataFrame, fitted: Copula) -> list[list[float]]:
    names = fitted.modelled
    k = len(names)
    matrix = np.eye(k)
    if k > 1:
        for (a, b), r in correlation(normal_scores(df, fitted)).items():
            i, j = int(a[1:]), int(b[1:])
            matrix[i, j] = matrix[j, i] = 0.0 if r is None else r
    # pairwise correlations need not be consistent; lift negative eigenvalues
    values, vectors = np.linalg.eigh(matrix)
    matrix = vectors @ np.diag(np.maximum(values, 1e-9)) @ vectors.T
    scale = np.sqrt(np.diag(matrix))
    return np.linalg.cholesky(matrix / np.outer(scale, scale)).tolist()


def _unit(x: np.ndarray) -> np.ndarray:
    """The share of a normal distribution below each score."""
    below = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x.tolist()])
    return np.clip(below, 0, BELOW_ONE)


def _uniform(seed: int, stream: int) -> Column:
    """A number in (0, 1) fixed by seed, stream and row id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), F.col("id")), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def sample_copula(
    spark: SparkSession, fitted: Copula, rows: int, seed: int = 42, starts: dict[str, int] | None = None
) -> DataFrame:
    """Exactly ``rows`` synthetic rows; whole-number ids count from 0, or from their column's entry in ``starts``.

    Row ``i`` depends on seed and ``i`` alone, so lost tasks come back the same and any
    number of partitions works. Values stay inside the learnt range.
    """
    if rows < 1:
        raise ValueError("rows must be positive")
    names = fitted.modelled
    k = len(names)
    noise = [
        F.sqrt(-2 * F.log(_uniform(seed, 2 * j))) * F.cos(2 * np.pi * _uniform(seed, 2 * j + 1)) for j in range(k)
    ]
    base = spark.range(rows).select(
        "id", *[n.alias(f"e{j}") for j, n in enumerate(noise)],
        *[_uniform(seed, 1_000_000 + i).alias(f"g{i}") for i in range(len(fitted.columns))],
    )
    mixed = base.select(
        "id",
        *[f"g{i}" for i in range(len(fitted.columns))],
        *[
            sum((F.col(f"e{j}") * F.lit(fitted.cholesky[i][j]) for j in range(i + 1)), F.lit(0.0)).alias(f"z{i}")
            for i in range(k)
        ],
    )
    z = _scores()
    grids = {i: np.array(fitted.grids[c]) for i, c in enumerate(names) if c in fitted.grids}
    kept = ["id", *[f"g{i}" for i in range(len(fitted.columns))]]
    def look_up(batches):
        for batch in batches:
            out = batch[kept].copy()
            for i in range(k):
                x = batch[f"z{i}"].to_numpy()
                out[f"v{i}"] = np.interp(x, z, grids[i]) if i in grids else _unit(x)
            yield out

    schema = ", ".join(["id bigint"] + [f"{c} double" for c in kept[1:]] + [f"v{i} double" for i in range(k)])
    values = mixed.mapInPandas(look_up, schema)
    for i, c in enumerate(names):
        if c in fitted.shares:
            values = _chosen(values, f"v{i}", fitted.shares[c])
    out = []
    for i, c in enumerate(fitted.columns):
        made = _typed(fitted, c, names.index(c) if c in names else None, (starts or {}).get(c, 0))
        out.append(F.when(F.col(f"g{i}") >= fitted.gaps[c], made).alias(c))
    return values.select(*out)


def _chosen(rows: DataFrame, column: str, shares: DataFrame) -> DataFrame:
    """Replace a number of the unit interval by the value whose part it lies in.

    Parts and numbers meet by bucket of the interval. There are as many buckets as values, so a bucket holds few parts on
    average, and a frequent value has its rows spread over all the buckets of its part.
    """
    buckets = max(shares.count(), BUCKETS)
    low, high = F.floor(F.col("start") * buckets), F.least(F.floor(F.col("end") * buckets), F.lit(buckets - 1))
    parts = shares.select("start", "end", "value", F.explode(F.sequence(low, high)).alias("_bucket"))
    rows = rows.withColumn("_bucket", F.floor(F.col(column) * buckets))
    inside = (F.col(column) >= F.col("start")) & (F.col(column) < F.col("end"))
    met = rows.join(parts, (rows["_bucket"] == parts["_bucket"]) & inside)
    return met.drop("_bucket", "start", "end").withColumn(column, F.col("value")).drop("value")


def _typed(fitted: Copula, c: str, at: int | None, start: int) -> Column:
    dtype = fitted.types[c]
    if at is None:
        if fitted.roles[c] in ("id", "unknown"):
            return (F.col("id") + start if is_number(dtype) else F.concat(F.lit(f"{c}-"), F.col("id"))).cast(dtype)
        return F.lit(None).cast(dtype)
    value = F.col(f"v{at}")
    if c in fitted.shares:
        return value.cast(dtype)
    if is_temporal(dtype):
        if isinstance(dtype, T.DateType):
            return F.date_add(F.lit("1970-01-01").cast("date"), F.round(value / 86400.0).cast("int"))
        origin = F.lit("1970-01-01").cast(dtype.simpleString())
        return F.timestamp_add("MICROSECOND", F.round(value * 1e6).cast("long"), origin).cast(dtype)
    if isinstance(dtype, FRACTIONAL):
        d = fitted.decimals[c]
        return (value if d is None else F.round(value, d)).cast(dtype)
    if isinstance(dtype, T.DecimalType):
        return F.round(value, dtype.scale).cast(dtype)
    return F.round(value).cast(dtype)


def synthesize(
    df: DataFrame, rows: int, model_type: str = "gaussian_copula", evaluate: bool = True, seed: int = 42
) -> tuple[DataFrame, dict]:
    """Fit, sample and (optionally) grade."""
    if model_type.lower() != "gaussian_copula":
        raise ValueError("model_type must be 'gaussian_copula'")
    made = sample_copula(df.sparkSession, fit_copula(df), rows, seed)
    made = cut_lineage(made)  # read by the report and by whoever stores it
    quality = None
    if evaluate:
        report = quality_report(df, made).collect()
        quality = {
            "overall_score": next(r["score"] for r in report if r["metric"] == "Overall"),
            "properties": {r["property"]: r["score"] for r in report if r["metric"] == "Property"},
            "details": [r.asDict() for r in report if r["metric"] not in ("Overall", "Property")],
        }
    config = {
        "operation": "synthesis_pipeline",
        "train": {"operation": "train_synthesizer", "model": "gaussian_copula", "columns": df.columns},
        "generate": {"operation": "generate_synthetic_data", "num_rows": rows},
        "quality_evaluation": quality,
    }
    return made, config
