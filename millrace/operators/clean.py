"""Missing values, outliers, column removal and correlation pruning."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, col, existing, number_columns, replaced, without_nan
from millrace.functions.counts import modes, typed_literal
from millrace.functions.moments import moments
from millrace.functions.quantiles import quantiles
from millrace.operators.base import Fitted, transform_of

STRATEGIES = ("mean", "median", "mode", "drop_rows", "drop_columns")
NEAR_ROWS = 1_000
GRAM = ["a", "b", "n", "x", "y", "xx", "yy", "xy"]
FLAT = 1e-12  # variance below this share of the mean square is rounding


def _missing(df: DataFrame, name: str) -> Column:
    value = col(name)
    if df.schema[name].dataType.simpleString() in ("float", "double"):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def fit_missing(
    df: DataFrame, strategy: str = "mean", columns: list[str] | None = None, accuracy: int | None = None
) -> Fitted:
    """Learn fill values (or the columns to drop).

    Numbers take mean, exact median or mode; other columns the mode. Only columns that do
    have gaps are filled, so complete integer columns keep their type. The two dropping
    strategies look at the whole frame.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    config = {"operation": "handle_missing_values", "strategy": strategy, "columns": list(columns or df.columns)}
    if strategy == "drop_rows":
        return Fitted(config)

    watched = df.columns if strategy == "drop_columns" else existing(df, columns)
    numbers = number_columns(df, watched)
    if not watched:
        return Fitted(config | {"fills": {}})
    row = df.agg(*[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(watched)]).first()
    gaps = {c for i, c in enumerate(watched) if row[f"m{i}"]}

    if strategy == "drop_columns":
        return Fitted(config | {"dropped_columns": [c for c in watched if c in gaps]})
    fills: dict[str, object] = {}
    if strategy == "mean":
        means = moments(df, {c: as_double(df, c) for c in numbers if c in gaps})
        fills = {c: m["mean"] for c, m in means.items() if m["mean"] is not None}
    elif strategy == "median":
        items = {c: as_double(df, c) for c in numbers if c in gaps}
        medians = quantiles(df, items, [0.5], accuracy)
        fills = {c: v[0] for c, v in medians.items() if v[0] is not None}
    by_mode = [c for c in watched if c in gaps and (strategy == "mode" or c not in numbers)]
    return Fitted(config | {"fills": fills, "mode_fills": modes(df, by_mode)})


@transform_of("handle_missing_values")
def _fill(df: DataFrame, config: dict) -> DataFrame:
    df = without_nan(df)
    if config["strategy"] == "drop_rows":
        return df.na.drop("any")
    if config["strategy"] == "drop_columns":
        return df.drop(*config["dropped_columns"])
    new = {c: F.coalesce(col(c).cast("double"), F.lit(float(v))) for c, v in config["fills"].items()}
    new |= {c: F.coalesce(col(c), typed_literal(df, c, v)) for c, v in config.get("mode_fills", {}).items()}
    return replaced(df, new)


def handle_missing(df: DataFrame, strategy: str = "mean", columns: list[str] | None = None) -> DataFrame:
    return fit_missing(df, strategy, columns).transform(df)


def fit_outliers(
    df: DataFrame,
    columns: list[str] | None = None,
    method: str = "iqr",
    threshold: float | None = None,
    accuracy: int | None = None,
) -> Fitted:
    """Learn the band every checked column must lie in, from the unfiltered rows.

    ``iqr`` drops rows with a null in a checked column; ``zscore`` treats nulls as the mean
    and keeps nothing when a column does not vary.
    """
    if method not in ("iqr", "zscore"):
        raise ValueError("method must be 'iqr' or 'zscore'")
    if threshold is None:
        threshold = 1.5
    checked = number_columns(df) if columns is None else [c for c in columns if c in df.columns]
    textual = [c for c in checked if c not in number_columns(df)]
    if textual:
        raise ValueError(f"outliers need number columns, got {textual}")
    bands: dict[str, list] = {}
    items = {c: as_double(df, c) for c in checked}
    if checked and method == "iqr":
        for c, (q1, q3) in quantiles(df, items, [0.25, 0.75], accuracy).items():
            bands[c] = [None, None] if q1 is None else [q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1)]
    elif checked:
        for c, m in moments(df, items).items():
            spread = (m["var_pop"] or 0.0) * m["count"] / max(m["rows"], 1)
            bands[c] = [m["mean"], spread**0.5 if spread > 0 else None]
    config = {
        "operation": "drop_outliers",
        "method": method,
        "threshold": float(threshold),
        "columns": checked,
        "bands": bands,
    }
    row = df.agg(F.count("*").alias("rows"), F.count_if(_within(df, config)).alias("kept")).first()
    config["rows_removed"] = row["rows"] - row["kept"]
    return Fitted(config)


def _within(df: DataFrame, config: dict) -> Column:
    tests = []
    for c in config["columns"]:
        low, high = config["bands"][c]
        if high is None:
            return F.lit(False)
        x = as_double(df, c)
        if config["method"] == "iqr":
            tests.append((x >= low) & (x <= high))
        else:
            tests.append(F.abs(F.coalesce(x, F.lit(low)) - low) / high <= config["threshold"])
    return reduce(lambda a, b: a & b, tests, F.lit(True))


@transform_of("drop_outliers")
def _drop_outliers(df: DataFrame, config: dict) -> DataFrame:
    return df.where(_within(df, config))


def fit_drop_columns(df: DataFrame, columns: list[str]) -> Fitted:
    return Fitted({"operation": "drop_columns", "columns": list(columns)})


@transform_of("drop_columns")
def _drop(df: DataFrame, config: dict) -> DataFrame:
    return df.drop(*[c for c in config["columns"] if c in df.columns])


def correlation(df: DataFrame, columns: list[str] | None = None) -> dict[tuple[str, str], float | None]:
    """Pearson r of every pair (earlier, later) over rows where both are present.

    Each task sums the products of its columns batch by batch (``X'X`` and the like, with masks for gaps), so one pass
    serves all pairs and a task hands on one row per pair. Values are taken from a value of their column, which keeps
    large offsets out of the sums. A side that does not vary gives None.
    """
    names = number_columns(df) if columns is None else number_columns(df, columns)
    found: dict[tuple[str, str], float | None] = {(a, b): None for i, a in enumerate(names) for b in names[i + 1 :]}
    if not found:
        return found
    flat = df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(names)])
    near = flat.limit(NEAR_ROWS).agg(*[F.min(f"x{i}").alias(f"x{i}") for i in range(len(names))]).first()
    shift = np.array([v or 0.0 for v in near])

    def gram(batches):
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift
            here = ~np.isnan(x)
            x[~here] = 0.0
            m = here.astype(float)
            # rows with both, sum of a where b is there, sum of its squares, sum of products
            part = np.stack((m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x))
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(shift), 1)
            n, s, q, p = total
            sums = [n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, sums)], GRAM)

    kinds = "a int, b int, " + ", ".join(f"{c} double" for c in GRAM[2:])
    sums = flat.mapInArrow(gram, kinds).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in GRAM[2:]])
    for r in sums.collect():  # one row per pair
        n = r["n"]
        if n:
            x, y = r["x"] / n, r["y"] / n
            vx, vy = r["xx"] / n - x * x, r["yy"] / n - y * y
            if vx > FLAT * r["xx"] / n and vy > FLAT * r["yy"] / n:
                found[(names[r["a"]], names[r["b"]])] = (r["xy"] / n - x * y) / (vx**0.5 * vy**0.5)
    return found


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(a, b, abs_r)`` for all ordered pairs, the diagonal included."""
    names = number_columns(df) if columns is None else number_columns(df, columns)
    half = correlation(df, names)

    def r(a: str, b: str) -> float | None:
        if a == b:
            return 1.0
        value = half[(a, b)] if (a, b) in half else half[(b, a)]
        return None if value is None else abs(value)

    return df.sparkSession.createDataFrame(
        [(a, b, r(a, b)) for a in names for b in names], "a string, b string, abs_r double"
    )


def fit_high_correlation(df: DataFrame, threshold: float = 0.8) -> Fitted:
    """Drop each number column that correlates above ``threshold`` with an earlier one."""
    pairs = correlation(df)
    hit = {b for (_, b), r in pairs.items() if r is not None and abs(r) > threshold}
    return Fitted(
        {
            "operation": "drop_high_corr_features",
            "threshold": threshold,
            "dropped_columns": [c for c in df.columns if c in hit],
        }
    )


@transform_of("drop_high_corr_features")
def _drop_correlated(df: DataFrame, config: dict) -> DataFrame:
    return df.drop(*config["dropped_columns"])
