"""Cross-validation of least squares without a fit per fold: sums of products by fold, models by subtraction."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, col
from millrace.operators.split import assign_folds

NEAR_ROWS = 1_000
SUMS = pa.schema([("fold", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])


@dataclass(frozen=True)
class FoldFit:
    """A model fitted on all folds but ``fold``, and its errors on that fold."""

    fold: int
    rows: int
    intercept: float
    coefficients: list[float]
    mse: float
    r2: float


def fold_products(folded: DataFrame, target: str, features: list[str], folds: int) -> tuple[np.ndarray, np.ndarray]:
    """``Z'Z`` of ``Z = (1, features, target)`` per fold, and the values that were subtracted from features and target.

    Each task adds up its rows batch by batch and hands on one row per fold and pair of columns; the driver gets
    folds x columns^2 / 2 numbers. Rows without a target are left out. A feature without a value is an error.
    """
    names = [*features, target]
    value = [as_double(folded, c) if folded.schema[c].dataType.typeName() != "boolean" else col(c).cast("double") for c in names]
    flat = folded.select(F.col("fold").cast("int").alias("fold"), *[v.alias(f"x{i}") for i, v in enumerate(value)])
    flat = flat.where(F.col(f"x{len(features)}").isNotNull())
    near = flat.limit(NEAR_ROWS).agg(*[F.avg(f"x{i}") for i in range(len(names))]).first()
    shift = np.array([v or 0.0 for v in near])

    def products(batches):
        total = np.zeros((folds, len(shift) + 1, len(shift) + 1))
        for batch in batches:
            fold, *columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            z = np.column_stack([np.ones(len(fold)), np.column_stack(columns).astype(float) - shift])
            for f in np.unique(fold):
                part = z[fold == f]
                total[f] += part.T @ part
        i, j = np.triu_indices(len(shift) + 1)
        for f in np.flatnonzero(total[:, 0, 0]):
            columns = [pa.array(np.full(len(i), f), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[f, i, j])]
            yield pa.RecordBatch.from_arrays(columns, schema=SUMS)

    sums = flat.mapInArrow(products, "fold int, i int, j int, s double").groupBy("fold", "i", "j").agg(F.sum("s").alias("s"))
    found = np.zeros((folds, len(shift) + 1, len(shift) + 1))
    for r in sums.collect():  # folds x columns^2 / 2
        found[r["fold"], r["i"], r["j"]] = found[r["fold"], r["j"], r["i"]] = r["s"]
    if not np.isfinite(found).all():
        raise ValueError("features hold missing or infinite values; fill or drop them first")
    return found, shift


def least_squares(products: np.ndarray) -> np.ndarray:
    """Intercept and slopes from ``Z'Z``; columns that do not vary, or repeat others, share the smallest slopes."""
    n, means = products[0, 0], products[0, 1:] / products[0, 0]
    spread = products[1:, 1:] - n * np.outer(means, means)
    size = np.sqrt(np.clip(np.diag(spread)[:-1], 0, None))
    size[size <= 1e-7 * np.sqrt(np.diag(products)[1:-1])] = 0.0
    scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
    slopes = scale * np.linalg.lstsq(spread[:-1, :-1] * np.outer(scale, scale), spread[:-1, -1] * scale, rcond=1e-12)[0]
    return np.concatenate([[means[-1] - slopes @ means[:-1]], slopes])


def fits_by_subtraction(products: np.ndarray, shift: np.ndarray) -> list[FoldFit]:
    """The model of every fold is that of all products less the fold's own; its errors follow from the fold's products."""
    whole, out = products.sum(axis=0), []
    for fold, held in enumerate(products):
        rows = int(held[0, 0])
        if not rows or whole[0, 0] == rows:
            raise ValueError(f"fold {fold} or the rest of the rows is empty")
        model = least_squares(whole - held)
        off = np.concatenate([-model, [1.0]])
        mse = max(0.0, off @ held @ off) / rows
        spread = max(0.0, held[-1, -1] / rows - (held[0, -1] / rows) ** 2)
        r2 = 1 - mse / spread if spread > 0 else float(mse == 0)
        intercept = model[0] + shift[-1] - model[1:] @ shift[:-1]
        out.append(FoldFit(fold, rows, float(intercept), [float(v) for v in model[1:]], float(mse), float(r2)))
    return out


def absolute_errors(folded: DataFrame, target: str, features: list[str], fits: list[FoldFit]) -> list[float]:
    """Mean absolute error per held-out fold; absolute values are no sum of products, so this is one more pass."""

    def of_fold(values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("fold") + 1)

    predicted = of_fold([f.intercept for f in fits])
    for i, c in enumerate(features):
        predicted = predicted + of_fold([f.coefficients[i] for f in fits]) * col(c).cast("double")
    rows = folded.groupBy("fold").agg(F.avg(F.abs(as_double(folded, target) - predicted)).alias("mae")).collect()
    found = {r["fold"]: r["mae"] for r in rows}
    return [found[f.fold] for f in fits]


def linear_scores(folded: DataFrame, target: str, features: list[str], folds: int, scoring: str) -> list[float]:
    """A scorer per held-out fold of a linear regression; larger is better."""
    fits = fits_by_subtraction(*fold_products(folded, target, features, folds))
    if scoring == "neg_mean_absolute_error":
        return [-v for v in absolute_errors(folded, target, features, fits)]
    value = {"r2": lambda f: f.r2, "neg_mean_squared_error": lambda f: -f.mse, "neg_root_mean_squared_error": lambda f: -(f.mse**0.5)}
    return [value[scoring](f) for f in fits]


def cross_validate_linear(df: DataFrame, target: str, features: list[str], key: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """``(fold, rows, intercept, coefficients, mse, r2)``: a linear regression per held-out fold, all from one pass."""
    known = df.where(as_double(df, target).isNotNull())
    folded = assign_folds(known, key, folds, seed)
    fits = fits_by_subtraction(*fold_products(folded, target, features, folds))
    return df.sparkSession.createDataFrame(
        [(f.fold, f.rows, f.intercept, f.coefficients, f.mse, f.r2) for f in fits],
        "fold int, rows bigint, intercept double, coefficients array<double>, mse double, r2 double",
    )
