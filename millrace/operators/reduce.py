"""Principal components as a literal projection."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, col, number_columns
from millrace.operators.base import Fitted, transform_of


def _components(df: DataFrame, columns: list[str], k: int) -> dict:
    """Means, loadings and explained shares; the largest loading of each component is positive."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(as_double(df, c)).alias(f"m{i}"), F.count_if(as_double(df, c).isNull()).alias(f"g{i}")]
    row = df.agg(*aggs).first()
    gaps = [c for i, c in enumerate(columns) if row[f"g{i}"]]
    if gaps:
        raise ValueError(f"columns {gaps} have missing values; fill or drop them first")
    means = [row[f"m{i}"] for i in range(len(columns))]
    if any(m is None for m in means):
        raise ValueError("the frame is empty")
    # centring first keeps the covariance accurate for columns far from zero
    centred = df.select(*[(as_double(df, c) - means[i]).alias(f"x{i}") for i, c in enumerate(columns)])
    vectors = VectorAssembler(inputCols=centred.columns, outputCol="v").transform(centred)
    model = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    loadings = model.pc.toArray().T
    signed = [[float(w) for w in (line if line[abs(line).argmax()] >= 0 else -line)] for line in loadings]
    return {
        "means": means,
        "loadings": signed,
        "explained_variance": [float(v) for v in model.explainedVariance.toArray()],
    }


def _project(df: DataFrame, config: dict, names: list[str]) -> list[Column]:
    out = []
    for name, line in zip(names, config["loadings"]):
        score = F.lit(0.0)
        for c, mean, weight in zip(config["original_columns"], config["means"], line):
            score = score + (as_double(df, c) - F.lit(mean)) * F.lit(weight)
        out.append(score.alias(name))
    return out


def fit_reduction(df: DataFrame, columns: list[str], n_components: int = 2, method: str = "pca") -> Fitted:
    """PCA over the number columns among ``columns``."""
    if method.lower() != "pca":
        raise ValueError("method must be 'pca'")
    known = [c for c in columns if c in df.columns]
    if not known:
        raise ValueError(f"none of the columns {columns} exist")
    numbers = number_columns(df, known)
    if not numbers:
        raise ValueError(f"none of the columns {known} hold numbers")
    if not 1 <= n_components <= len(numbers):
        raise ValueError(f"n_components must be between 1 and {len(numbers)}")
    return Fitted(
        {
            "operation": "reduce_dimensionality",
            "method": "pca",
            "original_columns": numbers,
            "n_components": n_components,
            "new_columns": [f"pca_{i + 1}" for i in range(n_components)],
        }
        | _components(df, numbers, n_components)
    )


@transform_of("reduce_dimensionality")
def _reduce(df: DataFrame, config: dict) -> DataFrame:
    kept = [col(c) for c in df.columns if c not in config["original_columns"]]
    return df.select(*kept, *_project(df, config, config["new_columns"]))


def fit_pca(df: DataFrame, n_components: int) -> Fitted:
    """PCA over the whole (all-number) frame; the transform returns PC1..PCk only."""
    numbers = number_columns(df)
    if numbers != df.columns:
        raise ValueError(f"columns {[c for c in df.columns if c not in numbers]} do not hold numbers")
    if not 1 <= n_components <= len(numbers):
        raise ValueError(f"n_components must be between 1 and {len(numbers)}")
    return Fitted(
        {"operation": "pca", "original_columns": numbers, "n_components": n_components}
        | _components(df, numbers, n_components)
    )


@transform_of("pca")
def _pca(df: DataFrame, config: dict) -> DataFrame:
    return df.select(*_project(df, config, [f"PC{i + 1}" for i in range(config["n_components"])]))


def explained_variance(df: DataFrame, fitted: Fitted) -> DataFrame:
    """``(component, ratio)``."""
    return df.sparkSession.createDataFrame(
        list(enumerate(fitted.config["explained_variance"], 1)), "component bigint, ratio double"
    )
