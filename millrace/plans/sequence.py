"""Ordered operation steps, as users build them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from millrace.operators import balance, clean, encode, reduce, scale
from millrace.operators.base import Fitted, replay
from millrace.session import cut_lineage

Fit = Callable[[DataFrame, dict], Fitted]

_FITS: dict[str, Fit] = {
    "handle_missing_values": lambda df, c: clean.fit_missing(df, c.get("strategy", "mean"), c.get("columns")),
    "drop_columns": lambda df, c: clean.fit_drop_columns(df, c["columns"]),
    "drop_outliers": lambda df, c: clean.fit_outliers(
        df, c.get("columns"), c.get("method", "iqr"), c.get("threshold")
    ),
    "drop_high_corr_features": lambda df, c: clean.fit_high_correlation(df, c.get("threshold", 0.8)),
    "standard_scale": lambda df, c: scale.fit_standard(df, c["columns"]),
    "minmax_scale": lambda df, c: scale.fit_minmax(df, c["columns"]),
    "robust_scale": lambda df, c: scale.fit_robust(df, c["columns"]),
    "one_hot_encode": lambda df, c: encode.fit_one_hot(df, c["columns"], c.get("drop_first", False), c.get("max_categories")),
    "encode_classes": lambda df, c: encode.fit_classes(df, c["column"], c.get("folder")),
    "reduce_dimensionality": lambda df, c: reduce.fit_reduction(
        df, c["columns"], c.get("n_components", 2), c.get("method", "pca")
    ),
}

OPERATIONS = (*_FITS, "oversample_classes")


def run_sequence(df: DataFrame, steps: list[dict], key: list[str] | None = None) -> tuple[DataFrame, list[dict]]:
    """Apply ``{"operation", "config"}`` steps in order; returns the frame and the fitted configs.

    Transforms stay lazy, so a run of fits re-reads only the columns it needs. Oversampling
    joins and copies rows; if more steps follow, its result is fixed in shared storage first
    so that their fits do not repeat it.
    """
    unknown = [s["operation"] for s in steps if s["operation"] not in OPERATIONS]
    if unknown:
        raise ValueError(f"unknown operations {unknown}")
    configs = []
    for at, step in enumerate(steps):
        name, options = step["operation"], step.get("config") or {}
        if name == "oversample_classes":
            rows_key = options.get("key") or key
            if not rows_key:
                raise ValueError("oversample_classes draws rows and needs their key columns")
            df, config = balance.oversample(
                df,
                options["class_column"],
                options["target_proportions"],
                rows_key,
                options.get("method", "sample"),
                options.get("seed", 42),
            )
            if at + 1 < len(steps):
                df = cut_lineage(df)
        else:
            fitted = _FITS[name](df, options)
            df, config = fitted.transform(df), fitted.config
        configs.append(config)
    return df, configs


def replay_sequence(df: DataFrame, configs: list[dict]) -> DataFrame:
    """Run stored configs on other data without fitting again."""
    for config in configs:
        df = replay(config, df)
    return df


def preview_sequence(df: DataFrame, steps: list[dict], key: list[str] | None = None) -> dict:
    """Row count, column count and the first five column names; nothing is stored."""
    out, _ = run_sequence(df, steps, key)
    return {"rows": out.count(), "columns": len(out.columns), "first_columns": out.columns[:5]}
