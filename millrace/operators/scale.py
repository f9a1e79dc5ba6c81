"""Scaling: one fused aggregate, then a projection with literal statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, number_columns, replaced
from millrace.functions.moments import moments
from millrace.functions.quantiles import quantiles
from millrace.operators.base import Fitted, transform_of


def _scaled_columns(df: DataFrame, columns: list[str]) -> list[str]:
    known = [c for c in columns if c in df.columns]
    if not known:
        raise ValueError(f"none of the columns {columns} exist")
    textual = [c for c in known if c not in number_columns(df)]
    if textual:
        raise ValueError(f"cannot scale non-number columns {textual}")
    return known


def _fitted(operation: str, stats: dict[str, tuple]) -> Fitted:
    """``stats``: column -> (centre, width); a width of zero divides by one."""
    return Fitted(
        {
            "operation": operation,
            "columns": list(stats),
            "stats": {c: [centre, width or 1.0] for c, (centre, width) in stats.items() if centre is not None},
        }
    )


def fit_standard(df: DataFrame, columns: list[str]) -> Fitted:
    """Zero mean, unit population deviation."""
    names = _scaled_columns(df, columns)
    found = moments(df, {c: as_double(df, c) for c in names})
    return _fitted("standard_scale", {c: (m["mean"], (m["var_pop"] or 0.0) ** 0.5) for c, m in found.items()})


def fit_minmax(df: DataFrame, columns: list[str]) -> Fitted:
    """Range [0, 1]; a constant column becomes 0."""
    names = _scaled_columns(df, columns)
    found = moments(df, {c: as_double(df, c) for c in names})
    stats = {c: (m["min"], None if m["min"] is None else m["max"] - m["min"]) for c, m in found.items()}
    return _fitted("minmax_scale", stats)


def fit_robust(df: DataFrame, columns: list[str], accuracy: int | None = None) -> Fitted:
    """Median 0, interquartile range 1."""
    names = _scaled_columns(df, columns)
    found = quantiles(df, {c: as_double(df, c) for c in names}, [0.25, 0.5, 0.75], accuracy)
    stats = {c: (q2, None if q1 is None else q3 - q1) for c, (q1, q2, q3) in found.items()}
    return _fitted("robust_scale", stats)


def _scale(df: DataFrame, config: dict) -> DataFrame:
    new = {}
    for c in config["columns"]:
        if c in config["stats"]:
            centre, width = config["stats"][c]
            new[c] = (as_double(df, c) - F.lit(float(centre))) / F.lit(float(width))
        else:
            new[c] = F.lit(None).cast("double")
    return replaced(df, new)


for _name in ("standard_scale", "minmax_scale", "robust_scale"):
    transform_of(_name)(_scale)
