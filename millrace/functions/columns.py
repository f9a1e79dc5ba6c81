"""Column classes and the NaN/NULL convention."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRACTIONAL = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """Column by exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_boolean(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def column_kinds(df: DataFrame) -> dict[str, str]:
    """Name -> ``numeric``, ``boolean``, ``datetime`` or ``categorical``."""

    def kind(dtype: T.DataType) -> str:
        if is_boolean(dtype):
            return "boolean"
        if is_number(dtype):
            return "numeric"
        return "datetime" if is_temporal(dtype) else "categorical"

    return {f.name: kind(f.dataType) for f in df.schema.fields}


def column_types(df: DataFrame) -> dict[str, str]:
    """The two-way typing used when operations are offered: booleans count as numeric."""
    return {
        name: "numeric" if kind in ("numeric", "boolean") else "categorical"
        for name, kind in column_kinds(df).items()
    }


def number_columns(df: DataFrame, among: Iterable[str] | None = None) -> list[str]:
    """Integer and fractional columns, booleans excluded, in frame order or that of ``among``."""
    kinds = column_kinds(df)
    return [c for c in (df.columns if among is None else among) if kinds.get(c) == "numeric"]


def existing(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    """Requested columns the frame has; all of them for ``None`` or an empty list."""
    wanted = list(columns or df.columns)
    known = set(df.columns)
    return [c for c in wanted if c in known]


def without_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL: both mean "missing" here, but Spark orders and sums NaN as a value."""
    fields = df.schema.fields
    if not any(isinstance(f.dataType, FRACTIONAL) for f in fields):
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
            if isinstance(f.dataType, FRACTIONAL)
            else col(f.name)
            for f in fields
        ]
    )


def as_double(df: DataFrame, name: str) -> Column:
    """The column as double with NaN as NULL, for statistics."""
    value = col(name).cast("double")
    if isinstance(df.schema[name].dataType, FRACTIONAL):
        return F.when(~F.isnan(value), value)
    return value


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that swaps the given columns in place and keeps the order."""
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])
