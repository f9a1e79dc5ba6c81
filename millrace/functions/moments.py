"""Count, mean, deviation and range of many columns in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

WIDE_COLUMNS = 8


def _statistics(x: Column, tag: str = "") -> list[Column]:
    return [
        F.count(x).alias(f"count{tag}"),
        F.avg(x).alias(f"mean{tag}"),
        F.stddev_samp(x).alias(f"std{tag}"),
        F.var_pop(x).alias(f"var_pop{tag}"),
        F.min(x).alias(f"min{tag}"),
        F.max(x).alias(f"max{tag}"),
    ]


def moments(df: DataFrame, items: dict[str, Column]) -> dict[str, Row]:
    """Per item: ``count, mean, std, var_pop, min, max`` and the frame's ``rows``.

    A few items share one row of aggregates. Many would make that aggregate too large to
    compile, so they are laid out as ``(item, value)`` and grouped; both combine on the map
    side and shuffle a few numbers per task.
    """
    if not items:
        return {}
    flat = df.select(*[x.alias(f"x{i}") for i, x in enumerate(items.values())])
    if len(items) <= WIDE_COLUMNS:
        aggs = [F.count("*").alias("rows")]
        for i in range(len(items)):
            aggs += _statistics(F.col(f"x{i}"), str(i))
        row = flat.agg(*aggs).first().asDict()
        names = ("count", "mean", "std", "var_pop", "min", "max")
        return {
            item: Row(rows=row["rows"], **{n: row[f"{n}{i}"] for n in names}) for i, item in enumerate(items)
        }
    entries = [F.struct(F.lit(i).alias("item"), F.col(f"x{i}").alias("x")) for i in range(len(items))]
    rows = (
        flat.select(F.inline(F.array(*entries)))
        .groupBy("item")
        .agg(F.count("*").alias("rows"), *_statistics(F.col("x")))
        .collect()
    )
    found = {r["item"]: r for r in rows}
    empty = Row(rows=0, count=0, mean=None, std=None, var_pop=None, min=None, max=None)
    return {item: found.get(i, empty) for i, item in enumerate(items)}
