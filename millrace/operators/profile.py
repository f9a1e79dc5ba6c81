"""Typed column summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, col, column_kinds
from millrace.functions.counts import distinct_counts, top_values, value_counts
from millrace.functions.moments import moments
from millrace.functions.quantiles import quantiles
from millrace.session import cut_lineage

TOP = 10

NUMERIC_SCHEMA = (
    "column string, dtype string, count bigint, missing bigint, missing_pct double, mean double, std double,"
    " min double, q25 double, q50 double, q75 double, max double, unique bigint"
)


def _of_kind(df: DataFrame, kind: str, columns: list[str] | None) -> list[str]:
    return [c for c, k in column_kinds(df).items() if k == kind and (columns is None or c in columns)]


def _sizes(df: DataFrame, columns: list[str], extra: dict | None = None):
    """Row total, present values and ``extra`` aggregates of all columns in one pass."""
    kinds = column_kinds(df)
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count(as_double(df, c) if kinds[c] == "numeric" else col(c)).alias(f"n{i}"))
        aggs += [fn(c).alias(f"{tag}{i}") for tag, fn in (extra or {}).items()]
    return df.agg(*aggs).first()


def _gap(rows: int, n: int) -> tuple[int, float | None]:
    return rows - n, (rows - n) / rows if rows else None


def numeric_summary(
    df: DataFrame, columns: list[str] | None = None, accuracy: int | None = None, approx_distinct: bool = False
) -> DataFrame:
    """One row per number column: gaps, moments, quartiles and distinct values."""
    names = _of_kind(df, "numeric", columns)
    items = {c: as_double(df, c) for c in names}
    found = moments(df, items)
    if approx_distinct:
        row = df.agg(*[F.approx_count_distinct(x).alias(f"u{i}") for i, x in enumerate(items.values())]).first()
        unique = {c: row[f"u{i}"] for i, c in enumerate(names)}
    else:
        unique = distinct_counts(df, names)
    quarters = quantiles(df, items, [0.25, 0.5, 0.75], accuracy)
    dtypes = dict(df.dtypes)
    out = []
    for c in names:
        m = found[c]
        out.append(
            (c, dtypes[c], m["count"], *_gap(m["rows"], m["count"]), m["mean"], m["std"], m["min"])
            + (*quarters[c], m["max"], unique[c])
        )
    return df.sparkSession.createDataFrame(out, NUMERIC_SCHEMA)


def categorical_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per categorical column; ``top_values`` lists the ten most frequent."""
    names = _of_kind(df, "categorical", columns)
    row = _sizes(df, names)
    counts = cut_lineage(value_counts(df, names)) if names else None  # one shuffle of the rows for both questions
    unique = distinct_counts(df, names, counts)
    top: dict[str, list] = {c: [] for c in names}
    for r in top_values(df, names, TOP, counts).orderBy("column", "rank").collect() if names else []:
        top[r["column"]].append((r["value"], r["n"]))
    dtypes = dict(df.dtypes)
    return df.sparkSession.createDataFrame(
        [
            (c, dtypes[c], row[f"n{i}"], *_gap(row["rows"], row[f"n{i}"]), unique[c], top[c])
            for i, c in enumerate(names)
        ],
        "column string, dtype string, count bigint, missing bigint, missing_pct double, unique bigint,"
        " top_values array<struct<value string, n bigint>>",
    )


def boolean_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per boolean column with its distribution."""
    names = _of_kind(df, "boolean", columns)
    row = _sizes(
        df, names, {"t": lambda c: F.count_if(col(c)), "f": lambda c: F.count_if(~col(c))}
    )
    out = []
    for i, c in enumerate(names):
        spread = {k: v for k, v in (("true", row[f"t{i}"]), ("false", row[f"f{i}"])) if v}
        out.append((c, "boolean", row[f"n{i}"], *_gap(row["rows"], row[f"n{i}"]), len(spread), spread))
    return df.sparkSession.createDataFrame(
        out,
        "column string, dtype string, count bigint, missing bigint, missing_pct double, unique bigint,"
        " distribution map<string,bigint>",
    )


def datetime_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per date or timestamp column; bounds as ISO text."""
    names = _of_kind(df, "datetime", columns)
    kinds = dict(df.dtypes)

    def iso(c: str, value):
        if kinds[c] == "date":
            return F.date_format(value, "yyyy-MM-dd")
        return F.regexp_replace(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.0+$", "")

    row = _sizes(df, names, {"l": lambda c: iso(c, F.min(col(c))), "h": lambda c: iso(c, F.max(col(c)))})
    unique = distinct_counts(df, names) if names else {}
    return df.sparkSession.createDataFrame(
        [
            (c, kinds[c], row[f"n{i}"], *_gap(row["rows"], row[f"n{i}"]), row[f"l{i}"], row[f"h{i}"], unique[c])
            for i, c in enumerate(names)
        ],
        "column string, dtype string, count bigint, missing bigint, missing_pct double, min string, max string,"
        " unique bigint",
    )


def shape(df: DataFrame) -> DataFrame:
    """``(num_rows, num_columns)``."""
    return df.agg(F.count("*").alias("num_rows")).withColumn("num_columns", F.lit(len(df.columns)).cast("long"))


def table_summary(df: DataFrame) -> DataFrame:
    """All column summaries as one long ``(column, kind, stat, value)`` table of text values.

    Table totals appear under an empty column name.
    """
    kinds = column_kinds(df)
    spark = df.sparkSession
    parts = {
        "numeric": numeric_summary,
        "categorical": categorical_summary,
        "boolean": boolean_summary,
        "datetime": datetime_summary,
    }
    total = shape(df).first()
    out = [("", "table", stat, str(total[stat])) for stat in ("num_rows", "num_columns")]
    for kind, summary in parts.items():
        if kind not in kinds.values():
            continue
        for r in summary(df).collect():
            stats = r.asDict()
            for value, n in stats.pop("top_values", []):
                out.append((r["column"], kind, f"top:{value}", str(n)))
            for value, n in stats.pop("distribution", {}).items():
                out.append((r["column"], kind, f"is:{value}", str(n)))
            out += [(r["column"], kind, s, str(v)) for s, v in stats.items() if s != "column" and v is not None]
    return spark.createDataFrame(out, "column string, kind string, stat string, value string")


def fill_rate(df: DataFrame) -> DataFrame:
    """``(column, count, missing, fill_pct)`` for every column; the percentage is cut to whole numbers."""
    row = _sizes(df, df.columns)
    out = []
    for i, c in enumerate(df.columns):
        n, total = row[f"n{i}"], row["rows"]
        out.append((c, n, total - n, int(n / total * 100) if total else None))
    return df.sparkSession.createDataFrame(out, "column string, count bigint, missing bigint, fill_pct bigint")


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """``(value, n)`` of one column's non-null values."""
    return value_counts(df, [column]).select("value", "n")
