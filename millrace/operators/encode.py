"""One-hot and integer class encoding."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col, replaced, without_nan
from millrace.functions.counts import categories
from millrace.functions.ranking import running_sums
from millrace.operators.base import Fitted, transform_of
from millrace.session import shared_path

def fit_one_hot(df: DataFrame, columns: list[str], drop_first: bool = False, max_categories: int | None = None) -> Fitted:
    """Learn the sorted categories of each column; every category becomes a column.

    The categories are the new schema, so they are gathered. ``max_categories`` makes a column with more of them an error;
    ``fit_sparse_one_hot`` takes any number.
    """
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns {absent} do not exist")
    df = without_nan(df)
    found = {}
    for c in columns:
        values = categories(df, c, max_categories)
        if max_categories is not None and len(values) > max_categories:
            raise ValueError(f"column {c!r} has more than {max_categories} categories; encode_classes fits it better")
        found[c] = [[f"{c}_{v}", v] for v in values][1 if drop_first else 0 :]
    return Fitted(
        {"operation": "one_hot_encode", "columns": list(columns), "drop_first": drop_first, "indicators": found}
    )


@transform_of("one_hot_encode")
def _one_hot(df: DataFrame, config: dict) -> DataFrame:
    df = without_nan(df)
    kept = [col(c) for c in df.columns if c not in config["columns"]]
    flags = [
        F.coalesce((col(c) == F.lit(value)).cast("int"), F.lit(0)).alias(name)
        for c in config["columns"]
        for name, value in config["indicators"][c]
    ]
    return df.select(*kept, *flags)


def class_codes(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: the sorted non-null values with 0..k-1, for any number of values.

    Codes are running counts over the range-partitioned distinct values.
    """
    if column not in df.columns:
        raise ValueError(f"column {column!r} does not exist")
    values = without_nan(df).where(col(column).isNotNull()).select(col(column).alias("value")).distinct()
    values = values.withColumn("one", F.lit(1))
    return running_sums(values, "value", ["one"]).select("value", (F.col("cum_one") - 1).cast("long").alias("code"))


def fit_classes(df: DataFrame, column: str, folder: str | None = None) -> Fitted:
    """Map sorted values to 0..k-1.

    The mapping is a table, written at once to ``folder``, or to the application's intermediate tables if there is
    none; the config holds its path.
    """
    path = f"{folder.rstrip('/')}/codes-{uuid.uuid4().hex}" if folder else shared_path(df.sparkSession, "codes")
    class_codes(df, column).write.parquet(path)
    return Fitted({"operation": "encode_classes", "column": column, "mapping_table": path})


@transform_of("encode_classes")
def _encode(df: DataFrame, config: dict) -> DataFrame:
    return _coded(df, config["column"], df.sparkSession.read.parquet(config["mapping_table"]))


def _coded(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Look codes up by a join; rows with a null have none and stay out of it.

    A frequent value is a skewed join key, which the optimizer splits; a small mapping it broadcasts.
    """
    df = without_nan(df)
    names = df.columns
    known = df.where(col(column).isNotNull()).join(codes.select(F.col("value").alias("_value"), F.col("code").alias("_code")), col(column) == F.col("_value"), "left")
    known = known.select(*[F.col("_code").alias(c) if c == column else col(c) for c in names])
    return known.unionByName(replaced(df.where(col(column).isNull()), {column: F.lit(None).cast("long")}))


def fit_sparse_one_hot(df: DataFrame, columns: list[str], drop_first: bool = False, folder: str | None = None, name: str = "indicators") -> Fitted:
    """One-hot encoding of any number of categories, as one sparse vector column ``name``.

    The categories of a column are a table of codes, written as in ``fit_classes``; only their number reaches the driver.
    In the vector, the columns follow each other in the given order, each with its sorted categories. A null, or a value
    that was not there when this was fitted, sets nothing.
    """
    if name in df.columns and name not in columns:
        raise ValueError(f"column {name!r} exists already")
    tables = []
    for c in columns:
        path = fit_classes(df, c, folder).config["mapping_table"]
        tables.append([path, max(0, df.sparkSession.read.parquet(path).count() - int(drop_first))])
    if not sum(size for _, size in tables):
        raise ValueError(f"columns {columns} have no categories to encode")
    return Fitted({"operation": "sparse_one_hot_encode", "columns": list(columns), "drop_first": drop_first, "tables": tables, "name": name})


@transform_of("sparse_one_hot_encode")
def _sparse_one_hot(df: DataFrame, config: dict) -> DataFrame:
    kept = [c for c in df.columns if c not in config["columns"]]
    used = {c: table for c, table in zip(config["columns"], config["tables"]) if table[1]}
    spark = df.sparkSession
    for c, (path, _) in used.items():
        df = _coded(df, c, spark.read.parquet(path))
    at, ones = [f"_at{i}" for i in range(len(used))], [f"_one{i}" for i in range(len(used))]
    first = int(config["drop_first"])
    places = [
        F.when(col(c) >= first, col(c) - first).otherwise(size).cast("double").alias(a) for a, (c, (_, size)) in zip(at, used.items())
    ]
    # the encoder learns sizes from the largest index; an index past it is the invalid category, which is the last and dropped
    largest = spark.createDataFrame([tuple(size - 1.0 for _, size in used.values())], ", ".join(f"{a} double" for a in at))
    encoder = OneHotEncoder(inputCols=at, outputCols=ones, handleInvalid="keep", dropLast=True).fit(largest)
    rows = encoder.transform(df.select(*[col(c) for c in kept], *places))
    if len(ones) > 1:
        rows = VectorAssembler(inputCols=ones, outputCol="_all").transform(rows)
    return rows.select(*[col(c) for c in kept], F.col("_all" if len(ones) > 1 else ones[0]).alias(config["name"]))


def encode_many_classes(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The encoded frame and the ``(value, code)`` table."""
    codes = class_codes(df, column)
    return _coded(df, column, codes), codes


def encode_classes(df: DataFrame, column: str) -> DataFrame:
    return encode_many_classes(df, column)[0]
