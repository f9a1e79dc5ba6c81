"""Import and export of tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.functions.columns import without_nan

EXPORTS = ("csv", "parquet", "json")
# the text formats keep milliseconds only unless told otherwise
FULL_TIME = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with a header line. Without ``schema`` the types are inferred, which reads the file twice."""
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError(f"cannot import {path!r}: only .csv files or folders are read")
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    try:
        return without_nan(reader.csv(path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise


def export(df: DataFrame, path: str, form: str = "csv") -> None:
    """Write a version as CSV with header, Parquet or JSON records (one per line)."""
    form = form.lower()
    if form not in EXPORTS:
        raise ValueError(f"format must be one of {', '.join(EXPORTS)}")
    writer = df.write.mode("errorifexists")
    if form == "csv":
        writer.options(header=True, **FULL_TIME).csv(path)
    elif form == "parquet":
        writer.parquet(path)
    else:
        writer.options(ignoreNullFields=False, **FULL_TIME).json(path)
