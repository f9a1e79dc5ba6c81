"""Datasets with branching versions, stored as Parquet."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources import lineage
from millrace.sources.files import export, read_csv

_LOG_SCHEMA = lineage.VERSIONS_SCHEMA + ", data_path string, dropped boolean, logged_at timestamp_ntz"
PREVIEW_ROWS = 1_000


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Catalog:
    """A folder of version data plus an append-only log of what was created and dropped.

    Data is written to a fresh path before its log row, so an interrupted write leaves an
    unlisted folder behind and nothing half visible.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log_path = f"{self.root}/_versions"

    def _log(self, **entry: Any) -> None:
        self.spark.createDataFrame([entry], _LOG_SCHEMA).coalesce(1).write.mode("append").parquet(self.log_path)

    def _claim(self, dataset: str, version: str):
        """The file that reserves a version's name; creating it is atomic, so of two writers one fails."""
        for name in (dataset, version):
            if not name or name.startswith(("_", ".")) or "/" in name:
                raise ValueError(f"{name!r} cannot be the name of a folder")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_names/{dataset}/{version}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _entries(self) -> DataFrame:
        try:
            log = self.spark.read.schema(_LOG_SCHEMA).parquet(self.log_path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LOG_SCHEMA)
        latest = Window.partitionBy("dataset", "version").orderBy(F.col("logged_at").desc())
        current = log.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
        return current.where("NOT dropped")

    def versions(self, dataset: str | None = None) -> DataFrame:
        """The table the functions in :mod:`millrace.sources.lineage` work on."""
        rows = self._entries().drop("data_path", "dropped", "logged_at")
        return rows if dataset is None else rows.where(F.col("dataset") == dataset)

    def create_dataset(self, dataset: str, csv_path: str, schema: str | None = None) -> None:
        """Import a CSV as version ``raw``."""
        self.create_version(dataset, "raw", read_csv(self.spark, csv_path, schema), None, "import", {"source_file": csv_path})

    def create_version(
        self, dataset: str, version: str, df: DataFrame, parent: str | None, operation: str, config: Any = None
    ) -> None:
        """Store a result; the name must be new and the parent known. A failed write frees the name."""
        names = [r["version"] for r in self.versions(dataset).where(F.col("version").isin([v for v in (version, parent) if v])).select("version").collect()]
        if version in names:
            raise ValueError(f"version {version!r} already exists")
        if parent is not None and parent not in names:
            raise ValueError(f"parent version {parent!r} does not exist")
        files, claim = self._claim(dataset, version)
        if not files.createNewFile(claim):
            raise ValueError(f"version {version!r} already exists or is being written")
        path = f"{self.root}/{dataset}/{version}-{uuid.uuid4().hex[:8]}"
        try:
            df.write.mode("errorifexists").parquet(path)
        except Exception:
            files.delete(claim, False)
            raise
        now = _now()
        self._log(
            dataset=dataset, version=version, parent=parent, operation=operation,
            config=json.dumps(config or {}, default=str), created_at=now, data_path=path, dropped=False, logged_at=now,
        )

    def load_version(self, dataset: str, version: str) -> DataFrame:
        row = self._entries().where((F.col("dataset") == dataset) & (F.col("version") == version)).first()
        if row is None:
            raise FileNotFoundError(f"version {version!r} of {dataset!r} does not exist")
        return self.spark.read.parquet(row["data_path"])

    def drop_version(self, dataset: str, version: str) -> None:
        """Drop a version without children; ``raw`` stays."""
        if version == "raw":
            raise ValueError("version 'raw' cannot be dropped")
        row = self._entries().where((F.col("dataset") == dataset) & (F.col("version") == version)).first()
        if row is None:
            raise ValueError(f"version {version!r} does not exist")
        child = self.versions(dataset).where(F.col("parent") == version).first()
        if child is not None:
            raise ValueError(f"version {version!r} has child version {child['version']!r}")
        self._log(**(row.asDict() | {"dropped": True, "logged_at": _now()}))
        files, claim = self._claim(dataset, version)
        files.delete(claim, False)

    def release_name(self, dataset: str, version: str) -> bool:
        """Free a name that a killed writer left reserved; tells whether there was such a reservation.

        The caller knows that nobody is writing that version any more. A stored version keeps its name.
        """
        if not self._entries().where((F.col("dataset") == dataset) & (F.col("version") == version)).isEmpty():
            raise ValueError(f"version {version!r} exists")
        files, claim = self._claim(dataset, version)
        return files.delete(claim, False)

    def export_version(self, dataset: str, version: str, path: str, form: str = "csv") -> None:
        export(self.load_version(dataset, version), path, form)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows as text; missing values are empty."""
    return df.limit(rows).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
