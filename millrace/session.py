"""Session set-up and the one place that cuts lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "millrace", shared: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own.

    ``shared`` is the folder for intermediate tables, unless the session names one already.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if shared and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(shared)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, below ``spark.checkpoint.dir``, which every executor can reach."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/millrace-{sc.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Fix ``df`` as a table in the shared folder, so later jobs neither recompute nor lose it.

    The job runs when this is called, not when the result is used. A table rather than a checkpoint: it is columnar, and
    its size is known when the optimizer picks joins. ``drop_stages`` removes it.
    """
    path = shared_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Remove the application's intermediate tables; frames that were built on them cannot be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
