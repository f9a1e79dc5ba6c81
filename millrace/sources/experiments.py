"""The experiment log and the questions asked of it.

Experiments are rows ``experiment_id, experiment_name, timestamp, dataset<name, version>,
model<type, hyperparameters>, metrics, main_metric, random_seed, target_column,
feature_columns, notes``. ``main_metric`` names the first metric, as maps keep no order.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPERIMENT_SCHEMA = (
    "experiment_id string, experiment_name string, timestamp timestamp_ntz,"
    " dataset struct<name: string, version: string>,"
    " model struct<type: string, hyperparameters: map<string, string>>,"
    " preprocessing string, metrics map<string, double>, main_metric string, random_seed int,"
    " target_column string, feature_columns array<string>, notes string"
)

# Name parts that tell which direction of a metric is better.
HIGHER_IS_BETTER = (
    "accuracy", "precision", "recall", "f1", "f1_score", "auc", "roc_auc", "specificity", "sensitivity",
    "balanced_accuracy", "avg_precision", "scores",
)
LOWER_IS_BETTER = (
    "loss", "mse", "rmse", "mae", "mean_absolute_error", "mean_squared_error", "root_mean_squared_error", "error",
    "cross_entropy", "nll", "bce", "categorical_loss",
)


class ExperimentLog:
    """Append-only experiments with optional saved models below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def create(
        self,
        dataset_name: str,
        dataset_version: str,
        model_type: str,
        hyperparameters: dict[str, Any],
        metrics: dict[str, float],
        preprocessing_config: Any = None,
        random_seed: int | None = None,
        model: PipelineModel | None = None,
        notes: str | None = None,
        experiment_name: str | None = None,
        target_column: str | None = None,
        feature_columns: list[str] | None = None,
    ) -> str:
        """Record one experiment and return its id; the model is saved before the row."""
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        experiment_id = f"exp_{now:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:6]}"
        if model is not None:
            model.write().save(self._model_path(experiment_id))
        row = (
            experiment_id, experiment_name, now, (dataset_name, dataset_version),
            (model_type, {k: str(v) for k, v in hyperparameters.items()}), json.dumps(preprocessing_config or {}),
            {k: float(v) for k, v in metrics.items()}, next(iter(metrics), None), random_seed,
            target_column, feature_columns or [], notes,
        )
        self.spark.createDataFrame([row], EXPERIMENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/_experiments")
        return experiment_id

    def _model_path(self, experiment_id: str) -> str:
        return f"{self.root}/models/{experiment_id}"

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(EXPERIMENT_SCHEMA).parquet(f"{self.root}/_experiments")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], EXPERIMENT_SCHEMA)

    def load(self, experiment_id: str) -> dict:
        row = experiment(self.table(), experiment_id).first()
        if row is None:
            raise FileNotFoundError(f"experiment {experiment_id!r} does not exist")
        return row.asDict(recursive=True)

    def load_model(self, experiment_id: str) -> PipelineModel:
        self.load(experiment_id)
        try:
            return PipelineModel.load(self._model_path(experiment_id))
        except Exception as error:
            raise FileNotFoundError(f"experiment {experiment_id!r} has no saved model") from error


def experiment(experiments: DataFrame, experiment_id: str) -> DataFrame:
    return experiments.where(F.col("experiment_id") == experiment_id)


def list_experiments(
    experiments: DataFrame,
    dataset_name: str | None = None,
    model_type: str | None = None,
    min_metric: dict[str, float] | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Filtered listing; a metric an experiment lacks is below every threshold, dates are inclusive."""
    tests: list[Column] = []
    if dataset_name:
        tests.append(F.col("dataset.name") == dataset_name)
    if model_type:
        tests.append(F.col("model.type") == model_type)
    for metric, least in (min_metric or {}).items():
        tests.append(F.coalesce(F.try_element_at("metrics", F.lit(metric)) >= F.lit(float(least)), F.lit(least == float("-inf"))))
    if date_from:
        tests.append(F.col("timestamp") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        tests.append(F.col("timestamp") <= F.lit(date_to).cast("timestamp_ntz"))
    kept = experiments.where(reduce(lambda a, b: a & b, tests)) if tests else experiments
    return kept.select(
        "experiment_id", "experiment_name", "timestamp", "dataset", F.col("model.type").alias("model_type"),
        "metrics", "main_metric", "target_column", "feature_columns",
    )


def filter_values(experiments: DataFrame) -> DataFrame:
    """``(kind, value)``: the distinct dataset names and model types, sorted."""
    return (
        experiments.select(
            F.inline(
                F.array(
                    F.struct(F.lit("dataset").alias("kind"), F.col("dataset.name").alias("value")),
                    F.struct(F.lit("model").alias("kind"), F.col("model.type").alias("value")),
                )
            )
        )
        .where("value <> ''")
        .distinct()
        .orderBy("kind", "value")
    )


def leaderboard(experiments: DataFrame, ascending: bool = False) -> DataFrame:
    """Experiments by the value of their main metric, those without one last."""
    value = F.try_element_at("metrics", F.col("main_metric"))
    order = F.col("main_value").asc_nulls_last() if ascending else F.col("main_value").desc_nulls_last()
    return experiments.select(
        "experiment_id", F.coalesce("experiment_name", F.lit("")).alias("experiment_name"),
        F.col("dataset.name").alias("dataset_name"), F.col("dataset.version").alias("dataset_version"),
        F.col("model.type").alias("model_type"), "target_column", "main_metric", value.alias("main_value"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"),
    ).orderBy(order, "experiment_id")


def better_side(metric: Column, first: Column, second: Column) -> Column:
    """1, 2 or null: which value wins, judged by the metric's name.

    A ``neg_`` prefix makes any metric one where higher is better; unknown names count as
    higher-is-better too.
    """
    name = F.lower(metric)
    higher = reduce(lambda a, b: a | b, [name.contains(k) for k in HIGHER_IS_BETTER])
    lower = reduce(lambda a, b: a | b, [name.contains(k) for k in LOWER_IS_BETTER])
    falls = lower & ~higher & ~name.startswith("neg_")
    up = F.when(first > second, 1).when(first < second, 2)
    down = F.when(first < second, 1).when(first > second, 2)
    return F.when(falls, down).otherwise(up)


_FIELDS = (
    "experiment_id", "experiment_name", "timestamp", "dataset", "dataset_version", "target_column", "feature_columns", "model",
)


def _side(experiments: DataFrame, n: int) -> DataFrame:
    """One row per experiment: ``id{n}``, its plain fields as ``f{n}``, settings ``h{n}`` and metrics ``m{n}``."""
    texts = [
        F.col("experiment_id"),
        F.col("experiment_name"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"),
        F.col("dataset.name"),
        F.col("dataset.version"),
        F.col("target_column"),
        F.array_join("feature_columns", ", "),
        F.col("model.type"),
    ]
    return experiments.select(
        F.col("experiment_id").alias(f"id{n}"),
        F.array(*texts).alias(f"f{n}"),
        F.coalesce("model.hyperparameters", F.create_map().cast("map<string,string>")).alias(f"h{n}"),
        F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias(f"m{n}"),
    )


def compare(experiments: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(first_id, second_id, section, name, value1, value2, differs, better)`` per entry.

    ``pairs`` holds ``first_id, second_id``. Both experiments are joined to their pair
    whole, one row each; lining up the union of their keys ("N/A" where a side lacks one)
    then happens inside the row and shuffles nothing.
    """
    joined = pairs.join(_side(experiments, 1), F.col("first_id") == F.col("id1")).join(
        _side(experiments, 2), F.col("second_id") == F.col("id2")
    )

    def entry(section: str, name: Column, t1: Column, t2: Column, v1: Column, v2: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), name.alias("name"), t1.alias("value1"), t2.alias("value2"),
            v1.cast("double").alias("v1"), v2.cast("double").alias("v2"),
        )

    nothing, no_number = F.lit("N/A"), F.lit(None)

    def keys(a: str, b: str) -> Column:
        return F.array_union(F.map_keys(a), F.map_keys(b))

    def shown(value: Column) -> Column:
        return F.coalesce(F.format_string("%.4f", value), nothing)

    def metric(k: Column) -> Column:
        v1, v2 = F.try_element_at("m1", k), F.try_element_at("m2", k)
        return entry("metric", k, F.when(v1.isNotNull(), shown(v1)).otherwise(nothing), F.when(v2.isNotNull(), shown(v2)).otherwise(nothing), v1, v2)

    blank = F.lit("")
    fields = F.array(
        *[
            entry("field", F.lit(name), F.coalesce(F.col("f1")[i], blank), F.coalesce(F.col("f2")[i], blank), no_number, no_number)
            for i, name in enumerate(_FIELDS)
        ]
    )
    settings = F.transform(
        keys("h1", "h2"),
        lambda k: entry(
            "hyperparameter", k, F.coalesce(F.try_element_at("h1", k), nothing), F.coalesce(F.try_element_at("h2", k), nothing), no_number, no_number
        ),
    )
    rows = joined.select("first_id", "second_id", F.inline(F.concat(fields, settings, F.transform(keys("m1", "m2"), metric))))
    return rows.select(
        "first_id", "second_id", "section", "name", "value1", "value2",
        ((F.col("value1") != F.col("value2")) & (F.col("value1") != "") & (F.col("value2") != "")).alias("differs"),
        F.when(F.col("section") == "metric", better_side(F.col("name"), F.col("v1"), F.col("v2"))).alias("better"),
    )


def compare_two(experiments: DataFrame, first: str, second: str) -> DataFrame:
    """:func:`compare` for one pair."""
    both = experiments.where(F.col("experiment_id").isin(first, second))
    pairs = experiments.sparkSession.createDataFrame([(first, second)], "first_id string, second_id string")
    return compare(both, pairs).drop("first_id", "second_id")
