"""Evaluation of scored tables."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, col
from millrace.functions.ranking import running_sums
from millrace.operators.celltree import CellTree
from millrace.session import cut_lineage

BLOCK_POINTS = 2_048


def confusion_counts(scored: DataFrame, label: str = "label", prediction: str = "prediction", rows: str | None = None) -> DataFrame:
    """``(label, prediction, n)`` of the pairs that occur; ``rows`` is a column that says how many rows one stands for."""
    n = F.sum(rows) if rows else F.count("*")
    return scored.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(n.alias("n"))


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)`` of every pair of known classes, zeros included.

    The classes are numbered; the grid of all pairs is laid out by ``spark.range`` and named by two joins on the number.
    """
    counts = confusion_counts(scored, label, prediction)
    values = counts.select(F.explode(F.array("label", "prediction")).alias("value")).where("value IS NOT NULL").distinct()
    codes = running_sums(values.withColumn("one", F.lit(1)), "value", ["one"])
    codes = cut_lineage(codes.select("value", (F.col("cum_one") - 1).cast("long").alias("code")))
    k = codes.count()
    if not k:
        return counts
    grid = scored.sparkSession.range(k * k).select(F.floor(F.col("id") / k).alias("row"), (F.col("id") % k).alias("place"))
    rows = codes.select(F.col("code").alias("row"), F.col("value").alias("label"))
    places = codes.select(F.col("code").alias("place"), F.col("value").alias("prediction"))
    return grid.join(rows, "row").join(places, "place").join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def class_report(scored: DataFrame, label: str = "label", prediction: str = "prediction", rows: str | None = None) -> DataFrame:
    """``(class, support, predicted, hits, precision, recall, f1)``; undefined ratios are 0."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = confusion_counts(scored, label, prediction, rows).select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("hits")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
            )
        )
    )
    totals = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    with_ratios = totals.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return with_ratios.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def classification_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction", rows: str | None = None) -> DataFrame:
    """One row: accuracy, support-weighted precision, recall and F1, balanced accuracy."""
    report = class_report(scored, label, prediction, rows)
    weight = F.sum("support")

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / weight

    return report.agg(
        (F.sum("hits") / weight).alias("accuracy"),
        weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
        weighted("f1").alias("f1_score"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


def binary_metrics(scored: DataFrame, positive, label: str = "label", prediction: str = "prediction", rows: str | None = None) -> DataFrame:
    """One row: precision, recall and F1 of the positive class."""
    report = class_report(scored, label, prediction, rows)
    return report.where(F.col("class") == F.lit(positive)).select("precision", "recall", F.col("f1").alias("f1"))


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: mse, rmse, mae and r2 (1 for a perfect fit of a constant, else 0)."""
    y, e = as_double(scored, label), as_double(scored, label) - as_double(scored, prediction)
    sums = scored.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(F.when(e.isNotNull(), y)).alias("spread"))
    r2 = F.when(F.col("spread") > 0, 1 - F.col("mse") / F.when(F.col("spread") > 0, F.col("spread"))).when(
        F.col("mse") == 0, 1.0
    )
    return sums.select("mse", F.sqrt("mse").alias("rmse"), "mae", F.coalesce(r2, F.lit(0.0)).alias("r2"))


def _score_steps(scored: DataFrame, label: str, scores: dict, rows: str | None = None) -> DataFrame:
    """Per class and distinct score: rows of the class, other rows, and running totals from the top.

    Equal scores are merged before anything is ordered, so a score shared by a third of
    the table is one row here.
    """
    n = F.col(rows).cast("long") if rows else F.lit(1).cast("long")
    entries = [
        F.struct(
            F.lit(str(c)).alias("class"),
            as_double(scored, s).alias("score"),
            F.when(col(label) == F.lit(c), n).otherwise(0).alias("hit"),
            n.alias("n"),
        )
        for c, s in scores.items()
    ]
    steps = (
        scored.where(col(label).isNotNull())
        .select(F.inline(F.array(*entries)))
        .groupBy("class", "score")
        .agg(F.sum("hit").alias("pos"), F.sum(F.col("n") - F.col("hit")).alias("neg"))
    )
    return running_sums(steps, "score", ["pos", "neg"], group="class", descending=True)


def roc_auc_by_class(scored: DataFrame, scores: dict, label: str = "label", rows: str | None = None) -> DataFrame:
    """``(class, auc)``: exact area, ties by the trapezoid rule; null when a side is empty."""
    area = F.col("neg").cast("double") * (2.0 * F.col("cum_pos") - F.col("pos"))
    return (
        _score_steps(scored, label, scores, rows)
        .groupBy("class")
        .agg(F.sum(area).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
        .select("class", F.try_divide("area", 2.0 * F.col("p") * F.col("n")).alias("auc"))
    )


def roc_auc(scored: DataFrame, scores: dict, label: str = "label", rows: str | None = None) -> DataFrame:
    """One row ``roc_auc``: of the positive class, or the plain mean over classes one-vs-rest.

    ``scores`` maps a class to its score column; give just the positive class for a binary
    problem.
    """
    return roc_auc_by_class(scored, scores, label, rows).agg(F.avg("auc").alias("roc_auc"))


def roc_curve(scored: DataFrame, scores: dict, label: str = "label") -> DataFrame:
    """``(class, threshold, fpr, tpr)``: one point per distinct score, and the origin (threshold null)."""
    steps = _score_steps(scored, label, scores)
    totals = steps.groupBy("class").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    points = steps.join(F.broadcast(totals), "class").select(
        "class",
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg"), "n").alias("fpr"),
        F.try_divide(F.col("cum_pos"), "p").alias("tpr"),
    )
    origin = totals.select("class", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def silhouette(df: DataFrame, features: list[str], cluster: str = "cluster", *, metric: str, tolerance: float = 0.0, block: int | None = None) -> DataFrame:
    """One row ``metric, silhouette_score``; ``metric`` is ``euclidean`` or ``squared_euclidean``.

    The squared Euclidean form has a closed expression per row and costs one pass. The
    plain Euclidean form has none: with ``tolerance`` 0 every pair of distinct points is measured, which is quadratic. With a
    larger one, groups of points that are far enough away count as a whole, and the score is off by ``tolerance`` at most.
    ``block`` is the number of points that are measured together.
    """
    features = [f for f in features if f != cluster]
    if metric == "euclidean":
        return CellTree(df, features, cluster, block or BLOCK_POINTS).score(tolerance).select(F.lit(metric).alias("metric"), "silhouette_score")
    if metric != "squared_euclidean":
        raise ValueError("metric must be 'squared_euclidean' or 'euclidean'")
    rows = df.select(*[as_double(df, f).alias(f"x{i}") for i, f in enumerate(features)], col(cluster).cast("int").alias("prediction"))
    vectors = VectorAssembler(inputCols=rows.columns[:-1], outputCol="features").transform(rows)
    score = ClusteringEvaluator().evaluate(vectors)
    return df.sparkSession.createDataFrame([(metric, float(score))], "metric string, silhouette_score double")
