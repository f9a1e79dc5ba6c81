"""Supervised models and clustering on Spark ML."""

from __future__ import annotations

import inspect
import math
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IndexToString, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, col, column_kinds, without_nan
from millrace.operators import metrics
from millrace.operators.crossval import linear_scores
from millrace.operators.mixture import fit_mixture
from millrace.operators.split import assign_folds, train_test_split, validate_target
from millrace.operators.trees import Settings, TreesEstimator
from millrace.session import cut_lineage


def _logistic(n: int, classes: int, seed: int, C=1.0, max_iter=100, solver="lbfgs", penalty="l2", l1_ratio=0.5):
    """``solver`` is accepted and ignored: Spark chooses its own. The strength is spread over the rows."""
    mixes = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio, "none": 0.0, None: 0.0}
    if penalty not in mixes:
        raise ValueError("penalty must be l2, l1, elasticnet or none")
    strength = 0.0 if penalty in ("none", None) else 1.0 / (C * n)
    return LogisticRegression(maxIter=max_iter, regParam=strength, elasticNetParam=mixes[penalty], standardization=False)


def _forest(n: int, classes: int, seed: int, n_estimators=100, max_depth=10, min_samples_split=2, min_samples_leaf=1, max_bins=64):
    """``max_depth`` None grows until nothing gains. Classes are cut by a share of the features per node, numbers by all."""
    return TreesEstimator(
        Settings(
            classes=classes, trees=n_estimators, max_depth=max_depth, min_samples_split=min_samples_split, min_samples_leaf=min_samples_leaf,
            all_features=not classes, max_bins=max_bins, seed=seed,
        )
    )


def _boosted(n: int, classes: int, seed: int, n_estimators=100, max_depth=6, learning_rate=0.1, subsample=1.0, colsample_bytree=1.0, reg_lambda=0.0, max_bins=64):
    return TreesEstimator(
        Settings(
            loss="logistic" if classes else "squared", classes=classes, trees=n_estimators, max_depth=max_depth, learning_rate=learning_rate,
            subsample=subsample, share_per_tree=colsample_bytree, reg_lambda=reg_lambda, max_bins=max_bins, seed=seed,
        )
    )


def _linear_svm(n: int, classes: int, seed: int, C=1.0, kernel="linear", gamma=None, max_iter=100):
    if kernel != "linear":
        raise ValueError("only the linear kernel is available")
    svm = LinearSVC(regParam=1.0 / (C * n), maxIter=max_iter, standardization=False)
    return svm if classes <= 2 else OneVsRest(classifier=svm)


def _least_squares(n, classes, seed):
    return LinearRegression(regParam=0.0, solver="normal")


_BUILDERS = {
    ("classification", "logistic_regression"): _logistic,
    ("classification", "random_forest"): _forest,
    ("classification", "svm"): _linear_svm,
    ("classification", "xgboost"): _boosted,
    ("regression", "linear_regression"): _least_squares,
    ("regression", "random_forest"): _forest,
    ("regression", "xgboost"): _boosted,
}


ROWS = "_rows"
WEIGHTED = (LogisticRegression, LinearSVC, OneVsRest)


@dataclass
class Trained:
    """A fitted pipeline, its held-out rows and what it was trained with."""

    model: PipelineModel
    test: DataFrame
    config: dict

    @property
    def classes(self) -> list | None:
        return self.config.get("classes")


def _estimator(task: str, model: str, n: int, classes: int, seed: int, params: dict, key: list[str]):
    builder = _BUILDERS.get((task.lower(), model.lower()))
    if builder is None:
        raise ValueError(f"no model {model!r} for task {task!r}")
    allowed = list(inspect.signature(builder).parameters)[3:]
    unknown = [p for p in params if p not in allowed]
    if unknown:
        raise ValueError(f"{model} does not take {unknown}")
    estimator = builder(n, classes, seed, **params)
    if isinstance(estimator, TreesEstimator):
        estimator.settings.keys = list(key)
    return estimator


def _counted(folded: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Equal rows of a fold as one with their number in ``ROWS``, as a table.

    For models whose objective is a weighted sum over rows this is the same problem. Draws by key (trees) need every row.
    """
    together = [col(c) for c in dict.fromkeys(["fold", *features, target])]
    return cut_lineage(folded.groupBy(*together).agg(F.count("*").alias(ROWS)))


def class_labels(df: DataFrame, target: str) -> list[str]:
    """The classes of a target in value order, as the text Spark's cast gives them.

    A model has parameters for every class, so they are gathered.
    """
    values = df.where(col(target).isNotNull()).select(col(target).alias("value")).distinct()
    return [r["label"] for r in values.orderBy("value").select(F.col("value").cast("string").alias("label")).collect()]


def _prepare(df, target, task, model, key, test_size, seed, features):
    df = without_nan(df)
    if features is None:
        features = [c for c in df.columns if c != target and c not in key]
    kinds = column_kinds(df)
    bad = [f for f in features if kinds.get(f) not in ("numeric", "boolean")]
    if bad:
        raise ValueError(f"features {bad} are not numeric; encode or drop them first")
    rows = validate_target(df, target, test_size)
    classify = task.lower() == "classification"
    classes = class_labels(df, target) if classify else None
    narrow = df.select(*[col(c) for c in dict.fromkeys([*key, *features, target])])
    split = train_test_split(narrow, key, test_size, seed, target if classify else None)
    train = split.where("split = 'train'").drop("split")
    test = split.where("split = 'test'").drop("split")
    return features, classes, train, test, rows - math.ceil(rows * test_size)


def _stages(target: str, features: list[str], classes: list | None):
    before, after = [], []
    if classes is not None:
        before.append(StringIndexerModel.from_labels(classes, inputCol=target, outputCol="label"))
        after.append(IndexToString(inputCol="prediction", outputCol="predicted_class", labels=classes))
    before.append(VectorAssembler(inputCols=features, outputCol="features"))
    return before, after


def _labelled(df: DataFrame, target: str, classes: list | None) -> DataFrame:
    """Rows with a target; class targets as text, number targets as ``label``."""
    df = df.where(col(target).isNotNull())
    if classes is None:
        return df.withColumn("label", as_double(df, target))
    return df.withColumn(target, col(target).cast("string"))


def train(
    df: DataFrame,
    target: str,
    task: str,
    model: str,
    key: list[str],
    features: list[str] | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    **params,
) -> Trained:
    """Split, fit on the training rows and hand back the test rows."""
    features, classes, train_rows, test_rows, n = _prepare(df, target, task, model, key, test_size, seed, features)
    estimator = _estimator(task, model, n, len(classes or []), seed, params, key)
    before, after = _stages(target, features, classes)
    fitted = Pipeline(stages=[*before, estimator, *after]).fit(_labelled(train_rows, target, classes))
    config = {
        "operation": "train_model",
        "task_type": task.lower(),
        "model_type": model.lower(),
        "target_column": target,
        "feature_columns": features,
        "classes": classes,
        "random_seed": seed,
        "model_params": params,
    }
    return Trained(fitted, test_rows, config)


def score(model: PipelineModel, df: DataFrame, target: str | None = None, classes: list | None = None) -> DataFrame:
    """Batch scoring: adds ``prediction``, and for classes ``predicted_class`` and ``scores``.

    ``scores`` holds probabilities where the model gives them, raw margins otherwise. Rows
    without a target are kept when no target is named.
    """
    stages = [s for s in model.stages if not (isinstance(s, StringIndexerModel) and target is None)]
    ready = _labelled(df, target, classes) if target else df
    out = PipelineModel(stages=stages).transform(ready)
    source = next((c for c in ("probability", "rawPrediction") if c in out.columns), None)
    if source:
        out = out.withColumn("scores", vector_to_array(source))
    return out.drop("features", "probability", "rawPrediction")


def evaluate(trained: Trained) -> dict[str, float]:
    """Metrics on the held-out rows, flat."""
    target, classes = trained.config["target_column"], trained.classes
    scored = score(trained.model, trained.test, target, classes)
    if classes is None:
        return {k: float(v) for k, v in metrics.regression_metrics(scored).first().asDict().items()}
    row = metrics.classification_metrics(scored).first().asDict()
    out = {k: float(row[k]) for k in ("accuracy", "precision", "recall", "f1_score")}
    auc = metrics.roc_auc(*_class_scores(scored, len(classes))).first()["roc_auc"]
    if auc is not None:
        out["roc_auc"] = float(auc)
    return out


def _class_scores(scored: DataFrame, k: int, rows: str | None = None) -> tuple[DataFrame, dict]:
    """One score column per class, or for the positive class only when there are two."""
    used = [1] if k == 2 else list(range(k))
    wide = scored.select("label", "prediction", *([rows] if rows else []), *[F.col("scores")[i].alias(f"score_{i}") for i in used])
    return wide, {float(i): f"score_{i}" for i in used}


def parameter_grid(model: str, **now) -> dict[str, list]:
    """Values to try around the current ones."""
    name = model.lower()
    if name == "logistic_regression":
        c, steps = now.get("C", 1.0), now.get("max_iter", 100)
        grid = {"C": [c / 10, c, c * 10], "max_iter": [steps, steps + 100]}
        return grid | {k: [now[k]] for k in ("solver", "penalty") if k in now}
    if name == "random_forest":
        trees, depth = now.get("n_estimators", 100), now.get("max_depth", 10)
        grid = {"n_estimators": [max(10, trees - 50), trees, trees + 50], "max_depth": [max(1, depth - 2), depth, depth + 2]}
        return grid | {k: [now[k]] for k in ("min_samples_split", "min_samples_leaf") if k in now}
    if name == "svm":
        c = now.get("C", 1.0)
        return {"C": [c / 10, c, c * 10]} | {k: [now[k]] for k in ("kernel",) if k in now}
    if name == "xgboost":
        trees, depth, rate = now.get("n_estimators", 100), now.get("max_depth", 6), now.get("learning_rate", 0.1)
        return {
            "n_estimators": [max(10, trees - 50), trees, trees + 50],
            "max_depth": [max(1, depth - 1), depth, depth + 1],
            "learning_rate": [rate / 2, rate],
        }
    return {}


SCORERS = {
    "classification": ("accuracy", "precision", "recall", "f1", "roc_auc", "balanced_accuracy"),
    "regression": ("r2", "neg_mean_squared_error", "neg_mean_absolute_error", "neg_root_mean_squared_error"),
}


def scorer_value(scored: DataFrame, scoring: str, classes: int, rows: str | None = None) -> float:
    """A scorer on a scored table; larger is better for all of them. Of classes, a row may stand for as many as the column ``rows`` says."""
    if scoring in SCORERS["regression"]:
        row = metrics.regression_metrics(scored).first()
        name = {"neg_mean_squared_error": "mse", "neg_mean_absolute_error": "mae", "neg_root_mean_squared_error": "rmse"}
        return float(row["r2"]) if scoring == "r2" else -float(row[name[scoring]])
    if scoring in ("accuracy", "balanced_accuracy"):
        return float(metrics.classification_metrics(scored, rows=rows).first()[scoring])
    if scoring == "roc_auc":
        if "scores" not in scored.columns:
            source = "probability" if "probability" in scored.columns else "rawPrediction"
            scored = scored.withColumn("scores", vector_to_array(source))
        return float(metrics.roc_auc(*_class_scores(scored, classes, rows), rows=rows).first()["roc_auc"])
    if scoring in ("precision", "recall", "f1"):
        if classes != 2:
            raise ValueError(f"{scoring} scores two classes only")
        row = metrics.binary_metrics(scored, 1.0, rows=rows).first()
        return float(row[scoring]) if row else 0.0
    raise ValueError(f"unknown scorer {scoring!r}")


class ScorerEvaluator(Evaluator):
    """Lets the cross-validator rank models by a named scorer."""

    def __init__(self, scoring: str, classes: int):
        super().__init__()
        self.scoring = scoring
        self.classes = classes

    def _evaluate(self, dataset: DataFrame) -> float:
        return scorer_value(dataset, self.scoring, self.classes, ROWS if ROWS in dataset.columns else None)

    def isLargerBetter(self) -> bool:
        return True


def _searched(folded: DataFrame, before: list, candidates: list, evaluator: Evaluator, folds: int, parallelism: int):
    """Mean and deviation of the score per candidate, and the best one fitted on all folds."""
    # each candidate is a whole last stage, so one pipeline parameter carries the grid
    pipeline = Pipeline(stages=[])
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=[{pipeline.stages: [*before, c]} for c in candidates],
        evaluator=evaluator,
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    ).fit(folded)
    return list(search.avgMetrics), list(search.stdMetrics), search.bestModel


def grid_search(
    df: DataFrame,
    target: str,
    task: str,
    model: str,
    grid: dict[str, list],
    key: list[str],
    features: list[str] | None = None,
    test_size: float = 0.2,
    folds: int = 5,
    scoring: str | None = None,
    seed: int = 42,
    parallelism: int = 4,
) -> Trained:
    """Cross-validate every combination of ``grid`` on the training rows and refit the best.

    A linear regression is not fitted per fold: its fold models come from sums of products by subtraction. For other linear
    models equal rows of a fold are one with a weight. The folds are fixed as a table, so no fit reads the input again.
    """
    scoring = scoring or ("accuracy" if task.lower() == "classification" else "r2")
    if scoring not in SCORERS[task.lower()]:
        raise ValueError(f"scorer {scoring!r} does not fit task {task!r}")
    features, classes, train_rows, test_rows, n = _prepare(df, target, task, model, key, test_size, seed, features)
    names = list(grid)
    combos = [dict(zip(names, values)) for values in product(*grid.values())]
    in_fold = max(1, n * (folds - 1) // folds)
    candidates = [_estimator(task, model, in_fold, len(classes or []), seed, c, key) for c in combos]

    before, after = _stages(target, features, classes)
    folded = assign_folds(train_rows, key, folds, seed, target if classes is not None else None)
    folded = _labelled(folded, target, classes)
    if (task.lower(), model.lower()) == ("regression", "linear_regression"):
        by_fold = np.array(linear_scores(folded, target, features, folds, scoring))
        scores, spread, refit = [by_fold.mean()], [by_fold.std()], None
    else:
        if all(isinstance(c, WEIGHTED) for c in candidates):
            folded = _counted(folded, target, features)
            for c in candidates:
                c.setWeightCol(ROWS)
        else:
            folded = cut_lineage(folded)
        scores, spread, refit = _searched(folded, before, candidates, ScorerEvaluator(scoring, len(classes or [])), folds, parallelism)
    best = max(range(len(combos)), key=lambda i: scores[i])
    weighted = isinstance(candidates[best], WEIGHTED)
    if refit is None or "C" in combos[best]:  # its strength depends on the row count, so fit at full size
        estimator = _estimator(task, model, n, len(classes or []), seed, combos[best], key)
        if weighted:
            estimator.setWeightCol(ROWS)
        refit = Pipeline(stages=[*before, estimator]).fit(folded if weighted else _labelled(train_rows, target, classes))
    fitted = PipelineModel(stages=[*refit.stages, *after])
    config = {
        "operation": "train_model_with_gridsearch",
        "task_type": task.lower(),
        "model_type": model.lower(),
        "target_column": target,
        "feature_columns": features,
        "classes": classes,
        "random_seed": seed,
        "best_params": combos[best],
        "best_score": float(scores[best]),
        "cv_folds": folds,
        "scoring": scoring,
        "grid_search_results": {
            "mean_test_score": [float(v) for v in scores],
            "std_test_score": [float(v) for v in spread],
            "params": combos,
        },
    }
    return Trained(fitted, test_rows, config)


def cluster(
    df: DataFrame, features: list[str], method: str = "kmeans", seed: int = 42,
    n_clusters: int = 3, init: str = "k-means++", max_iter: int | None = None, n_init: int = 1,
) -> tuple[DataFrame, dict]:
    """Add ``cluster``; every column of the frame is kept.

    ``kmeans`` starts from the scalable form of k-means++; ``gmm`` uses full covariances and
    keeps the best likelihood of ``n_init`` starts, which share their passes.
    """
    rows = without_nan(df)
    numeric = [as_double(df, f).alias(f"_x{i}") for i, f in enumerate(features)]
    found = {}
    if method == "kmeans":
        ready = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))], outputCol="_features").transform(
            rows.select("*", *numeric)
        )
        mode = {"k-means++": "k-means||", "random": "random"}[init]
        model = KMeans(k=n_clusters, initMode=mode, maxIter=max_iter or 300, seed=seed, featuresCol="_features", predictionCol="cluster").fit(ready)
        out = model.transform(ready).select(*[col(c) for c in df.columns], "cluster")
    elif method == "gmm":
        x = [as_double(rows, f) for f in features]
        model = fit_mixture(rows, x, n_clusters, max_iter or 100, n_init, seed)
        out = rows.withColumn("cluster", model.cluster(x))
        found = {"log_likelihood": model.log_likelihood}
    else:
        raise ValueError("method must be 'kmeans' or 'gmm'")
    config = {
        "operation": "clustering",
        "method": method,
        "params": {"n_clusters": n_clusters, "seed": seed} | ({"init": init} if method == "kmeans" else {"n_init": n_init}),
        "features": list(features),
    }
    return out, config | found
