import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from millrace.operators import celltree, crossval, metrics, mixture, models, plotdata, quality, split, synth, trees
from millrace.operators.split import assign_folds, largest_remainder, train_test_split, validate_target


def test_split_is_exact_disjoint_and_repeatable(spark):
    df = spark.range(1_003)
    out = train_test_split(df, ["id"], 0.25, 3)
    counts = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"test": math.ceil(1_003 * 0.25), "train": 1_003 - math.ceil(1_003 * 0.25)}
    again = train_test_split(df.repartition(7), ["id"], 0.25, 3)
    assert out.join(again, ["id", "split"]).count() == 1_003


def test_stratified_split_shares_and_fallback(spark):
    df = spark.range(1_000).withColumn("c", F.when(F.col("id") % 10 == 0, "r").otherwise("f"))
    out = train_test_split(df, ["id"], 0.2, 1, "c").where("split = 'test'")
    assert {r["c"]: r["n"] for r in out.groupBy("c").agg(F.count("*").alias("n")).collect()} == {"r": 20, "f": 180}
    lonely = df.withColumn("c", F.when(F.col("id") == 3, "only").otherwise("f"))
    assert train_test_split(lonely, ["id"], 0.2, 1, "c").where("split = 'test'").count() == 200


def test_many_small_classes_use_the_window(spark):
    df = spark.range(2_000).withColumn("c", F.col("id") % 100)
    out = train_test_split(df, ["id"], 0.25, 1, "c")
    assert out.count() == 2_000
    assert {r["n"] for r in out.where("split = 'test'").groupBy("c").agg(F.count("*").alias("n")).collect()} == {5}


def test_folds_are_even(spark):
    df = spark.range(100).withColumn("c", (F.col("id") % 4 == 0).cast("int"))
    sizes = assign_folds(df, ["id"], 5, 1, "c").groupBy("c", "fold").agg(F.count("*").alias("n")).collect()
    assert {(r["c"], r["n"]) for r in sizes} == {(0, 15), (1, 5)} and len(sizes) == 10


def test_largest_remainder_adds_up():
    assert largest_remainder({"a": 5, "b": 3, "c": 2}, 4) == {"a": 2, "b": 1, "c": 1}


def test_largest_remainder_of_a_table_equals_the_one_of_a_dict(frame):
    counts = {None: 7, "None": 7} | {f"c{i}": 3 + i * i % 11 for i in range(200)}
    classes = frame(list(counts.items()), "class string, rows bigint")
    for total in (0, 1, 333, sum(counts.values())):
        shared = {r["class"]: r["given"] for r in split.largest_remainders(classes, total).collect()}
        assert shared == largest_remainder(counts, total)


@pytest.mark.parametrize("window", [500_000, 40])
def test_many_classes_with_a_hot_and_a_null_one(spark, monkeypatch, window):
    monkeypatch.setattr(split, "WINDOW_ROWS", window)
    df = spark.range(1_500).withColumn("c", F.expr("CASE WHEN id < 500 THEN 'hot' WHEN id >= 600 THEN CAST(id % 90 AS string) END"))
    rows = df.withColumn("h", split.seeded_hash(7, "id")).orderBy("h", "id").collect()
    counts = {}
    for r in rows:
        counts[r["c"]] = counts.get(r["c"], 0) + 1
    given, seen, test, fold = largest_remainder(counts, 450), {}, set(), {}
    for r in rows:
        at = seen[r["c"]] = seen.get(r["c"], 0) + 1
        fold[r["id"]] = sum(at > math.ceil(counts[r["c"]] * i / 4) for i in (1, 2, 3))
        if at <= given[r["c"]]:
            test.add(r["id"])
    out = train_test_split(df, ["id"], 0.3, 7, "c")
    assert out.columns == ["id", "c", "split"] and out.count() == 1_500
    assert {r["id"] for r in out.where("split = 'test'").collect()} == test
    assert {r["id"]: r["fold"] for r in assign_folds(df, ["id"], 4, 7, "c").collect()} == fold


def test_split_of_many_classes_moves_no_count_to_the_driver(spark, monkeypatch):
    df = spark.range(1_000).withColumn("c", F.col("id") % 100)
    sizes, whole = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: sizes.append(len(found := whole(self))) or found)
    out = train_test_split(df, ["id"], 0.2, 1, "c")
    assert max(sizes) <= split.CLASSES_PER_PASS + 1
    assert out.where("split = 'test'").count() == 200


def test_target_checks(frame):
    df = frame([(1, None), (2, None)], "id int, y double")
    with pytest.raises(ValueError, match="does not exist"):
        validate_target(df, "z", 0.2)
    with pytest.raises(ValueError, match="between"):
        validate_target(df, "y", 1.0)
    with pytest.raises(ValueError, match="missing"):
        validate_target(df, "y", 0.2)
    with pytest.raises(ValueError, match="empty"):
        validate_target(df.limit(0), "y", 0.2)
    with pytest.raises(ValueError, match="too few"):
        validate_target(df.limit(1), "id", 0.5)


def _pairwise_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_equals_pair_counting_and_the_curve(frame):
    rows = [((i * 37 % 11) / 10, int(i * 13 % 7 < 3)) for i in range(120)]
    df = frame(rows, "score double, label int")
    auc = metrics.roc_auc(df, {1: "score"}).first()["roc_auc"]
    assert auc == pytest.approx(_pairwise_auc(rows))
    curve = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_curve(df, {1: "score"}).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in itertools.pairwise(curve))
    assert area == pytest.approx(auc)


def test_auc_of_one_class_is_null(frame):
    assert metrics.roc_auc(frame([(0.5, 1)], "score double, label int"), {1: "score"}).first()["roc_auc"] is None


def test_confusion_matrix_is_dense_and_adds_up(frame):
    df = frame([(0, 1), (0, 0), (2, 0), (2, 2)], "label int, prediction int")
    cells = {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 4 and cells[(0, 1)] == 1 and cells[(1, 1)] == 0


def test_zero_division_is_zero(frame):
    row = metrics.classification_metrics(frame([(0, 1), (0, 1)], "label int, prediction int")).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1_score"]) == (0, 0, 0, 0)


def test_r2_of_constants(frame):
    perfect = frame([(2.0, 2.0)] * 3, "label double, prediction double")
    assert metrics.regression_metrics(perfect).first()["r2"] == 1.0
    off = frame([(2.0, 3.0)] * 3, "label double, prediction double")
    assert metrics.regression_metrics(off).first()["r2"] == 0.0


def _silhouette(points, distance):
    out = []
    for i, (x, c) in enumerate(points):
        by = {}
        for j, (y, d) in enumerate(points):
            if i != j:
                by.setdefault(d, []).append(distance(x, y))
        if c not in by:
            out.append(0.0)
            continue
        a = sum(by[c]) / len(by[c])
        b = min(sum(v) / len(v) for d, v in by.items() if d != c)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return sum(out) / len(out)


@pytest.mark.parametrize("block", [5, 2_048])
def test_silhouettes_match_brute_force(frame, monkeypatch, block):
    monkeypatch.setattr(metrics, "BLOCK_POINTS", block)
    points = [(((i * 7 % 13) / 2.0, float(i * 5 % 11)), i % 3) for i in range(60)] * 2 + [((50.0, 50.0), 7)]
    df = frame([(*x, c) for x, c in points], "x double, y double, cluster int")
    found = metrics.silhouette(df, ["x", "y"], metric="euclidean").first()["silhouette_score"]
    assert found == pytest.approx(_silhouette(points, math.dist))
    squared = metrics.silhouette(df, ["x", "y", "cluster"], metric="squared_euclidean").first()["silhouette_score"]
    assert squared == pytest.approx(_silhouette(points, lambda a, b: math.dist(a, b) ** 2))


def _grid(spark, side):
    step = 20.0 / side
    at = [(c * 30.0 + i * step, j * step + (i * j % 3) * 0.01, c) for c in range(3) for i in range(side) for j in range(side)]
    return at, spark.createDataFrame(at, "x double, y double, cluster int")


def test_silhouette_of_cells_stays_within_its_bound_and_below_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(celltree, "FAN", 8)
    opened = []
    for side in (12, 24):
        at, df = _grid(spark, side)
        tree = celltree.CellTree(df, ["x", "y"], "cluster", 8)
        near, far = tree.walk(0.2)
        opened.append(near.count())
        assert opened[-1] < sum(tree.leaf_counts) ** 2 / 2 and not far.isEmpty()
        # every leaf meets every row of every cluster once, as a point or in a node
        rows = far.selectExpr("own", "leaf", "b_own", "n").unionByName(
            near.join(tree.leaves.selectExpr("own b_own", "leaf b_node", "size(rows) / 3 n"), ["b_own", "b_node"]).select("own", "leaf", "b_own", "n")
        )
        assert {r["n"] for r in rows.groupBy("own", "leaf", "b_own").sum("n").toDF("own", "leaf", "b_own", "n").collect()} == {side * side}
    assert opened[1] < 8 * opened[0]  # all pairs of leaves would be sixteen times as many
    exact = _silhouette([(p[:2], p[2]) for p in at], math.dist)
    assert tree.score(0.2).first()[0] == pytest.approx(exact, abs=0.2)
    assert tree.score(0.01).first()[0] == pytest.approx(exact, abs=0.01)
    assert tree.score(0.0).first()[0] == pytest.approx(exact)


@pytest.mark.parametrize("strips, strip_leaves", [(24, 16), (5, 16), (2, 3), (1, 100)])
def test_silhouette_of_tiles_measures_every_two_points_once(spark, monkeypatch, strips, strip_leaves):
    """A leaf is sent to as many tiles as there are strips, not to every leaf; strips may hold leaves of two clusters."""
    monkeypatch.setattr(celltree, "STRIPS", strips)
    monkeypatch.setattr(celltree, "STRIP_LEAVES", strip_leaves)
    at = [((i * 7 % 31 / 2.0, float(i * 5 % 29)), 0 if i < 40 else 1 if i < 57 else 2) for i in range(150)]
    df = spark.createDataFrame([(*x, c) for x, c in at * 2], "x double, y double, cluster int")
    tree = celltree.CellTree(df, ["x", "y"], "cluster", 8)
    leaves = sum(tree.leaf_counts)
    assert leaves == 5 + 3 + 12
    held = min(strip_leaves, -(-leaves // strips))
    assert tree._tiled().count() == 150 * -(-leaves // held)
    assert tree.score(0.0).first()[0] == pytest.approx(_silhouette(at * 2, math.dist))


def test_silhouette_of_groups_keeps_every_mean_distance_within_its_share(spark, monkeypatch):
    """Nodes are met by groups of leaves, and a task hands on a row per leaf or group, not per point."""
    monkeypatch.setattr(celltree, "FAN", 4)
    monkeypatch.setattr(celltree, "STRIPS", 3)
    draw = np.random.default_rng(5)
    at = [(float(x), float(y), c) for c, n in ((0, 700), (1, 300), (2, 90)) for x, y in draw.normal(c, 1 + c, (n, 2))]
    at = at + at[::3]
    tree = celltree.CellTree(spark.createDataFrame(at, "x double, y double, cluster int"), ["x", "y"], "cluster", 8)
    leaves, groups = sum(tree.leaf_counts), sum(-(-n // 4) for n in tree.leaf_counts)
    assert tree._tiles().count() == leaves * 3
    points, share = np.array(at), math.tanh(0.05)
    exact = {c: np.array([np.hypot(*(points[points[:, 2] == c, :2] - p[:2]).T).sum() for p in points]) for c in range(3)}
    where = {tuple(p[:2]): i for i, p in enumerate(points)}
    gathered = tree._groups()
    pairs, far = tree._opened(gathered, share)
    assert pairs.count() + far.count() <= groups * groups < leaves * leaves / 8 and not far.isEmpty()
    rows = {(r["own"], r["grp"]): np.reshape(r["rows"], (-1, 3)) for r in gathered.collect()}
    assert len(rows) == groups
    sums = {key: np.zeros((3, len(a))) for key, a in rows.items()}
    for r in tree._met(gathered, 0.1).collect():
        sums[r["own"], r["leaf"]][r["b_own"]] += r["sums"]
    for key, a in rows.items():
        for c in range(3):
            wanted = np.array([exact[c][where[tuple(p)]] for p in a[:, 1:]])
            assert (abs(sums[key][c] - wanted) <= share * wanted).all()
    assert tree.score(0.1).first()[0] == pytest.approx(tree.score(0.0).first()[0], abs=0.1)
    assert tree.score(0.0).first()[0] == pytest.approx(_silhouette([(p[:2], p[2]) for p in at], math.dist))


@pytest.mark.parametrize("shift, apart", [(0.0, 3.0), (1e6, 3.0), (-5.0, 40.0), (0.0, 0.1)])
def test_squares_of_points_far_apart_keep_their_digits(monkeypatch, shift, apart):
    monkeypatch.setattr(celltree, "MANY", 30)
    draw = np.random.default_rng(2)
    x, y = draw.random((37, 3)) + shift, draw.random((50, 3)) + shift + apart
    found = np.vstack([d.copy() for _, _, d in celltree._squares_of()(x, y)])
    wanted = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    assert found.shape == (37, 50) and np.allclose(found, wanted, rtol=1e-13, atol=0)


def _points(spark, n=300):
    return spark.range(0, n, 1, 2).select(
        "id",
        (F.col("id") % 17).alias("x"),
        (F.col("id") % 5 * 1.0).alias("z"),
        F.when(F.col("id") % 17 > 8, "up").otherwise("down").alias("side"),
        (F.col("id") % 17 * 3.0 + 1).alias("y"),
    )


def test_training_learns_and_scores(spark):
    trained = models.train(_points(spark), "side", "classification", "logistic_regression", ["id"], ["x", "z"], C=100.0, max_iter=20)
    found = models.evaluate(trained)
    assert found["accuracy"] > 0.95 and found["roc_auc"] > 0.99
    scored = models.score(trained.model, _points(spark).drop("side"))
    assert {r["predicted_class"] for r in scored.collect()} == {"up", "down"}
    line = models.train(_points(spark), "y", "regression", "linear_regression", ["id"], ["x"])
    assert models.evaluate(line)["r2"] == pytest.approx(1.0)


@pytest.mark.parametrize("model", ["random_forest", "svm", "xgboost"])
def test_three_class_models(spark, model):
    df = _points(spark).withColumn("band", F.floor(F.col("x") / 6))
    params = {"random_forest": {"n_estimators": 5}, "svm": {"C": 10.0, "max_iter": 5}, "xgboost": {"n_estimators": 3, "max_depth": 2}}[model]
    trained = models.train(df, "band", "classification", model, ["id"], ["x", "z"], **params)
    found = models.evaluate(trained)
    assert 0 <= found["accuracy"] <= 1 and 0.5 < found["roc_auc"] <= 1


def test_model_errors(spark):
    df = _points(spark, 50)
    bad = [
        ("y", "regression", "svr", ["x"], {}),
        ("side", "classification", "svm", ["x"], {"kernel": "rbf"}),
        ("side", "classification", "xgboost", ["x"], {"min_samples_split": 5}),
        ("side", "classification", "random_forest", ["x"], {"magic": 5}),
        ("y", "regression", "linear_regression", ["side"], {}),
    ]
    for target, task, model, features, params in bad:
        with pytest.raises(ValueError):
            models.train(df, target, task, model, ["id"], features, **params)


def test_grid_rule():
    assert models.parameter_grid("Logistic_Regression", C=1.0, max_iter=100, penalty="l2") == {
        "C": [0.1, 1.0, 10.0], "max_iter": [100, 200], "penalty": ["l2"],
    }
    assert models.parameter_grid("Random_Forest", n_estimators=20, max_depth=2)["n_estimators"] == [10, 20, 70]
    assert models.parameter_grid("Random_Forest", n_estimators=20, max_depth=2)["max_depth"] == [1, 2, 4]
    assert models.parameter_grid("XGBoost", learning_rate=0.2)["learning_rate"] == [0.1, 0.2]
    assert models.parameter_grid("SVM", C=2.0)["C"] == [0.2, 2.0, 20.0]
    assert models.parameter_grid("Linear_Regression") == {}


def _plane(spark, rows=900):
    """Two varying features at a large offset, one that repeats another, a flag, a gap in the target."""
    return spark.range(rows).selectExpr(
        "id", "1e6 + id % 31 AS a", "CAST(id * 7 % 53 AS int) AS b", "2 * (id * 7 % 53) AS c", "id % 3 = 0 AS flag",
        "CASE WHEN id = 5 THEN NULL ELSE 1e7 + 3 * (id % 31) - 2 * (id * 7 % 53) + id * id % 17 END AS y",
    )


def _brute_fold_scores(folded, features):
    rows = [r for r in folded.collect() if r["y"] is not None]
    x = np.array([[1.0, *[float(r[f]) for f in features]] for r in rows])
    y, fold = np.array([r["y"] for r in rows]), np.array([r["fold"] for r in rows])
    out = []
    for f in range(fold.max() + 1):
        held = fold == f
        centre = x[~held].mean(axis=0) * np.array([0.0, *[1.0] * len(features)])
        model = np.linalg.lstsq(x[~held] - centre, y[~held], rcond=1e-10)[0]
        e = y[held] - (x[held] - centre) @ model
        out.append((held.sum(), (e**2).mean(), 1 - (e**2).mean() / y[held].var(), np.abs(e).mean()))
    return out


def test_folds_by_subtraction_equal_a_fit_per_fold(spark):
    df, features = _plane(spark), ["a", "b", "c", "flag"]
    found = crossval.cross_validate_linear(df, "y", features, ["id"], 4, 9).orderBy("fold").collect()
    folded = assign_folds(df.where("y IS NOT NULL"), ["id"], 4, 9)
    brute = _brute_fold_scores(folded, features)
    for r, (rows, mse, r2, _) in zip(found, brute, strict=True):
        assert r["rows"] == rows and r["mse"] == pytest.approx(mse, rel=1e-6) and r["r2"] == pytest.approx(r2, rel=1e-6)
    for scoring, at, sign in (("neg_mean_absolute_error", 3, -1), ("neg_root_mean_squared_error", 1, -1), ("r2", 2, 1)):
        value = [b[at] ** (0.5 if "root" in scoring else 1) * sign for b in brute]
        assert crossval.linear_scores(folded, "y", features, 4, scoring) == pytest.approx(value, rel=1e-6)


def test_grid_search_of_a_linear_regression_makes_no_fit_per_fold(spark, monkeypatch):
    monkeypatch.setattr(models, "CrossValidator", None)
    df = _plane(spark).drop("c")
    found = models.grid_search(df, "y", "regression", "linear_regression", {}, ["id"], ["a", "b", "flag"], folds=3)
    train_rows = train_test_split(df, ["id"], 0.2, 42).where("split = 'train'")
    scores = [s[2] for s in _brute_fold_scores(assign_folds(train_rows, ["id"], 3, 42), ["a", "b", "flag"])]
    results = found.config["grid_search_results"]
    assert results["mean_test_score"] == pytest.approx([np.mean(scores)], rel=1e-6)
    assert results["std_test_score"] == pytest.approx([np.std(scores)], rel=1e-4) and results["params"] == [{}]
    assert models.evaluate(found)["r2"] > 0.9


def test_grid_search_takes_equal_rows_as_one(spark, monkeypatch):
    """The fits read a row per distinct row of a fold, weighted by its number."""
    df = spark.range(0, 300, 1, 2).selectExpr("id", "id % 7 AS x", "IF((id % 7 > 3) <> (id % 5 = 0), 'up', 'down') AS side")

    class Read(Exception):
        pass

    def seen(folded, before, candidates, *rest):
        row = folded.agg(F.count("*"), F.sum("_rows")).first()
        raise Read(row[0], row[1], [c.getWeightCol() for c in candidates])

    monkeypatch.setattr(models, "_searched", seen)
    with pytest.raises(Read) as found:
        models.grid_search(df, "side", "classification", "svm", {"C": [1.0]}, ["id"], ["x"], folds=2)
    rows, stand_for, weights = found.value.args
    assert rows <= 2 * 7 * 2 and stand_for == 240 and weights == ["_rows"]


def test_scorers_count_what_a_row_stands_for(frame):
    few = [(0.0, 0.0, 0.2, 5), (0.0, 1.0, 0.7, 2), (1.0, 1.0, 0.8, 4), (1.0, 0.0, 0.2, 3)]
    schema = "label double, prediction double, scores array<double>"
    together = frame([(y, p, [1 - s, s], n) for y, p, s, n in few], schema + ", n long")
    each = frame([(y, p, [1 - s, s]) for y, p, s, n in few for _ in range(n)], schema)
    for scoring in ("accuracy", "f1", "roc_auc"):
        assert models.scorer_value(together, scoring, 2, "n") == pytest.approx(models.scorer_value(each, scoring, 2))


def test_folds_by_subtraction_refuse_gaps_and_empty_folds(spark):
    df = _plane(spark, 20).withColumn("a", F.expr("CASE WHEN id <> 3 THEN a END"))
    with pytest.raises(ValueError, match="missing"):
        crossval.cross_validate_linear(df, "y", ["a"], ["id"], 3)
    with pytest.raises(ValueError, match="empty"):
        crossval.cross_validate_linear(_plane(spark, 2), "y", ["b"], ["id"], 3)


def test_grid_search_picks_the_deeper_tree(spark):
    found = models.grid_search(
        _points(spark), "y", "regression", "random_forest", {"max_depth": [1, 6], "n_estimators": [5]}, ["id"], ["x"], folds=2
    )
    assert found.config["best_params"]["max_depth"] == 6
    assert len(found.config["grid_search_results"]["mean_test_score"]) == 2
    with pytest.raises(ValueError):
        models.grid_search(_points(spark), "y", "regression", "random_forest", {}, ["id"], ["x"], scoring="f1")


def test_clusters_keep_every_column(spark):
    df = _points(spark)
    for method in ("kmeans", "gmm"):
        out, config = models.cluster(df, ["x", "z"], method, n_clusters=2, n_init=1)
        assert out.columns == [*df.columns, "cluster"] and out.count() == 300
    assert config["method"] == "gmm"
    with pytest.raises(ValueError):
        models.cluster(df, ["x"], "dbscan")


# ---- synthetic data -------------------------------------------------------------------


def _people(spark, n=2_000):
    return spark.range(n).select(
        "id",
        (F.randn(1) * 10 + 50).alias("age"),
        F.when(F.rand(2) < 0.7, "a").otherwise("b").alias("kind"),
        F.when(F.rand(3) > 0.2, F.round(F.rand(4) * 100, 2)).alias("spend"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(mins=F.col("id").cast("int"))).alias("at"),
    ).withColumn("weight", F.col("age") * 2 + F.randn(5))


def test_copula_keeps_marginals_and_dependence(spark, tmp_path):
    path = str(tmp_path / "people")
    _people(spark).write.parquet(path)
    df = spark.read.parquet(path)
    fitted = synth.fit_copula(df)
    assert fitted.roles == {"id": "id", "age": "numerical", "kind": "categorical", "spend": "numerical", "at": "datetime", "weight": "numerical"}
    made = synth.sample_copula(spark, fitted, 3_000, 5)
    assert made.dtypes == df.dtypes and made.count() == 3_000
    real = df.agg(F.corr("age", "weight"), F.avg("spend"), F.count("spend") / F.count("*"), F.min("at"), F.max("at")).first()
    fake = made.agg(F.corr("age", "weight"), F.avg("spend"), F.count("spend") / F.count("*"), F.min("at"), F.max("at")).first()
    assert fake[0] == pytest.approx(real[0], abs=0.05)
    assert fake[1] == pytest.approx(real[1], rel=0.1)
    assert fake[2] == pytest.approx(real[2], abs=0.05)
    assert real[3] <= fake[3] and fake[4] <= real[4]
    assert made.where("spend <> round(spend, 2)").count() == 0
    share = made.where("kind = 'a'").count() / 3_000
    assert share == pytest.approx(0.7, abs=0.05)
    again = synth.sample_copula(spark, fitted, 3_000, 5).repartition(3)
    assert made.exceptAll(again).count() == 0


def test_pairs_of_columns_are_counted_without_laying_rows_out(spark):
    rows = [(None if i % 5 == 0 else f"a{i % 4}", f"b{i % 3}", i % 7 == 0, f"wide{i}") for i in range(300)]
    other = [(f"a{i % 4}", None if i % 2 else f"b{i % 3}", i % 3 == 0, f"wide{i + 150}") for i in range(200)]
    real, made = (spark.createDataFrame(r, "a string, b string, c boolean, d string").repartition(3) for r in (rows, other))
    found = {(r["a"], r["b"]): r["score"] for r in quality.contingency_trends(real, made).collect()}
    assert len(found) == 6
    for (a, b), score in found.items():
        i, j = "abcd".index(a), "abcd".index(b)
        left, right = Counter((r[i], r[j]) for r in rows), Counter((r[i], r[j]) for r in other)
        assert score == pytest.approx(1 - sum(abs(left[k] / 300 - right[k] / 200) for k in {*left, *right}) / 2)
    empty = real.limit(0)
    assert quality.contingency_trends(empty, empty).count() == 0
    assert all(r["score"] == pytest.approx(0.5) for r in quality.contingency_trends(real, empty).collect())


def test_quality_of_identical_tables_is_one(spark):
    df = _people(spark, 400).drop("id")
    df = spark.createDataFrame(df.collect(), df.schema)
    report = {(r["property"], r["metric"]): r["score"] for r in quality.quality_report(df, df).collect()}
    assert report[("Overall", "Overall")] == pytest.approx(1.0)


def test_ks_of_disjoint_ranges_is_zero(frame):
    a, b = frame([(1.0,), (2.0,)], "x double"), frame([(5.0,), (6.0,)], "x double")
    assert quality.continuous_shapes(a, b).first()["score"] == 0.0


def test_synthesize_grades_itself(spark):
    df = _people(spark, 300).select("age", "kind")
    df = spark.createDataFrame(df.collect(), df.schema)
    made, config = synth.synthesize(df, 200)
    assert made.count() == 200 and 0.7 < config["quality_evaluation"]["overall_score"] <= 1
    with pytest.raises(ValueError):
        synth.synthesize(df, 10, "ctgan")


# ---- plot data ------------------------------------------------------------------------


def test_constant_histogram_and_density(frame):
    df = frame([(5.0,)] * 3 + [(None,)], "x double")
    bins = plotdata.histogram(df, "x").collect()
    assert len(bins) == 30 and sum(r["n"] for r in bins) == 3
    assert plotdata.density(df, "x").count() == 0


def test_histogram_counts_match_direct_binning(frame):
    values = [i * 0.1 for i in range(301)]
    rows = plotdata.histogram(frame([(v,) for v in values], "x double"), "x").orderBy("bin").collect()
    assert sum(r["n"] for r in rows) == 301
    for r in rows[:-1]:
        assert r["n"] == sum(r["low"] <= v < r["high"] for v in values)


def test_density_equals_the_full_sum(frame):
    values = [float(i * i % 97) for i in range(150)]
    rows = plotdata.density(frame([(v,) for v in values], "x double"), "x", 50, cut=2.0).collect()
    n, mean = len(values), sum(values) / len(values)
    width = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1)) * n ** (-0.2)
    for r in rows:
        full = sum(math.exp(-0.5 * ((r["x"] - v) / width) ** 2) for v in values) / (n * width * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(full, rel=1e-9)


def test_scatter_errors_and_colour_rule(frame):
    df = frame([(1, 1.0, 2.0, "r"), (2, None, 3.0, "g")], "id int, a double, b double, c string")
    with pytest.raises(ValueError):
        plotdata.scatter(df, ["a"], ["id"])
    with pytest.raises(ValueError):
        plotdata.scatter(df, ["a", "c"], ["id"])
    assert plotdata.scatter(df, ["a", "b"], ["id"], "c").count() == 1
    side = plotdata.compare_scatter(df, ["a", "b"], df, ["a", "b"], "a", "c").orderBy("side").collect()
    assert [(r["side"], r["colour_value"], r["colour_class"]) for r in side] == [(1, None, None), (2, None, "r")]


# ---- trees ----------------------------------------------------------------------------


def _noisy(spark, n=400):
    return spark.range(n).select(
        "id", (F.col("id") % 23).alias("x"), (F.col("id") % 7 * 1.0).alias("z"), ((F.col("id") * 7919 % 101) + F.col("id") % 23 * F.col("id") % 7).cast("double").alias("y")
    )


def _nodes(trained):
    return [t for s in trained.model.stages if isinstance(s, trees.TreesModel) for t in s.described()["trees"]]


def test_trees_without_a_depth_limit_fit_what_can_be_told_apart(spark):
    df = spark.range(64).select("id", F.col("id").alias("x"), (F.col("id") * 37 % 64 * 1.0).alias("y"))
    trained = models.train(df, "y", "regression", "xgboost", ["id"], ["x"], test_size=0.1, n_estimators=1, learning_rate=1.0, max_depth=None)
    train = df.join(trained.test.select("id"), "id", "left_anti")
    assert {(r["y"], round(r["prediction"], 6)) for r in models.score(trained.model, train).collect() if r["y"] != r["prediction"]} <= {
        (r["y"], r["y"]) for r in train.collect()
    }
    depths = [0]
    tree = _nodes(trained)[0]
    for node, left, right in zip(range(len(tree["feature"])), tree["left"], tree["right"]):
        depths += [0] * (max(left, right) + 1 - len(depths))
        if tree["feature"][node] >= 0:
            depths[left] = depths[right] = depths[node] + 1
    assert max(depths) > 6


def test_min_samples_split_and_leaf(spark):
    df = _noisy(spark)
    few = models.train(df, "y", "regression", "random_forest", ["id"], ["x", "z"], n_estimators=3, max_depth=None, min_samples_split=60)
    many = models.train(df, "y", "regression", "random_forest", ["id"], ["x", "z"], n_estimators=3, max_depth=None, min_samples_leaf=5)
    assert all(sum(f >= 0 for f in t["feature"]) < sum(f >= 0 for f in u["feature"]) for t, u in zip(_nodes(few), _nodes(many)))
    whole = models.train(df, "y", "regression", "random_forest", ["id"], ["x", "z"], n_estimators=2, min_samples_split=10_000)
    assert all(t["feature"] == [-1] for t in _nodes(whole))


def test_training_loss_falls_with_trees(spark):
    df = _noisy(spark)
    losses = []
    for n in (1, 4, 12):  # more than one fixing of the rows' predictions
        trained = models.train(df, "y", "regression", "xgboost", ["id"], ["x", "z"], n_estimators=n, learning_rate=0.3, max_depth=3)
        scored = models.score(trained.model, df.join(trained.test.select("id"), "id", "left_anti"))
        losses.append(scored.agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0])
    assert losses[0] > losses[1] > losses[2]


def test_trees_do_not_depend_on_partitions_and_survive_saving(spark, tmp_path):
    df = _noisy(spark).withColumn("band", (F.col("x") > 11).cast("int"))
    for target, task, model in (("y", "regression", "random_forest"), ("band", "classification", "xgboost"), ("z", "classification", "random_forest")):
        one = models.train(df.repartition(7), target, task, model, ["id"], ["x", "y"] if target != "y" else ["x", "z"], n_estimators=3, max_depth=4)
        two = models.train(df.coalesce(1), target, task, model, ["id"], ["x", "y"] if target != "y" else ["x", "z"], n_estimators=3, max_depth=4)
        path = str(tmp_path / f"{target}-{model}")
        one.model.save(path)
        again = PipelineModel.load(path)
        found = [
            {r["id"]: round(r["prediction"], 9) for r in models.score(m, df, target, one.classes).collect()} for m in (one.model, two.model, again)
        ]
        assert found[0] == found[1] == found[2]


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 3001 * 1.0).alias("x")).withColumn("y", F.col("x") * 2)
    trained = models.train(df, "y", "regression", "random_forest", ["id"], ["x"], n_estimators=5, max_depth=None, min_samples_leaf=2, max_bins=32)
    assert models.evaluate(trained)["r2"] > 0.99
    assert len({m for t in _nodes(trained) for f, m in zip(t["feature"], t["most"]) if f >= 0}) <= 31


def _two_hills(spark, rows=700):
    """Two overlapping hills of unlike shape."""
    return spark.range(rows).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 1000 + (id * 37 % 101) / 20.0D ELSE 1002 + (id * 53 % 97) / 40.0D END AS a",
        "CASE WHEN id % 3 = 0 THEN (id * 37 % 101) / 30.0D + (id * 11 % 13) / 10.0D ELSE (id * 29 % 89) / 15.0D END AS b",
    )


def _log_likelihood(x, m):
    logs = []
    for w, mean, cov in zip(m.weights, m.means, m.covariances):
        off = x - mean
        far = (off @ np.linalg.inv(cov) * off).sum(axis=1)
        logs.append(np.log(w) - far / 2 - np.linalg.slogdet(2 * np.pi * cov)[1] / 2)
    logs = np.array(logs)
    return np.logaddexp.reduce(logs, axis=0).sum(), logs.argmax(axis=0)


def test_mixture_starts_share_their_passes(spark, monkeypatch):
    df, x = _two_hills(spark), [F.col("a"), F.col("b")]
    points = np.array(df.select("a", "b").collect(), dtype=float)
    calls, whole = [], mixture._sums
    monkeypatch.setattr(mixture, "_sums", lambda *a: calls.append(sorted(a[3])) or whole(*a))
    best = mixture.fit_mixture(df, x, 2, max_iter=12, n_init=3, seed=1)
    assert calls[0] == [0, 1, 2] and len(calls) == best.passes <= 13
    alone = [mixture.fit_mixture(df, x, 2, max_iter=12, seed=1 + i) for i in range(3)]
    assert best.log_likelihood == pytest.approx(max(a.log_likelihood for a in alone), rel=1e-9)
    like, nearest = _log_likelihood(points, best)
    assert best.log_likelihood == pytest.approx(like, rel=1e-9)
    found = [r["c"] for r in df.select(best.cluster(x).alias("c")).collect()]
    assert found == list(nearest)


def test_mixture_steps_equal_the_textbook(spark):
    """One step from the same start, by numpy over all rows; the likelihood never falls."""
    df, x = _two_hills(spark, 300), [F.col("a"), F.col("b")]
    points = np.array(df.select("a", "b").collect(), dtype=float)
    fits = [mixture.fit_mixture(df, x, 2, max_iter=i, tol=-1.0, seed=3) for i in (0, 1, 2, 6)]
    assert all(a.log_likelihood <= b.log_likelihood + 1e-6 for a, b in zip(fits, fits[1:]))
    for old, new in zip(fits[:2], fits[1:3]):
        dens = np.array([
            w * np.exp(-((points - m) @ np.linalg.inv(c) * (points - m)).sum(axis=1) / 2) / np.sqrt(np.linalg.det(2 * np.pi * c))
            for w, m, c in zip(old.weights, old.means, old.covariances)
        ])
        share = dens / dens.sum(axis=0)
        assert new.weights == pytest.approx(share.mean(axis=1))
        for c in range(2):
            mean = share[c] @ points / share[c].sum()
            off = points - mean
            assert new.means[c] == pytest.approx(mean)
            assert new.covariances[c] == pytest.approx((off * share[c][:, None]).T @ off / share[c].sum() + 1e-6 * np.eye(2), rel=1e-6)


def test_mixture_sample_is_of_distinct_points_in_any_layout(spark, monkeypatch):
    monkeypatch.setattr(mixture, "START_ROWS", 50)
    df = spark.range(4_000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 ELSE id END * 1.0D AS x0", "0.5D AS x1")
    one = mixture._sample(df.repartition(7))
    assert len(one) == len({tuple(p) for p in one}) == 50 and (one == mixture._sample(df.coalesce(1))).all()
    least = {r["x0"] for r in df.distinct().orderBy(F.xxhash64("x0", "x1")).limit(50).collect()}
    assert set(one[:, 0]) == least


def test_mixture_refuses_gaps_and_takes_a_constant(spark):
    df = spark.range(40).selectExpr("id * 1.0D AS a", "5.0D AS b", "CASE WHEN id = 2 THEN NULL ELSE 1.0D END AS c")
    flat = mixture.fit_mixture(df, [F.col("a"), F.col("b")], 2)
    assert flat.means[:, 1] == pytest.approx([5.0, 5.0])
    with pytest.raises(ValueError, match="missing"):
        mixture.fit_mixture(df, [F.col("a"), F.col("c")], 2)
    with pytest.raises(ValueError, match="too few"):
        mixture.fit_mixture(df.limit(1), [F.col("a")], 2)
