"""Scored-table metrics, training, grid search and clustering."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import crossval, metrics, mixture, models, split, trees
from workload.book import hash_sql, query, r, round_columns


def _report_sql(view: str) -> str:
    return f"""(SELECT c AS class, sum(support) support, sum(predicted) predicted, sum(hits) hits,
        CASE WHEN sum(predicted) > 0 THEN sum(hits) / sum(predicted)::DOUBLE ELSE 0 END AS precision,
        CASE WHEN sum(support) > 0 THEN sum(hits) / sum(support)::DOUBLE ELSE 0 END AS recall FROM
        (SELECT label c, 1 support, 0 predicted, CASE WHEN label = prediction THEN 1 ELSE 0 END hits FROM {{{view}}}
         UNION ALL SELECT prediction, 0, 1, 0 FROM {{{view}}}) GROUP BY c)"""


F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END"


def _metrics_sql(view: str) -> str:
    return f"""SELECT {r("sum(hits) / sum(support)::DOUBLE")} AS accuracy, {r("sum(precision * support) / sum(support)")} AS precision,
        {r("sum(recall * support) / sum(support)")} AS recall, {r(f"sum({F1} * support) / sum(support)")} AS f1_score,
        {r("avg(recall) FILTER (support > 0)")} AS balanced_accuracy FROM {_report_sql(view)}"""


QUALITY = ["accuracy", "precision", "recall", "f1_score", "balanced_accuracy"]


@query("classification_metrics", _metrics_sql("scored_multi"))
def classification_metrics(t):
    return round_columns(metrics.classification_metrics(t.view("scored_multi")), QUALITY)


@query("classification_metrics_binary", _metrics_sql("scored_binary"))
def classification_metrics_binary(t):
    return round_columns(metrics.classification_metrics(t.view("scored_binary")), QUALITY)


@query(
    "class_report",
    f"""SELECT class, support::BIGINT AS support, predicted::BIGINT AS predicted, hits::BIGINT AS hits, {r("precision")} AS precision,
        {r("recall")} AS recall, {r(F1)} AS f1 FROM {_report_sql("scored_multi")}""",
)
def class_report(t):
    return round_columns(metrics.class_report(t.view("scored_multi")), ["precision", "recall", "f1"])


def _steps_sql(view: str, label: str, score: str) -> str:
    return f"""(SELECT *, sum(pos) OVER (ORDER BY score DESC) cp, sum(neg) OVER (ORDER BY score DESC) cn, sum(pos) OVER () p, sum(neg) OVER () n
        FROM (SELECT {score} AS score, count_if(label = {label}) pos, count_if(label <> {label}) neg FROM {{{view}}} GROUP BY {score}))"""


def _auc_sql(view: str, label: str, score: str) -> str:
    return f"(SELECT sum(neg * (2.0::DOUBLE * cp - pos)) / (2.0::DOUBLE * max(p) * max(n)) AS auc FROM {_steps_sql(view, label, score)})"


BINARY_AUC = _auc_sql("scored_binary", "1", "score")
MULTI = {0: "s0", 1: "s1", 2: "s2"}


@query("roc_auc", f"SELECT {r('auc')} AS roc_auc FROM {BINARY_AUC}")
def roc_auc(t):
    return round_columns(metrics.roc_auc(t.view("scored_binary"), {1: "score"}), ["roc_auc"])


@query(
    "roc_auc_multi",
    f"SELECT {r('avg(auc)')} AS roc_auc FROM ({' UNION ALL '.join(f'SELECT auc FROM {_auc_sql("scored_multi", str(c), s)}' for c, s in MULTI.items())})",
)
def roc_auc_multi(t):
    return round_columns(metrics.roc_auc(t.view("scored_multi"), MULTI), ["roc_auc"])


def _curve_sql(view: str, label: str, score: str) -> str:
    return f"""SELECT '{label}' AS class, score AS threshold, {r("cn / n::DOUBLE")} AS fpr, {r("cp / p::DOUBLE")} AS tpr FROM {_steps_sql(view, label, score)}
        UNION ALL SELECT '{label}', NULL, 0, 0"""


@query("roc_curve", _curve_sql("scored_binary", "1", "score"))
def roc_curve(t):
    return round_columns(metrics.roc_curve(t.view("scored_binary"), {1: "score"}), ["fpr", "tpr"])


@query("roc_curve_multi", " UNION ALL ".join(_curve_sql("scored_multi", str(c), s) for c, s in MULTI.items()))
def roc_curve_multi(t):
    return round_columns(metrics.roc_curve(t.view("scored_multi"), MULTI), ["fpr", "tpr"])


REGRESSION = """(SELECT avg(power(label - prediction, 2)) mse, avg(abs(label - prediction)) mae, var_pop(label) spread FROM {scored_regression})"""


@query(
    "regression_metrics",
    f"SELECT {r('mse', 2)} AS mse, {r('sqrt(mse)', 4)} AS rmse, {r('mae', 4)} AS mae, {r('1 - mse / spread')} AS r2 FROM {REGRESSION}",
)
def regression_metrics(t):
    out = metrics.regression_metrics(t.view("scored_regression"))
    return round_columns(round_columns(round_columns(out, ["mse"], 2), ["rmse", "mae"], 4), ["r2"])


def _silhouette_sql(points: str, distance: str, metric: str) -> str:
    """Brute force over weighted points ``(cluster, x, y, w)``."""
    return f"""WITH p AS (SELECT *, row_number() OVER () id FROM ({points})),
        sizes AS (SELECT cluster c, sum(w) n FROM p GROUP BY cluster),
        d AS (SELECT a.id, a.cluster own, a.w, b.cluster c, sum({distance} * b.w) s FROM p a, p b GROUP BY a.id, a.cluster, a.w, b.cluster),
        m AS (SELECT id, own, any_value(d.w) w, max(CASE WHEN own = d.c THEN s / nullif(n - 1, 0) END) a, min(CASE WHEN own <> d.c THEN s / n END) b,
              max(CASE WHEN own = d.c THEN n END) own_n FROM d JOIN sizes ON sizes.c = d.c GROUP BY id, own)
        SELECT {r("sum(w * CASE WHEN own_n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) / sum(w)")} AS silhouette_score, '{metric}' AS metric FROM m"""


@query(
    "silhouette",
    _silhouette_sql("SELECT cluster, x, y, 1 AS w FROM {customers_clustered} v", "(power(a.x - b.x, 2) + power(a.y - b.y, 2))", "squared_euclidean"),
)
def silhouette(t):
    return round_columns(metrics.silhouette(t.view("customers_clustered"), ["x", "y", "cluster"], metric="squared_euclidean"), ["silhouette_score"])


ITEM_POINTS = "CASE WHEN l_quantity < 17 THEN 0 WHEN l_quantity < 34 THEN 1 ELSE 2 END"


@query(
    "silhouette_euclidean",
    _silhouette_sql(
        f"SELECT {ITEM_POINTS} AS cluster, l_quantity AS x, l_tax * 100 AS y, count(*) AS w FROM lineitem GROUP BY 1, 2, 3",
        "sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))",
        "euclidean",
    ),
)
def silhouette_euclidean(t):
    items = t.table("lineitem").selectExpr(f"{ITEM_POINTS} AS cluster", "l_quantity AS x", "l_tax * 100 AS y")
    return round_columns(metrics.silhouette(items, ["x", "y"], metric="euclidean"), ["silhouette_score"])


@query(
    "silhouette_euclidean_bounded",
    "SELECT *, CAST(0.05 AS DOUBLE) AS tolerance, TRUE AS within FROM ("
    + _silhouette_sql("SELECT cluster, x, y, 1 AS w FROM {customers_clustered} v", "sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))", "euclidean")
    + ")",
)
def silhouette_euclidean_bounded(t):
    """The exact score, and whether the one from groups of points is as near to it as promised."""
    points = t.view("customers_clustered")
    scores = [
        metrics.silhouette(points, ["x", "y"], metric="euclidean", tolerance=tolerance, block=block).select("*", F.lit(tolerance).alias("tolerance"))
        for tolerance, block in ((0.0, 2_048), (0.05, 32))
    ]
    out = scores[0].union(scores[1]).groupBy("metric").agg(
        F.min_by("silhouette_score", "tolerance").alias("silhouette_score"),
        F.max("tolerance").alias("tolerance"),
        (F.max("silhouette_score") - F.min("silhouette_score") <= 0.05).alias("within"),
    )
    return round_columns(out, ["silhouette_score"])


@query(
    "confusion_matrix",
    """SELECT a AS label, b AS prediction, coalesce(n, 0) AS n FROM (SELECT unnest([0, 1, 2]) a), (SELECT unnest([0, 1, 2]) b)
       LEFT JOIN (SELECT label, prediction, count(*) n FROM {scored_multi} GROUP BY ALL) c ON c.label = a AND c.prediction = b""",
)
def confusion_matrix(t):
    scored = t.view("scored_multi").selectExpr("CAST(label AS int) AS label", "CAST(prediction AS int) AS prediction")
    return metrics.confusion_matrix(scored)


BINARY_REPORT = _report_sql("scored_binary")


@query(
    "scorers",
    f"""SELECT 'accuracy' AS scorer, {r("sum(hits) / sum(support)::DOUBLE")} AS value FROM {BINARY_REPORT}
        UNION ALL SELECT 'balanced_accuracy', {r("avg(recall)")} FROM {BINARY_REPORT}
        UNION ALL SELECT 'precision', {r("precision")} FROM {BINARY_REPORT} WHERE class = 1
        UNION ALL SELECT 'recall', {r("recall")} FROM {BINARY_REPORT} WHERE class = 1
        UNION ALL SELECT 'f1', {r(F1)} FROM {BINARY_REPORT} WHERE class = 1
        UNION ALL SELECT 'roc_auc', {r("auc")} FROM {BINARY_AUC}
        UNION ALL SELECT 'r2', {r("1 - mse / spread")} FROM {REGRESSION}
        UNION ALL SELECT 'neg_mean_squared_error', {r("-mse", 2)} FROM {REGRESSION}
        UNION ALL SELECT 'neg_mean_absolute_error', {r("-mae", 2)} FROM {REGRESSION}
        UNION ALL SELECT 'neg_root_mean_squared_error', {r("-sqrt(mse)", 2)} FROM {REGRESSION}""",
)
def scorers(t):
    binary = t.view("scored_binary").selectExpr(
        "CAST(label AS double) AS label", "CAST(prediction AS double) AS prediction", "array(1 - score, score) AS scores"
    )
    regression = t.view("scored_regression")
    rows = [(s, models.scorer_value(binary, s, 2)) for s in models.SCORERS["classification"]]
    rows += [(s, models.scorer_value(regression, s, 0)) for s in models.SCORERS["regression"]]
    digits = F.when(F.col("scorer").startswith("neg_"), F.round("value", 2)).otherwise(F.round("value", 6))
    return t.spark.createDataFrame(rows, "scorer string, value double").withColumn("value", digits)


# ---- training ---------------------------------------------------------------------------

EVENT_FEATURES = ["user_id", "value"]


def _scored(trained, key: str):
    target, classes = trained.config["target_column"], trained.classes
    out = models.score(trained.model, trained.test, target, classes)
    keep = [key, F.col(target).cast("string").alias("target"), "prediction"]
    return out.select(*keep, *(["predicted_class"] if classes else []))


# Orders whose classes follow from their price, with a feature that keeps the classes ten apart
GAPPED = """(SELECT o_orderkey, band_no * 10 + o_custkey % 5 AS step, o_custkey % 20 AS customer, o_custkey % 8 AS octet,
    CASE WHEN band_no = 0 THEN 'cheap' ELSE 'dear' END AS level, CASE band_no WHEN 0 THEN 'low' WHEN 1 THEN 'middle' ELSE 'top' END AS band,
    (o_custkey % 8) * 100.0E0 AS steps_of_100, CASE WHEN band_no = 0 THEN 1.5E0 ELSE 1.0E7 END AS code, o_totalprice
    FROM (SELECT *, CASE WHEN o_totalprice > 350000 THEN 2 WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS band_no FROM {}) b)"""
LABELLED = GAPPED.format("orders")
FEATURES = ["step", "customer"]


def _labelled_orders(t):
    return t.spark.sql(f"SELECT * FROM {GAPPED.format('{src}')} g", src=t.table("orders"))


def _all_scored(t, trained):
    """Every order with its prediction, so that the rule behind the classes is the oracle."""
    out = models.score(trained.model, _labelled_orders(t), trained.config["target_column"], trained.classes)
    keep = ["o_orderkey", F.col(trained.config["target_column"]).cast("string").alias("target"), "prediction"]
    return out.select(*keep, *(["predicted_class"] if trained.classes else []))


def _by_rule(target: str, classes: list[str]) -> str:
    number = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(classes))
    return f"SELECT o_orderkey, {target} AS target, CASE {target} {number} END::DOUBLE AS prediction, {target} AS predicted_class FROM {LABELLED} v"


@query("train_logistic_regression", _by_rule("level", ['cheap', 'dear']))
def train_logistic_regression(t):
    return _all_scored(
        t, models.train(_labelled_orders(t), "level", "classification", "logistic_regression", ["o_orderkey"], FEATURES, max_iter=50)
    )


TRAIN_LINE = f"""(SELECT regr_slope(o_totalprice, o_custkey) b, regr_intercept(o_totalprice, o_custkey) a FROM
    (SELECT *, row_number() OVER (ORDER BY {hash_sql("o_orderkey")}, o_orderkey) rn, ceil(count(*) OVER () * 0.2) k FROM orders) WHERE rn > k)"""
TEST_ROWS = f"""(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {hash_sql("o_orderkey")}, o_orderkey) rn, ceil(count(*) OVER () * 0.2) k FROM orders) WHERE rn <= k)"""


@query(
    "train_linear_regression",
    f"SELECT o_orderkey, {r('a + b * o_custkey', 3)} AS prediction FROM {TEST_ROWS}, {TRAIN_LINE}",
)
def train_linear_regression(t):
    trained = models.train(t.table("orders"), "o_totalprice", "regression", "linear_regression", ["o_orderkey"], ["o_custkey"])
    return round_columns(_scored(trained, "o_orderkey").drop("target"), ["prediction"], 3)


@query(
    "evaluate_linear_regression",
    f"""SELECT {r("avg(power(o_totalprice - a - b * o_custkey, 2))", 1)} AS mse, {r("avg(abs(o_totalprice - a - b * o_custkey))", 3)} AS mae,
        {r("1 - avg(power(o_totalprice - a - b * o_custkey, 2)) / var_pop(o_totalprice)")} AS r2 FROM {TEST_ROWS}, {TRAIN_LINE}""",
)
def evaluate_linear_regression(t):
    trained = models.train(t.table("orders"), "o_totalprice", "regression", "linear_regression", ["o_orderkey"], ["o_custkey"])
    found = models.evaluate(trained)
    out = t.spark.createDataFrame([(found["mse"], found["mae"], found["r2"])], "mse double, mae double, r2 double")
    return round_columns(round_columns(round_columns(out, ["mse"], 1), ["mae"], 3), ["r2"])


@query("train_random_forest_classifier", _by_rule("band", ['low', 'middle', 'top']))
def train_random_forest_classifier(t):
    return _all_scored(
        t, models.train(_labelled_orders(t), "band", "classification", "random_forest", ["o_orderkey"], FEATURES, n_estimators=10, max_depth=5)
    )


@query("train_random_forest_regressor", f"SELECT o_orderkey, steps_of_100::VARCHAR AS target, steps_of_100 AS prediction FROM {LABELLED} v")
def train_random_forest_regressor(t):
    """The target is fixed by the feature, so every tree's leaves are exact whatever rows it drew."""
    trained = models.train(
        _labelled_orders(t), "steps_of_100", "regression", "random_forest", ["o_orderkey"], ["octet"], n_estimators=10, max_depth=8
    )
    return round_columns(_all_scored(t, trained), ["prediction"])


@query("train_boosted_classifier", _by_rule("band", ['low', 'middle', 'top']))
def train_boosted_classifier(t):
    return _all_scored(
        t, models.train(_labelled_orders(t), "band", "classification", "xgboost", ["o_orderkey"], FEATURES, n_estimators=3, max_depth=3)
    )


@query(
    "train_boosted_regressor",
    f"""SELECT o_orderkey, {r("avg(CASE WHEN trains THEN o_totalprice END) OVER (PARTITION BY octet)", 3)} AS prediction FROM
        (SELECT v.o_orderkey, octet, v.o_totalprice, v.o_orderkey NOT IN (SELECT o_orderkey FROM {TEST_ROWS}) AS trains FROM {LABELLED} v)""",
)
def train_boosted_regressor(t):
    """One whole-step tree over eight values: the prediction is the mean of a value's training rows."""
    trained = models.train(
        _labelled_orders(t), "o_totalprice", "regression", "xgboost", ["o_orderkey"], ["octet"],
        n_estimators=1, learning_rate=1.0, max_depth=7,
    )
    return round_columns(_all_scored(t, trained).drop("target"), ["prediction"], 3)


# ---- trees on real columns, grown a second time in SQL ----

GROWN_FEATURES = ["hour", "team", "kind"]
GROWN_ROWS = f"""SELECT event_id, value AS y, hour(ts)::INTEGER AS f0, (user_id % 20)::INTEGER AS f1, length(event_type)::INTEGER AS f2, {hash_sql("event_id")} AS h,
    row_number() OVER (ORDER BY {hash_sql("event_id")}, event_id) > ceil(count(*) OVER () * 0.2) AS trains FROM events"""


def _events(t):
    return t.table("events").selectExpr("event_id", "value", "hour(ts) AS hour", "CAST(user_id % 20 AS int) AS team", "length(event_type) AS kind")


def _drawn_sql(name: str, source: str, tree: str) -> str:
    """CTEs that end in ``name``: the rows of ``source`` with a number ``u`` in [0, 1) that depends on row and tree."""
    word = "'18446744073709551616'::UHUGEINT"
    steps = [f"{name}_0 AS (SELECT *, xor(h::UHUGEINT, (({tree} + 1)::UHUGEINT * '11400714819323198485'::UHUGEINT) % {word}) AS x FROM {source})"]
    for i, (shift, factor) in enumerate(((30, 13787848793156543929), (27, 10723151780598845931)), 1):
        steps.append(f"{name}_{i} AS (SELECT * REPLACE ((xor(x, x >> {shift}) * '{factor}'::UHUGEINT) % {word} AS x) FROM {name}_{i - 1})")
    return ", ".join([*steps, f"{name} AS (SELECT * EXCLUDE x, (xor(x, x >> 31) >> 11)::DOUBLE / 9007199254740992 AS u FROM {name}_2)"])


def _grown_sql(name: str, source: str, depth: int, least: int, split: int) -> str:
    """CTEs that end in ``name``: the rows of ``source`` (``tree``, ``w``, ``s``, features) with the ``node`` each comes to rest in."""
    n = len(GROWN_FEATURES)
    text = [f"{name}_0 AS (SELECT *, 0 AS node FROM {source})"]
    for level in range(depth):
        rows = f"{name}_{level}"
        cells = " UNION ALL ".join(f"SELECT tree, node, {f} AS f, f{f} AS v, count(*) AS n, sum(w) AS w, sum(s) AS s FROM {rows} WHERE w > 0 GROUP BY ALL" for f in range(n))
        text.append(f"""{name}_c{level} AS (SELECT *, sum(n) OVER a AS ln, sum(w) OVER a AS lw, sum(s) OVER a AS ls, sum(n) OVER b AS tn, sum(w) OVER b AS tw, sum(s) OVER b AS ts FROM ({cells})
            WINDOW a AS (PARTITION BY tree, node, f ORDER BY v ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY tree, node, f))""")
        text.append(f"""{name}_b{level} AS (SELECT tree, node, f, v FROM (SELECT *, ls * ls / lw + (ts - ls) * (ts - ls) / nullif(tw - lw, 0) - ts * ts / tw AS gain FROM {name}_c{level})
            WHERE tn >= {split} AND ln >= {least} AND tn - ln >= {least} AND gain > 1e-9 * ts * ts / tw + 1e-12
            QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain::FLOAT DESC, f, v) = 1)""")
        side = " ".join(f"WHEN {f} THEN r.f{f}" for f in range(n))
        text.append(f"""{name}_{level + 1} AS (SELECT r.* REPLACE (CASE WHEN b.f IS NULL THEN r.node WHEN CASE b.f {side} END <= b.v THEN r.node * 2 + 1 ELSE r.node * 2 + 2 END AS node)
            FROM {rows} r LEFT JOIN {name}_b{level} b USING (tree, node))""")
    return ", ".join([*text, f"{name} AS (SELECT * FROM {name}_{depth})"])


FOREST = {"n_estimators": 3, "max_depth": 3, "min_samples_split": 60, "min_samples_leaf": 7}
WEIGHT = "CASE " + " ".join(f"WHEN u < {p!r}::DOUBLE THEN {k}" for k, p in enumerate(trees.POISSON.tolist())) + f" ELSE {len(trees.POISSON)} END"


@query(
    "train_forest_events",
    f"""WITH e AS ({GROWN_ROWS}), base AS (SELECT avg(y) AS base FROM e WHERE trains),
        laid AS (SELECT * FROM e, base, (SELECT unnest(range({FOREST["n_estimators"]})) AS tree)), {_drawn_sql("d", "laid", "tree")},
        g AS (SELECT *, w * (y - base) AS s FROM (SELECT *, CASE WHEN trains THEN {WEIGHT} ELSE 0 END::DOUBLE AS w FROM d)),
        {_grown_sql("r", "g", FOREST["max_depth"], FOREST["min_samples_leaf"], FOREST["min_samples_split"])},
        leaf AS (SELECT tree, node, sum(s) / sum(w) AS v FROM r WHERE w > 0 GROUP BY ALL)
        SELECT event_id, {r("any_value(base) + avg(v)", 5)} AS prediction FROM r JOIN leaf USING (tree, node) GROUP BY event_id""",
)
def train_forest_events(t):
    """Three trees on bootstrapped events; every prediction equals that of trees grown in SQL."""
    trained = models.train(_events(t), "value", "regression", "random_forest", ["event_id"], GROWN_FEATURES, **FOREST)
    return round_columns(models.score(trained.model, _events(t)).select("event_id", "prediction"), ["prediction"], 5)


BOOSTED = {"n_estimators": 4, "max_depth": 2, "learning_rate": 0.3, "subsample": 0.8}


def _boosted_sql() -> str:
    text = [f"e AS ({GROWN_ROWS})", "m0 AS (SELECT *, avg(CASE WHEN trains THEN y END) OVER () AS made FROM e)"]
    for i in range(BOOSTED["n_estimators"]):
        text.append(_drawn_sql(f"d{i}", f"(SELECT *, {i} AS tree FROM m{i}) q", "tree"))
        text.append(f"g{i} AS (SELECT *, w * (y - made) AS s FROM (SELECT *, CASE WHEN trains AND u < {BOOSTED['subsample']} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM d{i}))")
        text.append(_grown_sql(f"r{i}", f"g{i}", BOOSTED["max_depth"], 1, 2))
        leaf = f"(SELECT node, sum(s) / sum(w) AS v FROM r{i} WHERE w > 0 GROUP BY node)"
        text.append(f"m{i + 1} AS (SELECT event_id, y, f0, f1, f2, h, trains, made + {BOOSTED['learning_rate']}::DOUBLE * v AS made FROM r{i} JOIN {leaf} USING (node))")
    return f"WITH {', '.join(text)} SELECT event_id, {r('made', 5)} AS prediction FROM m{BOOSTED['n_estimators']}"


@query("train_boosted_events", _boosted_sql())
def train_boosted_events(t):
    """Four steps of boosting on drawn events; every prediction equals that of trees grown in SQL."""
    trained = models.train(_events(t), "value", "regression", "xgboost", ["event_id"], GROWN_FEATURES, **BOOSTED)
    return round_columns(models.score(trained.model, _events(t)).select("event_id", "prediction"), ["prediction"], 5)


@query("train_linear_svm", _by_rule("level", ['cheap', 'dear']))
def train_linear_svm(t):
    return _all_scored(
        t, models.train(_labelled_orders(t), "level", "classification", "svm", ["o_orderkey"], FEATURES, max_iter=30)
    )


@query(
    "evaluate_classifier",
    f"""SELECT metric, 1.0::DOUBLE AS value FROM (SELECT unnest(['accuracy', 'precision', 'recall', 'f1_score', 'roc_auc']) AS metric)
        WHERE (SELECT count(*) FROM {LABELLED} v) > 0""",
)
def evaluate_classifier(t):
    trained = models.train(_labelled_orders(t), "band", "classification", "random_forest", ["o_orderkey"], FEATURES, n_estimators=10, max_depth=5)
    out = t.spark.createDataFrame(list(models.evaluate(trained).items()), "metric string, value double")
    return round_columns(out, ["value"])


@query("train_float_classes", _by_rule("code", ["1.5", "1.0E7"]).replace("code AS", "CASE WHEN code < 2 THEN '1.5' ELSE '1.0E7' END AS").replace("CASE code", "CASE CASE WHEN code < 2 THEN '1.5' ELSE '1.0E7' END"))
def train_float_classes(t):
    return _all_scored(t, models.train(_labelled_orders(t), "code", "classification", "svm", ["o_orderkey"], FEATURES, max_iter=30))


@query(
    "parameter_grid",
    f"""SELECT model, parameter, value FROM (VALUES ('logistic_regression', 'C', '0.1'), ('logistic_regression', 'C', '1.0'), ('logistic_regression', 'C', '10.0'),
        ('logistic_regression', 'max_iter', '100'), ('logistic_regression', 'max_iter', '200')) AS g(model, parameter, value)
        UNION ALL SELECT 'random_forest', 'max_depth', (n + d)::VARCHAR FROM (SELECT count(DISTINCT o_orderstatus) n FROM orders), (SELECT unnest([-2, 0, 2]) d)""",
)
def parameter_grid(t):
    """The grids the models are tried with; the forest's depth follows the number of order states."""
    depth = t.table("orders").select("o_orderstatus").distinct().count()
    rows = [("logistic_regression", k, str(v)) for k, vs in models.parameter_grid("logistic_regression").items() for v in vs]
    rows += [("random_forest", "max_depth", str(v)) for v in models.parameter_grid("random_forest", max_depth=depth)["max_depth"]]
    return t.spark.createDataFrame(rows, "model string, parameter string, value string")


@query(
    "validate_target",
    """SELECT 'o_totalprice' AS target, count(*) AS n, NULL::VARCHAR AS problem FROM orders
       UNION ALL SELECT 'price', NULL, 'holds only missing values' FROM (SELECT 1 FROM orders LIMIT 1)
       UNION ALL SELECT 'nothing', NULL, 'does not exist' FROM (SELECT 1 FROM orders LIMIT 1)""",
)
def validate_target(t):
    orders = t.table("orders").withColumn("price", F.when(F.col("o_totalprice") < 0, F.col("o_totalprice")))
    rows = []
    for target in ("o_totalprice", "price", "nothing"):
        try:
            rows.append((target, split.validate_target(orders, target, 0.2), None))
        except ValueError as error:
            rows.append((target, None, next(p for p in ("holds only missing values", "does not exist") if p in str(error))))
    return t.spark.createDataFrame(rows, "target string, n bigint, problem string")


@query(
    "grid_search",
    f"""SELECT params, 1.0::DOUBLE AS mean_score, 0.0::DOUBLE AS std_score FROM (SELECT unnest(['C=0.1', 'C=1.0']) AS params)
        WHERE (SELECT count(*) FROM {LABELLED} v) > 0""",
)
def grid_search(t):
    """The classes lie apart, so every setting scores one in every fold."""
    found = models.grid_search(
        _labelled_orders(t), "level", "classification", "svm", {"C": [0.1, 1.0], "max_iter": [30]}, ["o_orderkey"], FEATURES, folds=3
    )
    scores = found.config["grid_search_results"]
    rows = [(f"C={p['C']}", m, s) for p, m, s in zip(scores["params"], scores["mean_test_score"], scores["std_test_score"])]
    return t.spark.createDataFrame(rows, "params string, mean_score double, std_score double")


@query(
    "cross_validate_linear",
    f"""WITH p AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY {hash_sql("o_orderkey")}, o_orderkey) AS rn FROM {{scored_regression}}),
        v AS (SELECT CAST((rn > ceil(n / 4)) AS INTEGER) + CAST((rn > ceil(n * 2 / 4)) AS INTEGER) + CAST((rn > ceil(n * 3 / 4)) AS INTEGER) AS fold,
              CAST(prediction AS DOUBLE) AS x, CAST(label AS DOUBLE) AS y FROM p),
        m AS (SELECT f.fold, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM (SELECT DISTINCT fold FROM v) f JOIN v ON v.fold <> f.fold GROUP BY f.fold)
        SELECT m.fold, count(*) AS n, {r("slope", 8)} AS slope, {r("intercept", 4)} AS intercept,
               {r("sqrt(avg((y - intercept - slope * x) ** 2))", 4)} AS rmse, {r("1 - avg((y - intercept - slope * x) ** 2) / var_pop(y)")} AS r2
        FROM m JOIN v ON v.fold = m.fold GROUP BY m.fold, slope, intercept""",
)
def cross_validate_linear(t):
    """The price by its prediction in four folds, each held out once."""
    found = crossval.cross_validate_linear(t.view("scored_regression"), "label", ["prediction"], ["o_orderkey"], 4)
    slope = F.round(F.col("coefficients")[0], 8).alias("slope")
    rmse = F.round(F.sqrt("mse"), 4).alias("rmse")
    return found.select("fold", F.col("rows").alias("n"), slope, F.round("intercept", 4).alias("intercept"), rmse, F.round("r2", 6).alias("r2"))


@query("batch_scoring", f"SELECT o_orderkey, level AS predicted_class, level = 'dear' AS likely_dear FROM {LABELLED} v")
def batch_scoring(t):
    trained = models.train(
        _labelled_orders(t), "level", "classification", "logistic_regression", ["o_orderkey"], FEATURES, max_iter=50
    )
    likely = (F.col("scores")[1] > 0.5).alias("likely_dear")
    return models.score(trained.model, _labelled_orders(t)).select("o_orderkey", "predicted_class", likely)


# customers in three places far apart; clusters are named by their smallest key
PLACED = "c_custkey, (c_nationkey % 3) * 1000 + c_acctbal / 10000 AS x, (c_nationkey % 3) * -500 + c_custkey % 7 AS y"
PLACES = "SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey % 3) AS cluster FROM customer"


def _named_clusters(clustered):
    first = Window.partitionBy("cluster")
    return clustered.select("c_custkey", F.min("c_custkey").over(first).alias("cluster"))


@query("kmeans", PLACES)
def kmeans(t):
    customers = t.table("customer").selectExpr(*PLACED.split(", "))
    return _named_clusters(models.cluster(customers, ["x", "y"], "kmeans", n_clusters=3)[0])


@query("gaussian_mixture", "SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey % 2) AS cluster FROM customer")
def gaussian_mixture(t):
    customers = t.table("customer").selectExpr("c_custkey", "(c_nationkey % 2) * 50 + c_acctbal / 10000 AS x")
    return _named_clusters(models.cluster(customers, ["x"], "gmm", n_clusters=2, max_iter=100)[0])

# two features that vary together within three places
SPREAD = """SELECT c_custkey, c_nationkey % 3 AS place, (c_nationkey % 3) * 50 + c_acctbal / 10000.0E0 AS x,
    (c_nationkey % 3) * (c_nationkey % 3) * -20 + c_custkey % 97 / 100.0E0 + c_acctbal / 20000.0E0 AS y FROM customer"""


@query(
    "gaussian_mixture_starts",
    f"""WITH c AS (SELECT place, count(*) AS n, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS weight, avg(x) AS mx, avg(y) AS my,
            var_pop(x) + 1e-6 AS vx, var_pop(y) + 1e-6 AS vy, covar_pop(x, y) AS vxy FROM ({SPREAD}) GROUP BY place)
        SELECT {r("weight")} AS weight, {r("mx")} AS mean_x, {r("my")} AS mean_y, {r("vx")} AS var_x, {r("vy")} AS var_y, {r("vxy")} AS cov,
            {r("""sum(n * (ln(weight) - ln(2 * pi()) - ln(vx * vy - vxy * vxy) / 2
                - (vy * (vx - 1e-6) + vx * (vy - 1e-6) - 2 * vxy * vxy) / (vx * vy - vxy * vxy) / 2)) OVER ()""", 2)} AS log_likelihood
        FROM c""",
)
def gaussian_mixture_starts(t):
    """Places far apart, so the best start finds the shares, means and covariances of the rows of each."""
    customers = t.spark.sql(SPREAD.replace("FROM customer", "FROM {customer}"), customer=t.table("customer"))
    m = mixture.fit_mixture(customers, [F.col("x"), F.col("y")], 3, n_init=3, tol=1e-9)
    rows = [
        (float(w), float(a), float(b), float(c[0, 0]), float(c[1, 1]), float(c[0, 1]))
        for w, (a, b), c in zip(m.weights, m.means, m.covariances)
    ]
    names = ["weight", "mean_x", "mean_y", "var_x", "var_y", "cov"]
    out = round_columns(t.spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names)
    return out.withColumn("log_likelihood", F.round(F.lit(m.log_likelihood), 2))
