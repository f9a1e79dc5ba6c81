"""Files, versions, stored work and experiments."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.plans import workbench
from millrace.session import shared_path
from millrace.sources import experiments, lineage
from millrace.sources.catalog import Catalog
from millrace.sources.experiments import ExperimentLog
from millrace.sources.files import export, read_csv
from workload.book import query, r, round_columns
from workload.modelling import TEST_ROWS, TRAIN_LINE
from workload.prepare import STAGED, STEPS, _flags


def _csv(t, name: str) -> str:
    path = shared_path(t.spark, name) + ".csv"
    export(t.table(name), path, "csv")
    return path


@query("import_csv", "SELECT * FROM orders")
def import_csv(t):
    """Orders written as CSV and imported with inferred types."""
    back = read_csv(t.spark, _csv(t, "orders"))
    types = dict(t.table("orders").dtypes)
    return back.select(*[col(c).cast(types[c]).alias(c) for c in back.columns])


@query("export_json", "SELECT * FROM events")
def export_json(t):
    events = t.table("events")
    path = shared_path(t.spark, "events")
    export(events, path, "json")
    return t.spark.read.schema(events.schema).json(path)


@query("export_parquet", "SELECT * FROM part")
def export_parquet(t):
    path = shared_path(t.spark, "part")
    export(t.table("part"), path, "parquet")
    return t.spark.read.parquet(path)


@query(
    "register_dataset",
    """SELECT 'customers' AS dataset, 'raw' AS version, NULL::VARCHAR AS parent, 'import' AS operation, count(*) AS row_count FROM customer
       UNION ALL SELECT 'customers', 'named', 'raw', 'drop_columns', count(*) FROM customer""",
)
def register_dataset(t):
    catalog = Catalog(t.spark, shared_path(t.spark, "catalog"))
    catalog.create_dataset("customers", _csv(t, "customer"))
    catalog.create_version("customers", "named", catalog.load_version("customers", "raw").drop("c_acctbal"), "raw", "drop_columns")
    rows = {v: catalog.load_version("customers", v).count() for v in ("raw", "named")}
    count = F.when(F.col("version") == "raw", rows["raw"]).otherwise(rows["named"]).cast("long")
    return catalog.versions("customers").select("dataset", "version", "parent", "operation", count.alias("row_count"))


@query("load_version", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0")
def load_version(t):
    catalog = Catalog(t.spark, shared_path(t.spark, "catalog"))
    catalog.create_version("customers", "raw", t.table("customer"), None, "import")
    kept = catalog.load_version("customers", "raw").where("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_mktsegment")
    catalog.create_version("customers", "positive", kept, "raw", "filter")
    return catalog.load_version("customers", "positive")


@query(
    "save_sequence",
    STAGED + f" SELECT o_orderkey, {r('(price - m) / s')} AS price, priority, {_flags('o_orderstatus', ['F', 'O', 'P'])} FROM kept, st",
)
def save_sequence(t):
    catalog = Catalog(t.spark, shared_path(t.spark, "catalog"))
    catalog.create_version("orders", "raw", t.view("orders_missing"), None, "import")
    return round_columns(workbench.save_sequence(catalog, "orders", "raw", "prepared", STEPS), ["price"])


@query("save_clusters", "SELECT c_custkey, c_acctbal, side, min(c_custkey) OVER (PARTITION BY side) AS cluster FROM (SELECT *, CASE WHEN c_nationkey < 12 THEN 0 ELSE 1000 END AS side FROM customer)")
def save_clusters(t):
    """Customers in two places far apart; the stored version names each cluster, here by its smallest key."""
    catalog = Catalog(t.spark, shared_path(t.spark, "catalog"))
    customers = t.table("customer").selectExpr("c_custkey", "c_acctbal", "CASE WHEN c_nationkey < 12 THEN 0 ELSE 1000 END AS side")
    catalog.create_version("customers", "raw", customers, None, "import")
    stored = workbench.save_clusters(catalog, "customers", "raw", "grouped", ["side"], n_clusters=2)
    return stored.withColumn("cluster", F.min("c_custkey").over(Window.partitionBy("cluster")))


@query("save_synthesis", "SELECT count(*) AS n FROM customer")
def save_synthesis(t):
    catalog = Catalog(t.spark, shared_path(t.spark, "catalog"))
    catalog.create_version("customers", "raw", t.table("customer"), None, "import")
    rows = t.table("customer").count()
    made = workbench.save_synthesis(catalog, "customers", "raw", "made", rows, evaluate=False)
    return made.agg(F.count("*").alias("n"))


@query("list_datasets", "SELECT DISTINCT dataset FROM {versions} v")
def list_datasets(t):
    return lineage.datasets(t.view("versions"))


@query("list_versions", "SELECT dataset, version, created_at FROM {versions} v")
def list_versions(t):
    return lineage.listing(t.view("versions"))


@query("version_metadata", "SELECT dataset, version, parent, operation, config FROM {versions} v WHERE (dataset, version) IN (('set_1', 'raw'), ('set_1', 'V51'), ('set_7', 'V107'))")
def version_metadata(t):
    """What is known of three versions, each asked for by its key."""
    versions = t.view("versions")
    rows = [lineage.metadata(versions, d, v) for d, v in (("set_1", "raw"), ("set_1", "V51"), ("set_7", "V107"))]
    names = ["dataset", "version", "parent", "operation", "config"]
    return t.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


@query("drop_version", "SELECT v AS version, n FROM (SELECT unnest(['raw', 'small']) AS v), (SELECT count(*) AS n FROM nation)")
def drop_version(t):
    """A version without children is dropped; its parent and its sibling stay."""
    catalog = Catalog(t.spark, shared_path(t.spark, "catalog"))
    catalog.create_version("nations", "raw", t.table("nation"), None, "import")
    for name in ("small", "wrong"):
        catalog.create_version("nations", name, catalog.load_version("nations", "raw").select("n_name"), "raw", "select")
    catalog.drop_version("nations", "wrong")
    kept = [(r["version"], catalog.load_version("nations", r["version"]).count()) for r in catalog.versions("nations").collect()]
    return t.spark.createDataFrame(kept, "version string, n bigint")


@query("export_version", "SELECT * FROM customer")
def export_version(t):
    catalog = Catalog(t.spark, shared_path(t.spark, "catalog"))
    catalog.create_version("customers", "raw", t.table("customer"), None, "import")
    path = shared_path(t.spark, "exported")
    catalog.export_version("customers", "raw", path, "parquet")
    return t.spark.read.parquet(path)


TREE = """WITH RECURSIVE v AS (SELECT * FROM {versions}),
    up AS (SELECT dataset, version, version AS member, parent, 0 AS distance FROM v
           UNION ALL SELECT up.dataset, up.version, v.version, v.parent, distance + 1 FROM up JOIN v ON v.dataset = up.dataset AND v.version = up.parent)"""


@query(
    "lineage",
    TREE + """ SELECT dataset, version, max(distance) OVER (PARTITION BY dataset, version) - distance AS step, member FROM up""",
)
def all_lineages(t):
    return lineage.lineage(t.view("versions")).withColumn("step", F.col("step").cast("int"))


@query("version_graph", "SELECT dataset, version, parent FROM {versions} v")
def version_graph(t):
    return lineage.graph(t.view("versions"))


@query(
    "removable_versions",
    """SELECT dataset, version FROM {versions} v WHERE version <> 'raw' AND NOT EXISTS
       (SELECT 1 FROM {versions} c WHERE c.dataset = v.dataset AND c.parent = v.version)""",
)
def removable_versions(t):
    return lineage.removable(t.view("versions")).select("dataset", "version")


@query("search_versions", "SELECT * FROM {versions} v WHERE lower(version) LIKE '%v1%' AND operation = '5-low'")
def search_versions(t):
    return lineage.search(t.view("versions"), "v1", "5-low")


@query("versions_by_time", "SELECT * FROM {versions} v ORDER BY created_at DESC NULLS LAST, dataset, version")
def versions_by_time(t):
    return lineage.by_time(t.view("versions"))


@query(
    "version_forest",
    """WITH RECURSIVE f AS (SELECT * FROM {versions} WHERE operation <> '1-urgent'),
    v AS (SELECT f.dataset, f.version, p.version AS parent FROM f LEFT JOIN f p ON p.dataset = f.dataset AND p.version = f.parent),
    d AS (SELECT dataset, version, parent, 0 AS depth FROM v WHERE parent IS NULL
          UNION ALL SELECT v.dataset, v.version, v.parent, d.depth + 1 FROM v JOIN d ON v.dataset = d.dataset AND v.parent = d.version)
    SELECT dataset, version, parent AS shown_parent, depth::BIGINT AS depth FROM d""",
)
def version_forest(t):
    return lineage.forest(t.view("versions").where("operation <> '1-urgent'"))


@query("version_operations", "SELECT DISTINCT operation FROM {versions} v")
def version_operations(t):
    return lineage.operations(t.view("versions"))


# ---- experiments ------------------------------------------------------------------------


def _experiments(t):
    """The orders read as experiments, in the log's own schema."""

    def present(*pairs):
        keys = F.array(*[F.lit(k) for k, _ in pairs])
        every = F.map_from_arrays(keys, F.array(*[F.col(v) for _, v in pairs]))
        return F.map_filter(every, lambda _, v: v.isNotNull())

    return t.view("experiments_flat").select(
        "experiment_id",
        "n",
        "experiment_name",
        F.col("created").alias("timestamp"),
        F.struct(F.col("dataset_name").alias("name"), F.col("dataset_version").alias("version")).alias("dataset"),
        F.struct(
            F.col("model_type").alias("type"), present(("n_estimators", "n_estimators"), ("max_depth", "max_depth")).alias("hyperparameters")
        ).alias("model"),
        present(("accuracy", "accuracy"), ("mse", "mse"), ("neg_mean_squared_error", "neg_mean_squared_error")).alias("metrics"),
        F.when(F.col("accuracy").isNotNull(), "accuracy").otherwise("mse").alias("main_metric"),
        F.lit("target").alias("target_column"),
        F.array(F.lit("a"), F.lit("b")).alias("feature_columns"),
    )


@query(
    "list_experiments",
    """SELECT experiment_id, experiment_name, model_type, dataset_version FROM {experiments_flat} v
       WHERE dataset_name = '2-HIGH' AND model_type = 'XGBoost' AND accuracy >= 0.3
       AND created BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1998-01-01'""",
)
def list_experiments(t):
    found = experiments.list_experiments(
        _experiments(t), "2-HIGH", "XGBoost", {"accuracy": 0.3}, "1993-01-01", "1998-01-01"
    )
    return found.select("experiment_id", "experiment_name", "model_type", F.col("dataset.version").alias("dataset_version"))


LOADED = """experiment_id string, experiment_name string, dataset struct<name: string, version: string>,
    model struct<type: string, hyperparameters: map<string, string>>, metrics map<string, double>"""


@query(
    "load_experiment",
    "SELECT experiment_id, experiment_name, dataset_name, model_type, n_estimators, accuracy, mse FROM {experiments_flat} v WHERE n < 3",
)
def load_experiment(t):
    """One of the experiments of a log, found by its id."""
    root = shared_path(t.spark, "experiments")
    columns = [F.col(n) for n in _experiments(t).columns if n != "n"]
    _experiments(t).select(columns).write.parquet(f"{root}/_experiments")
    log = ExperimentLog(t.spark, root)
    found = [log.load(f"exp_{i}") for i in (0, 1, 2)]
    back = t.spark.createDataFrame([{k: r[k] for k in ("experiment_id", "experiment_name", "dataset", "model", "metrics")} for r in found], LOADED)
    return back.select(
        "experiment_id", "experiment_name", F.col("dataset.name").alias("dataset_name"), F.col("model.type").alias("model_type"),
        F.try_element_at("model.hyperparameters", F.lit("n_estimators")).alias("n_estimators"),
        F.try_element_at("metrics", F.lit("accuracy")).alias("accuracy"), F.try_element_at("metrics", F.lit("mse")).alias("mse"),
    )


@query(
    "experiment_filters",
    """SELECT 'dataset' AS kind, dataset_name AS value FROM {experiments_flat} v GROUP BY dataset_name
       UNION ALL SELECT 'model', model_type FROM {experiments_flat} v GROUP BY model_type""",
)
def experiment_filters(t):
    return experiments.filter_values(_experiments(t))


@query(
    "leaderboard",
    """SELECT experiment_id, coalesce(experiment_name, '') AS experiment_name, dataset_name, dataset_version, model_type, 'target' AS target_column,
       CASE WHEN accuracy IS NULL THEN 'mse' ELSE 'accuracy' END AS main_metric, coalesce(accuracy, mse) AS main_value,
       strftime(created, '%Y-%m-%d') AS day FROM {experiments_flat} v""",
)
def leaderboard(t):
    return experiments.leaderboard(_experiments(t))


def _compare_sql() -> str:
    sides = "(SELECT a.experiment_id first_id, b.experiment_id second_id, {0} v1, {1} v2 FROM {{experiments_flat}} a JOIN {{experiments_flat}} b ON b.n = a.n + 1)"
    parts = []
    fields = {
        "experiment_id": "{x}.experiment_id", "experiment_name": "{x}.experiment_name",
        "timestamp": "strftime({x}.created, '%Y-%m-%dT%H:%M:%S')", "dataset": "{x}.dataset_name",
        "dataset_version": "{x}.dataset_version", "target_column": "'target'", "feature_columns": "'a, b'", "model": "{x}.model_type",
    }
    for name, text in fields.items():
        rows = sides.format(text.format(x="a"), text.format(x="b"))
        parts.append(
            f"""SELECT first_id, second_id, 'field' AS section, '{name}' AS name, coalesce(v1, '') AS value1, coalesce(v2, '') AS value2,
            coalesce(v1, '') <> coalesce(v2, '') AND coalesce(v1, '') <> '' AND coalesce(v2, '') <> '' AS differs, NULL::INTEGER AS better FROM {rows}"""
        )
    for name in ("n_estimators", "max_depth"):
        rows = sides.format(f"a.{name}", f"b.{name}")
        parts.append(
            f"""SELECT first_id, second_id, 'hyperparameter', '{name}', coalesce(v1, 'N/A'), coalesce(v2, 'N/A'), v1 IS DISTINCT FROM v2, NULL
            FROM {rows} WHERE v1 IS NOT NULL OR v2 IS NOT NULL"""
        )
    for name, sign in (("accuracy", ">"), ("mse", "<"), ("neg_mean_squared_error", ">")):
        rows = sides.format(f"a.{name}", f"b.{name}")
        shown = "coalesce(printf('%.4f', {0}), 'N/A')"
        parts.append(
            f"""SELECT first_id, second_id, 'metric', '{name}', {shown.format("v1")}, {shown.format("v2")},
            {shown.format("v1")} <> {shown.format("v2")}, CASE WHEN v1 {sign} v2 THEN 1 WHEN v2 {sign} v1 THEN 2 END
            FROM {rows} WHERE v1 IS NOT NULL OR v2 IS NOT NULL"""
        )
    return " UNION ALL ".join(parts)


@query("compare_experiments", _compare_sql())
def compare_experiments(t):
    """Every experiment next to its successor."""
    runs = _experiments(t)
    following = runs.select(F.col("experiment_id").alias("second_id"), (F.col("n") - 1).alias("n"))
    pairs = runs.select(F.col("experiment_id").alias("first_id"), "n").join(following, "n").drop("n")
    return experiments.compare(runs, pairs)


@query(
    "better_metric",
    """SELECT a.experiment_id AS first_id, CASE WHEN a.mse < b.mse THEN 1 WHEN a.mse > b.mse THEN 2 END AS by_mse,
       CASE WHEN a.mse < b.mse THEN 1 WHEN a.mse > b.mse THEN 2 END AS by_neg_mse, CASE WHEN a.accuracy > b.accuracy THEN 1 WHEN a.accuracy < b.accuracy THEN 2 END AS by_accuracy
       FROM {experiments_flat} a JOIN {experiments_flat} b ON b.n = a.n + 3""",
)
def better_metric(t):
    runs = t.view("experiments_flat")
    values = ["accuracy", "mse", "neg_mean_squared_error"]
    later = runs.select((F.col("n") - 3).alias("n"), *[F.col(v).alias(f"{v}_2") for v in values])
    named = {"accuracy": "by_accuracy", "mse": "by_mse", "neg_mean_squared_error": "by_neg_mse"}
    return runs.join(later, "n").select(
        F.col("experiment_id").alias("first_id"),
        *[experiments.better_side(F.lit(v), F.col(v), F.col(f"{v}_2")).alias(named[v]) for v in values],
    )


@query(
    "experiment_record",
    f"""SELECT 'orders' AS dataset_name, 'raw' AS dataset_version, 'linear_regression' AS model_type, 'o_totalprice' AS target_column, 'mse' AS main_metric,
        {r("1 - avg(power(o_totalprice - a - b * o_custkey, 2)) / var_pop(o_totalprice)")} AS r2 FROM {TEST_ROWS}, {TRAIN_LINE}""",
)
def experiment_record(t):
    """A whole run: stored version, training, evaluation, log entry."""
    catalog = Catalog(t.spark, shared_path(t.spark, "catalog"))
    log = ExperimentLog(t.spark, shared_path(t.spark, "experiments"))
    catalog.create_version("orders", "raw", t.table("orders"), None, "import")
    workbench.run_experiment(
        catalog, log, "orders", "raw", "o_totalprice", "regression", "linear_regression", ["o_orderkey"], ["o_custkey"]
    )
    return round_columns(
        log.table().select(
            F.col("dataset.name").alias("dataset_name"), F.col("dataset.version").alias("dataset_version"),
            F.col("model.type").alias("model_type"), "target_column", "main_metric", F.col("metrics")["r2"].alias("r2"),
        ),
        ["r2"],
    )


@query(
    "load_model",
    f"SELECT o_orderkey, {r('a + b * o_custkey', 3)} AS prediction FROM orders, {TRAIN_LINE}",
)
def load_model(t):
    """A saved model, loaded from the log and applied to all orders."""
    from millrace.operators import models

    catalog = Catalog(t.spark, shared_path(t.spark, "catalog"))
    log = ExperimentLog(t.spark, shared_path(t.spark, "experiments"))
    catalog.create_version("orders", "raw", t.table("orders"), None, "import")
    found = workbench.run_experiment(
        catalog, log, "orders", "raw", "o_totalprice", "regression", "linear_regression", ["o_orderkey"], ["o_custkey"]
    )
    scored = models.score(log.load_model(found), t.table("orders"))
    return round_columns(scored.select("o_orderkey", "prediction"), ["prediction"], 3)
