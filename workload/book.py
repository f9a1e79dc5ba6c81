"""Registration of queries and the views both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Views with the same text in Spark and DuckDB. The given tables have no nulls, so gaps,
# outliers, odd classes and scores are computed from their columns, row by row.
VIEWS = {
    "orders_missing": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority
        FROM orders""",
    "events_outliers": """
        SELECT event_id, user_id, event_type,
               CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 97 = 0 THEN value * 50 ELSE value END AS value
        FROM events""",
    "lineitem_corr": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
               l_extendedprice * (1 - l_discount) AS net, l_tax, l_discount * 0 + 5 AS fixed
        FROM lineitem""",
    "orders_bool": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice > 100000 END AS big FROM orders""",
    "orders_date": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS placed FROM orders""",
    "orders_classes": """
        SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus,
               CASE WHEN o_orderkey % 10 = 0 THEN 'rare' WHEN o_orderkey % 10 < 4 THEN 'mid' ELSE 'common' END AS cls
        FROM orders""",
    "scored_binary": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS label,
               (o_orderkey * 37 % 101) / 100.0E0 AS score,
               CASE WHEN o_orderkey * 37 % 101 >= 50 THEN 1 ELSE 0 END AS prediction
        FROM orders""",
    "scored_multi": """
        SELECT o_orderkey, o_orderkey * 7 % 3 AS label,
               CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey + 1) % 3 ELSE o_orderkey * 7 % 3 END AS prediction,
               (o_orderkey * 31 % 97) / 100.0E0 AS s0, (o_orderkey * 17 % 89) / 100.0E0 AS s1,
               (o_orderkey * 13 % 83) / 100.0E0 AS s2
        FROM orders""",
    "scored_regression": """
        SELECT o_orderkey, o_totalprice AS label, o_totalprice * 0.9E0 + o_orderkey % 100 AS prediction FROM orders""",
    "customers_clustered": """
        SELECT c_custkey, c_acctbal / 1000 AS x, c_nationkey * 1.0E0 AS y,
               CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 4000 THEN 1 ELSE 2 END AS cluster
        FROM customer""",
    "orders_shifted": """
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
               o_totalprice * 1.1E0 + o_custkey % 50 AS o_totalprice,
               CASE WHEN o_orderkey % 6 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
    "events_users": "SELECT event_id, CAST(user_id AS string) AS user_name, value FROM events",
    # fifty datasets, each a binary tree of versions over the orders
    "versions": """
        SELECT concat('set_', CAST(o_orderkey % 50 AS string)) AS dataset,
               CASE WHEN o_orderkey < 50 THEN 'raw' ELSE concat('V', CAST(o_orderkey AS string)) END AS version,
               CASE WHEN o_orderkey < 50 THEN NULL
                    WHEN o_orderkey < 150 THEN 'raw'
                    ELSE concat('V', CAST(CAST(floor((floor(o_orderkey / 50) - 1) / 2) AS bigint) * 50 + o_orderkey % 50 AS string))
               END AS parent,
               CASE WHEN o_orderkey < 50 THEN 'import' ELSE lower(o_orderpriority) END AS operation,
               concat('key=', CAST(o_orderkey AS string)) AS config,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS created_at
        FROM orders""",
    "experiments_flat": """
        SELECT concat('exp_', CAST(o_orderkey AS string)) AS experiment_id, o_orderkey AS n,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('run ', o_orderstatus) END AS experiment_name,
               o_orderdate AS created, o_orderpriority AS dataset_name, o_orderstatus AS dataset_version,
               CASE WHEN o_orderkey % 3 = 0 THEN 'Random_Forest' WHEN o_orderkey % 3 = 1 THEN 'XGBoost' ELSE 'Linear_Regression' END AS model_type,
               CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(50 + o_custkey % 3 * 50 AS string) END AS n_estimators,
               CASE WHEN o_orderkey % 3 = 1 THEN CAST(2 + o_custkey % 4 AS string) END AS max_depth,
               CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE round(o_totalprice / 600000, 3) END AS accuracy,
               CASE WHEN o_orderkey % 3 = 2 THEN round(o_totalprice / 1000, 2) END AS mse,
               CASE WHEN o_orderkey % 3 = 2 THEN -round(o_totalprice / 1000, 2) END AS neg_mean_squared_error
        FROM orders""",
}


class Tables:
    """The given tables and the shared views, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        source = text.rsplit("FROM", 1)[1].strip()
        return self.spark.sql(text.rsplit("FROM", 1)[0] + " FROM {src}", src=self.table(source))


def view_sql(name: str) -> str:
    """A view as a DuckDB subquery text."""
    return "(" + VIEWS[name].replace("AS string)", "AS varchar)").strip() + ")"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``{view}`` names in ``sql`` become the view's text."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            text = sql
            for view in VIEWS:
                text = text.replace("{" + view + "}", view_sql(view))
            ORACLES[name] = text
        return fn

    return register


def hash_sql(*keys: str, seed: int = 42) -> str:
    """DuckDB text of the seeded row order."""
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 13) AS BIGINT)"


def rounded(column: str | Column, digits: int = 6) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, digits)


def round_columns(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def r(text: str, digits: int = 6) -> str:
    """DuckDB rounding without negative zero."""
    return f"(round({text}, {digits}) + 0.0)"
