"""Summaries and plot data."""

from pyspark.sql import functions as F

from millrace.operators import plotdata, profile
from millrace.sources.catalog import preview
from workload.book import hash_sql, query, r, round_columns

ITEM_NUMBERS = {"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double"}


def _numeric_sql(columns: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{k}' AS dtype, count({c}) AS count, count(*) - count({c}) AS missing,
        {r(f"(count(*) - count({c})) / count(*)::DOUBLE")} AS missing_pct, {r(f"avg({c})", 4)} AS mean, {r(f"stddev_samp({c})", 4)} AS std,
        min({c})::DOUBLE AS min, {r(f"quantile_cont({c}::DOUBLE, 0.25)", 4)} AS q25, {r(f"quantile_cont({c}::DOUBLE, 0.5)", 4)} AS q50,
        {r(f"quantile_cont({c}::DOUBLE, 0.75)", 4)} AS q75, max({c})::DOUBLE AS max, count(DISTINCT {c}) AS "unique" FROM {source} v"""
        for c, k in columns.items()
    )


def _round_numeric(df):
    return round_columns(round_columns(df, ["mean", "std", "q25", "q50", "q75"], 4), ["missing_pct"])


@query("numeric_summary", _numeric_sql(ITEM_NUMBERS, "lineitem"))
def numeric_summary(t):
    return _round_numeric(profile.numeric_summary(t.table("lineitem"), list(ITEM_NUMBERS)))


@query("numeric_summary_gaps", _numeric_sql({"value": "double"}, "{events_outliers}"))
def numeric_summary_gaps(t):
    return _round_numeric(profile.numeric_summary(t.view("events_outliers"), ["value"]))


TOP = """(SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) FROM (SELECT {0} v, count(*) n FROM {1} WHERE {0} IS NOT NULL
    GROUP BY {0} ORDER BY n DESC, v LIMIT 10))"""


def _categorical_sql(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'string' AS dtype, count({c}) AS count, count(*) - count({c}) AS missing,
        {r(f"(count(*) - count({c})) / count(*)::DOUBLE")} AS missing_pct, count(DISTINCT {c}) AS "unique",
        {TOP.format(c, source)} AS top_values FROM {source} v"""
        for c in columns
    )


@query("categorical_summary", _categorical_sql(["o_orderstatus", "priority"], "{orders_missing}"))
def categorical_summary(t):
    found = profile.categorical_summary(t.view("orders_missing"))
    top = F.array_join(F.transform("top_values", lambda e: F.concat(e.value, F.lit("="), e.n.cast("string"))), ";")
    return round_columns(found.withColumn("top_values", top), ["missing_pct"])


@query("top_values", """SELECT 'p_name' AS "column", row_number() OVER (ORDER BY n DESC, v) AS rank, v AS value, n FROM
    (SELECT p_name v, count(*) n FROM part GROUP BY p_name ORDER BY n DESC, v LIMIT 10)
    UNION ALL SELECT 'p_size', row_number() OVER (ORDER BY n DESC, v), v::VARCHAR, n FROM
    (SELECT p_size v, count(*) n FROM part GROUP BY p_size ORDER BY n DESC, v LIMIT 10)""")
def top_values(t):
    from millrace.functions.counts import top_values as top

    return top(t.table("part"), ["p_name", "p_size"], 10)


@query(
    "boolean_summary",
    f"""SELECT 'big' AS "column", 'boolean' AS dtype, count(big) AS count, count(*) - count(big) AS missing,
        {r("(count(*) - count(big)) / count(*)::DOUBLE")} AS missing_pct, count(DISTINCT big) AS "unique",
        count_if(big) AS true_n, count_if(NOT big) AS false_n FROM {{orders_bool}} v""",
)
def boolean_summary(t):
    found = profile.boolean_summary(t.view("orders_bool"))
    spread = [F.coalesce(F.try_element_at("distribution", F.lit(k)), F.lit(0)).alias(f"{k}_n") for k in ("true", "false")]
    return round_columns(found.select("*", *spread).drop("distribution"), ["missing_pct"])


@query(
    "datetime_summary",
    f"""SELECT 'placed' AS "column", 'timestamp_ntz' AS dtype, count(placed) AS count, count(*) - count(placed) AS missing,
        {r("(count(*) - count(placed)) / count(*)::DOUBLE")} AS missing_pct, strftime(min(placed), '%Y-%m-%dT%H:%M:%S') AS min,
        strftime(max(placed), '%Y-%m-%dT%H:%M:%S') AS max, count(DISTINCT placed) AS "unique" FROM {{orders_date}} v""",
)
def datetime_summary(t):
    return round_columns(profile.datetime_summary(t.view("orders_date")), ["missing_pct"])


@query(
    "table_summary",
    """SELECT * FROM (SELECT '' AS "column", 'table' AS kind, unnest(['num_rows', 'num_columns']) AS stat, unnest([count(*)::VARCHAR, '6']) AS value FROM orders)
       UNION ALL SELECT 'o_orderkey', 'numeric', unnest(['count', 'unique']), unnest([count(o_orderkey)::VARCHAR, count(DISTINCT o_orderkey)::VARCHAR]) FROM orders
       UNION ALL SELECT 'o_totalprice', 'numeric', unnest(['count', 'unique']), unnest([count(o_totalprice)::VARCHAR, count(DISTINCT o_totalprice)::VARCHAR]) FROM orders
       UNION ALL SELECT 'o_custkey', 'numeric', unnest(['count', 'unique']), unnest([count(o_custkey)::VARCHAR, count(DISTINCT o_custkey)::VARCHAR]) FROM orders
       UNION ALL SELECT 'o_orderstatus', 'categorical', unnest(['count', 'unique']), unnest([count(o_orderstatus)::VARCHAR, count(DISTINCT o_orderstatus)::VARCHAR]) FROM orders
       UNION ALL SELECT 'o_orderpriority', 'categorical', unnest(['count', 'unique']), unnest([count(o_orderpriority)::VARCHAR, count(DISTINCT o_orderpriority)::VARCHAR]) FROM orders
       UNION ALL SELECT 'o_orderdate', 'datetime', unnest(['count', 'unique']), unnest([count(o_orderdate)::VARCHAR, count(DISTINCT o_orderdate)::VARCHAR]) FROM orders""",
)
def table_summary(t):
    stats = ("num_rows", "num_columns", "count", "unique")
    return profile.table_summary(t.table("orders")).where(F.col("stat").isin(*stats))


@query("table_summary_all")
def table_summary_all(t):
    return profile.table_summary(t.table("lineitem"))


@query("shape", "SELECT count(*) AS num_rows, 11::BIGINT AS num_columns FROM lineitem")
def shape(t):
    return profile.shape(t.table("lineitem"))


@query(
    "fill_rate",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing,
        CAST(trunc(count({c}) / count(*)::DOUBLE * 100) AS BIGINT) AS fill_pct FROM {{orders_missing}} v"""
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "price", "priority")
    ),
)
def fill_rate(t):
    return profile.fill_rate(t.view("orders_missing"))


def _histogram_sql(column: str, source: str) -> str:
    edge = "(lo + (({0}) * w))"
    return f"""(WITH e AS (SELECT min({column})::DOUBLE lo, (max({column}) - min({column})) / 30 AS w FROM {source}),
        g AS (SELECT {column}::DOUBLE x, least(CAST(floor(({column} - lo) / w) AS BIGINT), 29) g, lo, w FROM {source} v, e WHERE {column} IS NOT NULL),
        s AS (SELECT CASE WHEN x < {edge.format("g")} THEN g - 1 WHEN x >= {edge.format("g + 1")} AND g < 29 THEN g + 1 ELSE g END AS bin FROM g),
        c AS (SELECT bin, count(*) n FROM s GROUP BY bin)
        SELECT i AS bin, {r(edge.format("i"), 4)} AS low, {r(edge.format("i + 1"), 4)} AS high, coalesce(n, 0) AS n
        FROM (SELECT unnest(generate_series(0, 29)) i) b CROSS JOIN e LEFT JOIN c ON c.bin = i)"""


@query("histogram", _histogram_sql("l_extendedprice", "lineitem"))
def histogram(t):
    return round_columns(plotdata.histogram(t.table("lineitem"), "l_extendedprice"), ["low", "high"], 4)


@query("histogram_gaps", _histogram_sql("value", "{events_outliers}"))
def histogram_gaps(t):
    return round_columns(plotdata.histogram(t.view("events_outliers"), "value"), ["low", "high"], 4)


def _density_sql(column: str, source: str, points: int, margin: str, extra: str = "") -> str:
    return f"""(WITH s AS (SELECT count({column}) n, stddev_samp({column}) * power(count({column}), -0.2) h, min({column}) mn, max({column}) mx FROM {source}),
        g AS (SELECT i AS point, mn - {margin} + i * ((mx + {margin} - (mn - {margin})) / {points - 1}) AS x, n, h
              FROM s, (SELECT unnest(generate_series(0, {points - 1})) i)),
        v AS (SELECT {column} v FROM {source} WHERE {column} IS NOT NULL)
        SELECT point, {r("x", 4)} AS x, {r("sum(exp(-0.5 * power((x - v) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi()))", 12)} AS density{extra}
        FROM g, v GROUP BY point, x)"""


def _round_density(df):
    return round_columns(round_columns(df, ["x"], 4), ["density"], 12)


@query("density", _density_sql("o_totalprice", "orders", 200, "0"))
def density(t):
    return _round_density(plotdata.density(t.table("orders"), "o_totalprice"))


def _quartiles(column: str, source: str) -> str:
    return f"(SELECT quantile_cont({column}, 0.25) q1, quantile_cont({column}, 0.5) median, quantile_cont({column}, 0.75) q3 FROM {source})"


VIOLIN = f"""SELECT d.*, {r("q1", 4)} AS q1, {r("median", 4)} AS median, {r("q3", 4)} AS q3
    FROM {_density_sql("value", "events", 100, "2 * h")} d, {_quartiles("value", "events")}"""


@query("violin", VIOLIN)
def violin(t):
    return round_columns(_round_density(plotdata.violin(t.table("events"), "value")), ["q1", "median", "q3"], 4)


def _box_sql(column: str, source: str) -> str:
    inside = f"{column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    return f"""(SELECT {r("max(q1)", 4)} AS q1, {r("max(median)", 4)} AS median, {r("max(q3)", 4)} AS q3,
        {r(f"min({column}) FILTER ({inside})", 4)} AS whisker_low, {r(f"max({column}) FILTER ({inside})", 4)} AS whisker_high,
        count_if({column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM {source} v, {_quartiles(column, source)} q)"""


BOX_DOUBLES = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@query("box_stats", "SELECT * FROM " + _box_sql("value", "{events_outliers}"))
def box_stats(t):
    return round_columns(plotdata.box_stats(t.view("events_outliers"), "value"), BOX_DOUBLES, 4)


@query(
    "box_outliers",
    f"""SELECT value FROM {{events_outliers}} v, {_quartiles("value", "{events_outliers}")} q
        WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def box_outliers(t):
    return plotdata.box_outliers(t.view("events_outliers"), "value")


TOP_USERS = "(SELECT user_name u, count(*) n FROM {events_users} GROUP BY user_name ORDER BY n DESC, user_name LIMIT 20)"


@query("top_category_rows", f"SELECT * FROM {{events_users}} v WHERE user_name IN (SELECT u FROM {TOP_USERS})")
def top_category_rows(t):
    return plotdata.top_category_rows(t.view("events_users"), "user_name")


@query("count_plot", "SELECT priority AS value, count(*) AS n FROM {orders_missing} v GROUP BY priority")
def count_plot(t):
    return plotdata.count_plot(t.view("orders_missing"), "priority")


@query("count_plot_many", """SELECT o_custkey::VARCHAR AS value, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20""")
def count_plot_many(t):
    return plotdata.count_plot(t.table("orders"), "o_custkey")


@query(
    "plot_sample",
    f"SELECT * FROM lineitem_keys ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT 10000".replace("lineitem_keys", "orders"),
)
def plot_sample(t):
    return plotdata.plot_sample(t.table("orders"), ["o_orderkey"])


@query(
    "scatter",
    f"""SELECT user_id, value, event_type FROM {{events_outliers}} v WHERE value IS NOT NULL
        ORDER BY {hash_sql('event_id')}, event_id LIMIT 1500""",
)
def scatter(t):
    return plotdata.scatter(t.view("events_outliers"), ["user_id", "value"], ["event_id"], "event_type")


@query("scatter_3d", f"""SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY {hash_sql('p_partkey')}, p_partkey LIMIT 1500""")
def scatter_3d(t):
    return plotdata.scatter(t.table("part"), ["p_partkey", "p_size", "p_retailprice"], ["p_partkey"])


@query(
    "scatter_colours",
    f"""SELECT event_type AS class, count(*) AS n FROM (SELECT event_type FROM {{events_outliers}} v WHERE value IS NOT NULL
        ORDER BY {hash_sql('event_id')}, event_id LIMIT 1500) GROUP BY event_type""",
)
def scatter_colours(t):
    points = plotdata.scatter(t.view("events_outliers"), ["user_id", "value"], ["event_id"], "event_type")
    return plotdata.colour_classes(points, "event_type")


def _sides(make) -> str:
    return f"""SELECT *, 1 AS side FROM {make("o_totalprice", "orders")} UNION ALL SELECT *, 2 AS side FROM {make("o_totalprice", "{orders_shifted}")}"""


@query("compare_histograms", _sides(_histogram_sql))
def compare_histograms(t):
    out = plotdata.compare_columns(t.table("orders"), "o_totalprice", t.view("orders_shifted"), "o_totalprice")
    return round_columns(out, ["low", "high"], 4)


@query("compare_boxes", _sides(_box_sql))
def compare_boxes(t):
    out = plotdata.compare_columns(t.table("orders"), "o_totalprice", t.view("orders_shifted"), "o_totalprice", "box")
    return round_columns(out, BOX_DOUBLES, 4)


@query("compare_densities", _sides(lambda c, s: _density_sql(c, s, 1000, "0.5 * (mx - mn)")))
def compare_densities(t):
    return _round_density(
        plotdata.compare_columns(t.table("orders"), "o_totalprice", t.view("orders_shifted"), "o_totalprice", "density")
    )


@query(
    "compare_violins",
    _sides(
        lambda c, s: f"""(SELECT d.*, {r("q1", 4)} AS q1, {r("median", 4)} AS median, {r("q3", 4)} AS q3
        FROM {_density_sql(c, s, 100, "2 * h")} d, {_quartiles(c, s)})"""
    ),
)
def compare_violins(t):
    out = plotdata.compare_columns(t.table("orders"), "o_totalprice", t.view("orders_shifted"), "o_totalprice", "violin")
    return round_columns(_round_density(out), ["q1", "median", "q3"], 4)


@query(
    "compare_scatter",
    """SELECT 1 AS side, o_custkey::DOUBLE AS x, o_totalprice AS y, NULL::DOUBLE AS colour_value, o_orderstatus AS colour_class FROM orders
       UNION ALL SELECT 2, o_custkey, price, o_orderkey, NULL FROM {orders_missing} v WHERE price IS NOT NULL""",
)
def compare_scatter(t):
    return plotdata.compare_scatter(
        t.table("orders"), ["o_custkey", "o_totalprice"], t.view("orders_missing"), ["o_custkey", "price"], "o_orderstatus", "o_orderkey"
    )


@query("preview", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def previewed(t):
    """Fewer rows than a preview shows, so that all come back."""
    return preview(t.table("nation"))


@query("preview_lineitem", "SELECT least(1000, count(*)) AS n, true AS as_text, 0::BIGINT AS strangers FROM lineitem")
def previewed_lineitem(t):
    """A table larger than its preview: so many rows as text, each of them one of the table's."""
    lineitem = t.table("lineitem")
    shown = preview(lineitem)
    as_text = all(kind == "string" for _, kind in shown.dtypes)
    whole = lineitem.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in lineitem.columns])
    strangers = shown.exceptAll(whole).agg(F.count("*").alias("strangers"))
    return shown.agg(F.count("*").alias("n")).select("n", F.lit(as_text).alias("as_text")).crossJoin(strangers)
