"""Cleaning, scaling, encoding, balancing, reduction and sequences."""

from pyspark.sql import functions as F

from millrace.functions.columns import column_types
from millrace.operators import balance, clean, encode, reduce, scale, split
from millrace.plans.sequence import preview_sequence, replay_sequence, run_sequence
from workload.book import hash_sql, query, r, round_columns

MODE = (
    "(SELECT {0} FROM (SELECT {0}, count(*) n FROM {1} WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY n DESC, {0} LIMIT 1))"
)
PRIORITY_MODE = MODE.format("priority", "{orders_missing}")


@query("drop_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def drop_columns(t):
    return clean.fit_drop_columns(t.table("orders"), ["o_custkey", "o_orderdate", "no_such_column"]).transform(
        t.table("orders")
    )


@query("select_features", "SELECT l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem")
def select_features(t):
    features, target = ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag"
    return t.table("lineitem").select(*features, target)


@query(
    "column_types",
    """SELECT column_name AS "column", CASE WHEN data_type IN ('BIGINT','INTEGER','DOUBLE','BOOLEAN') THEN 'numeric'
       ELSE 'categorical' END AS type, n AS row_count
       FROM (SELECT * FROM (VALUES ('l_orderkey','BIGINT'),('l_partkey','BIGINT'),('l_suppkey','BIGINT'),('l_linenumber','INTEGER'),
       ('l_quantity','DOUBLE'),('l_extendedprice','DOUBLE'),('l_discount','DOUBLE'),('l_tax','DOUBLE'),('l_returnflag','VARCHAR'),
       ('l_linestatus','VARCHAR'),('l_shipdate','TIMESTAMP')) AS v(column_name, data_type)), (SELECT count(*) n FROM lineitem)""",
)
def typed_columns(t):
    df = t.table("lineitem")
    kinds = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("type")) for c, k in column_types(df).items()]
    return df.agg(F.count("*").alias("row_count")).select(F.inline(F.array(*kinds)), "row_count")


@query(
    "impute_mean",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus,
        {r("coalesce(price, (SELECT avg(price) FROM {orders_missing}))".replace("{orders_missing}", "{orders_missing}"), 4)} AS price,
        coalesce(priority, {PRIORITY_MODE}) AS priority FROM {{orders_missing}}""",
)
def impute_mean(t):
    return round_columns(clean.handle_missing(t.view("orders_missing"), "mean"), ["price"], 4)


@query(
    "impute_median",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus,
        {r("coalesce(price, (SELECT quantile_cont(price, 0.5) FROM {orders_missing}))", 4)} AS price, priority
        FROM {{orders_missing}}""",
)
def impute_median(t):
    df = t.view("orders_missing")
    return round_columns(clean.handle_missing(df, "median", ["price", "no_such_column"]), ["price"], 4)


@query(
    "impute_mode",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus,
        coalesce(price, {MODE.format("price", "{orders_missing}")}) AS price,
        coalesce(priority, {PRIORITY_MODE}) AS priority FROM {{orders_missing}}""",
)
def impute_mode(t):
    return clean.handle_missing(t.view("orders_missing"), "mode")


@query("drop_missing_rows", "SELECT * FROM {orders_missing} v WHERE price IS NOT NULL AND priority IS NOT NULL")
def drop_missing_rows(t):
    return clean.handle_missing(t.view("orders_missing"), "drop_rows")


@query("drop_missing_columns", "SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders_missing} v")
def drop_missing_columns(t):
    return clean.handle_missing(t.view("orders_missing"), "drop_columns")


IQR = """(SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM {events_outliers}) q"""


@query(
    "drop_outliers_iqr",
    f"""SELECT e.* FROM {{events_outliers}} e, {IQR}
        WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
)
def drop_outliers_iqr(t):
    df = t.view("events_outliers")
    return clean.fit_outliers(df, ["value"], "iqr", 1.5).transform(df)


ZSCORE = """(SELECT m, sqrt(avg(power(coalesce(value, m) - m, 2))) s
             FROM {events_outliers}, (SELECT avg(value) m FROM {events_outliers}) GROUP BY m) z"""


@query(
    "drop_outliers_zscore",
    f"SELECT e.* FROM {{events_outliers}} e, {ZSCORE} WHERE abs(coalesce(value, m) - m) / s <= 3",
)
def drop_outliers_zscore(t):
    df = t.view("events_outliers")
    return clean.fit_outliers(df, ["value"], "zscore", 3.0).transform(df)


@query(
    "outlier_rows_removed",
    f"""SELECT 'iqr' AS method, count(*) - count_if(value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS rows_removed
        FROM {{events_outliers}} e, {IQR}
        UNION ALL SELECT 'zscore', count(*) - count_if(abs(coalesce(value, m) - m) / s <= 3) FROM {{events_outliers}} e, {ZSCORE}""",
)
def outlier_rows_removed(t):
    df = t.view("events_outliers")
    found = [
        (m, clean.fit_outliers(df, ["value"], m, t).config["rows_removed"]) for m, t in (("iqr", 1.5), ("zscore", 3.0))
    ]
    return t.spark.createDataFrame(found, "method string, rows_removed bigint")


CORR_COLUMNS = ["l_quantity", "l_extendedprice", "net", "l_tax", "fixed"]


def _corr_sql() -> str:
    parts = []
    for a in CORR_COLUMNS:
        for b in CORR_COLUMNS:
            value = "1.0" if a == b else "NULL" if "fixed" in (a, b) else f"abs(corr({a}, {b}))"
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'CAST({value} AS DOUBLE)')} AS abs_r FROM {{lineitem_corr}}" + ("" if "corr" in value else " LIMIT 1"))
    return " UNION ALL ".join(f"({p})" for p in parts)


@query("correlation_matrix", _corr_sql())
def correlation_matrix(t):
    return round_columns(clean.correlation_matrix(t.view("lineitem_corr"), CORR_COLUMNS), ["abs_r"])


@query(
    "drop_correlated",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax, fixed FROM {lineitem_corr} v",
)
def drop_correlated(t):
    df = t.view("lineitem_corr")
    return clean.fit_high_correlation(df, 0.8).transform(df)


SCALED = ["l_quantity", "l_extendedprice"]
ITEM = "l_orderkey, l_linenumber, l_shipdate"


@query(
    "standard_scale",
    f"""SELECT {ITEM}, {r("(l_quantity - mq) / sq")} AS l_quantity, {r("(l_extendedprice - mp) / sp")} AS l_extendedprice
        FROM lineitem, (SELECT avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_extendedprice) mp,
        stddev_pop(l_extendedprice) sp FROM lineitem)""",
)
def standard_scale(t):
    df = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", *SCALED)
    return round_columns(scale.fit_standard(df, [*SCALED, "no_such_column"]).transform(df), SCALED)


@query(
    "minmax_scale",
    f"""SELECT {r("(l_quantity - lq) / (hq - lq)")} AS l_quantity, {r("(l_extendedprice - lp) / (hp - lp)")} AS l_extendedprice,
        {r("(net - ln) / (hn - ln)")} AS net, 0.0 :: DOUBLE AS fixed, l_orderkey, l_linenumber, l_tax
        FROM {{lineitem_corr}} v, (SELECT min(l_quantity) lq, max(l_quantity) hq, min(l_extendedprice) lp, max(l_extendedprice) hp,
        min(net) ln, max(net) hn FROM {{lineitem_corr}})""",
)
def minmax_scale(t):
    df = t.view("lineitem_corr")
    columns = [*SCALED, "net", "fixed"]
    return round_columns(scale.fit_minmax(df, columns).transform(df), columns)


@query(
    "robust_scale",
    f"""SELECT {ITEM}, {r("(l_quantity - q2) / (q3 - q1)")} AS l_quantity, {r("(l_extendedprice - p2) / (p3 - p1)")} AS l_extendedprice
        FROM lineitem, (SELECT quantile_cont(l_quantity, 0.25) q1, quantile_cont(l_quantity, 0.5) q2, quantile_cont(l_quantity, 0.75) q3,
        quantile_cont(l_extendedprice, 0.25) p1, quantile_cont(l_extendedprice, 0.5) p2, quantile_cont(l_extendedprice, 0.75) p3 FROM lineitem)""",
)
def robust_scale(t):
    df = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", *SCALED)
    return round_columns(scale.fit_robust(df, SCALED).transform(df), SCALED)


@query(
    "scale_with_gaps",
    f"""SELECT o_orderkey, {r("(price - m) / s")} AS price FROM {{orders_missing}} v,
        (SELECT avg(price) m, stddev_pop(price) s FROM {{orders_missing}})""",
)
def scale_with_gaps(t):
    df = t.view("orders_missing").select("o_orderkey", "price")
    return round_columns(scale.fit_standard(df, ["price"]).transform(df), ["price"])


def _flags(column: str, values: list[str], source: str | None = None) -> str:
    return ", ".join(
        f"CAST({source or column} IS NOT DISTINCT FROM '{v}' AS INTEGER) AS \"{column}_{v}\"" for v in values
    )


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "one_hot_encode",
    f"SELECT o_orderkey, o_custkey, price, {_flags('priority', PRIORITIES)}, {_flags('o_orderstatus', ['F', 'O', 'P'])} FROM {{orders_missing}} v",
)
def one_hot_encode(t):
    df = t.view("orders_missing")
    return encode.fit_one_hot(df, ["priority", "o_orderstatus"]).transform(df)


@query(
    "one_hot_sparse",
    """WITH v AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_orderkey % 11 <> 0 THEN l_partkey END AS part FROM lineitem),
        p AS (SELECT part, row_number() OVER (ORDER BY part) - 1 AS at FROM (SELECT DISTINCT part FROM v WHERE part IS NOT NULL)),
        f AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS at FROM (SELECT DISTINCT l_returnflag FROM v)),
        k AS (SELECT (SELECT count(*) FROM p) AS parts, (SELECT count(*) FROM f) AS flags)
        SELECT CAST(parts + flags AS INTEGER) AS width, coalesce(p.at || ',', '') || (parts + f.at) AS places, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys
        FROM v LEFT JOIN p ON p.part = v.part JOIN f ON f.l_returnflag = v.l_returnflag, k GROUP BY 1, 2""",
)
def one_hot_sparse(t):
    """Parts and return flags of all lines as one sparse vector; its places are read from its JSON form."""
    df = t.table("lineitem").selectExpr("l_orderkey", "l_returnflag", "CASE WHEN l_orderkey % 11 <> 0 THEN l_partkey END AS part")
    coded = encode.fit_sparse_one_hot(df, ["part", "l_returnflag"]).transform(df)
    inside = F.from_json(F.to_json(F.struct("indicators")), "indicators struct<size: int, indices: array<int>>").alias("v")
    places = F.concat_ws(",", F.col("v.indicators.indices").cast("array<string>")).alias("places")
    rows = coded.select("l_orderkey", inside).select("l_orderkey", F.col("v.indicators.size").alias("width"), places)
    return rows.groupBy("width", "places").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query(
    "one_hot_drop_first",
    f"SELECT o_orderkey, o_custkey, o_orderstatus, price, {_flags('priority', PRIORITIES[1:])} FROM {{orders_missing}} v",
)
def one_hot_drop_first(t):
    df = t.view("orders_missing")
    return encode.fit_one_hot(df, ["priority"], drop_first=True).transform(df)


@query(
    "encode_classes",
    """SELECT o_orderkey, o_custkey, o_orderstatus, price, code AS priority FROM {orders_missing} v
       LEFT JOIN (SELECT priority p, row_number() OVER (ORDER BY priority) - 1 code FROM
       (SELECT DISTINCT priority FROM {orders_missing} WHERE priority IS NOT NULL)) m ON v.priority = m.p""",
)
def encode_classes(t):
    return encode.encode_classes(t.view("orders_missing"), "priority")


@query(
    "encode_many_classes",
    """SELECT o_orderkey, o_orderstatus, code AS o_custkey FROM orders
       JOIN (SELECT c, row_number() OVER (ORDER BY c) - 1 code FROM (SELECT DISTINCT o_custkey c FROM orders)) ON c = o_custkey""",
)
def encode_many_classes(t):
    return encode.encode_many_classes(t.table("orders").select("o_orderkey", "o_orderstatus", "o_custkey"), "o_custkey")[0]


@query(
    "class_counts",
    """SELECT priority AS class, count(*) AS n, round(count(*) / total * 100, 2) AS share_pct
       FROM {orders_missing} v, (SELECT count(*)::DOUBLE total FROM orders) GROUP BY priority, total""",
)
def class_counts(t):
    return balance.class_counts(t.view("orders_missing"), "priority")


SHARES = {"common": 5, "mid": 3, "rare": "2"}
COUNTS = "(SELECT cls, count(*) n, CASE cls WHEN 'common' THEN 0.5::DOUBLE WHEN 'mid' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END p FROM {orders_classes} GROUP BY cls)"
TARGETS = f"""(SELECT cls, n, greatest(n, CAST(ceil(whole * p) AS BIGINT)) AS target FROM {COUNTS},
    (SELECT max(ceil(n / p)) whole FROM {COUNTS}))"""


@query(
    "normalize_proportions",
    "SELECT cls AS class, n, " + r("p") + f" AS share FROM {COUNTS}",
)
def normalize_proportions(t):
    plan = balance.balance_plan(t.view("orders_classes"), "cls", SHARES)
    return round_columns(plan.select("class", F.col("original").alias("n"), "share"), ["share"])


@query("oversample_targets", f"SELECT cls AS class, n AS original, target FROM {TARGETS}")
def oversample_targets(t):
    return balance.balance_plan(t.view("orders_classes"), "cls", SHARES).select("class", "original", "target")


ROW_ORDER = hash_sql("o_orderkey")
OVERSAMPLED = f"""
    WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {ROW_ORDER}, o_orderkey) rn FROM {{orders_classes}}),
    draws AS (SELECT cls c, 1 + {hash_sql("cls", "i")} % n AS pick
              FROM (SELECT cls, n, unnest(generate_series(1, target - n)) i FROM {TARGETS} WHERE target > n))
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, cls FROM numbered
    UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, cls FROM numbered JOIN draws ON cls = c AND rn = pick"""


@query("oversample", OVERSAMPLED)
def oversample(t):
    return balance.oversample(t.view("orders_classes"), "cls", SHARES, ["o_orderkey"])[0]


@query(
    "oversample_counts",
    f"SELECT cls, target AS n FROM {TARGETS}",
)
def oversample_counts(t):
    out, _ = balance.oversample(t.view("orders_classes"), "cls", SHARES, ["o_orderkey"])
    return out.groupBy("cls").agg(F.count("*").alias("n"))


@query("oversample_synthesis", f"SELECT cls, target AS n, target AS keys, n AS originals FROM {TARGETS}")
def oversample_synthesis(t):
    """Per class the rows, their distinct keys, and how many originals are still there unchanged."""
    orders = t.view("orders_classes")
    out = balance.oversample(orders, "cls", SHARES, ["o_orderkey"], "synthesis")[0]
    whole = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "cls"]
    kept = out.join(orders.select(*whole, F.lit(1).alias("original")), whole, "left")
    return kept.groupBy("cls").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.count("original").alias("originals"))


@query("encode_order_keys", """SELECT l_linenumber, l_quantity, code AS l_orderkey FROM lineitem
    JOIN (SELECT k, row_number() OVER (ORDER BY k) - 1 code FROM (SELECT DISTINCT l_orderkey k FROM lineitem)) ON k = l_orderkey""")  # fmt: skip
def encode_order_keys(t):
    """A class column with as many values as there are orders, as a step of a sequence."""
    items = t.table("lineitem").select("l_linenumber", "l_quantity", "l_orderkey")
    return run_sequence(items, [{"operation": "encode_classes", "config": {"column": "l_orderkey"}}])[0]


@query(
    "outlier_rows_removed",
    """SELECT CAST(count(*) AS BIGINT) AS rows_removed FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) a, quantile_cont(o_totalprice, 0.75) b FROM orders)
       WHERE o_totalprice NOT BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a)""",
)
def outlier_rows_removed(t):
    steps = [{"operation": "drop_outliers", "config": {"columns": ["o_totalprice"], "method": "iqr", "threshold": 0.2}}]
    _, configs = run_sequence(t.table("orders"), steps)
    return t.spark.createDataFrame([(configs[0]["rows_removed"],)], "rows_removed bigint")


@query("oversample_many_classes", "SELECT o_custkey AS cls, max(count(*)) OVER () AS n FROM orders GROUP BY o_custkey")
def oversample_many_classes(t):
    """As many classes as there are customers with orders, all brought to the size of the largest."""
    orders = t.table("orders").select("o_orderkey", "o_custkey")
    shares = orders.select(F.col("o_custkey").alias("class"), F.lit(1).alias("share")).distinct()
    out, _ = balance.oversample(orders, "o_custkey", shares, ["o_orderkey"])
    return out.groupBy(F.col("o_custkey").alias("cls")).agg(F.count("*").alias("n"))


MANY_SYNTHETIC = """(SELECT 1E7::DOUBLE + o_custkey % 500 AS cls, count(*) n, min(o_totalprice) low, max(o_totalprice) high FROM orders GROUP BY 1)"""


@query(
    "oversample_synthesis_many_classes",
    f"SELECT cls, max(n) OVER () AS n, max(n) OVER () AS keys, n AS originals, true AS inside, true AS known FROM {MANY_SYNTHETIC}",
)
def oversample_synthesis_many_classes(t):
    """500 classes named by floating-point numbers, each grown by rows from its own copula: within the class's range of prices, and with states the class has."""
    orders = t.table("orders").selectExpr("o_orderkey", "o_totalprice", "o_orderstatus", "1E7D + o_custkey % 500 AS cls")
    shares = orders.select(F.col("cls").alias("class"), F.lit(1).alias("share")).distinct()
    out = balance.oversample(orders, "cls", shares, ["o_orderkey"], "synthesis")[0]
    own = orders.groupBy("cls").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.collect_set("o_orderstatus").alias("states"))
    last = orders.agg(F.max("o_orderkey").alias("last"))  # one row
    seen = out.join(own, "cls").join(F.broadcast(last))
    return seen.groupBy("cls").agg(
        F.count("*").alias("n"),
        F.count_distinct("o_orderkey").alias("keys"),
        F.count_if(F.col("o_orderkey") <= F.col("last")).alias("originals"),
        F.every(F.col("o_totalprice").between(F.col("low"), F.col("high"))).alias("inside"),
        F.every(F.array_contains("states", F.col("o_orderstatus"))).alias("known"),
    )


@query(
    "balance_report",
    f"SELECT cls AS class, n AS original, target, target - n AS added FROM {TARGETS}",
)
def balance_report(t):
    return balance.balance_report(t.view("orders_classes"), "cls", SHARES)


# two columns have closed-form principal axes
PCA = """(SELECT ma, mb, ca, sa, va, vb, c, vt,
    (va + vb) / 2 + sqrt(power((va - vb) / 2, 2) + c * c) AS l1, (va + vb) / 2 - sqrt(power((va - vb) / 2, 2) + c * c) AS l2
    FROM (SELECT *, cos(th) ca, sin(th) sa, va + vb vt FROM (SELECT *, 0.5 * atan2(2 * c, va - vb) th FROM
    (SELECT avg(l_extendedprice) ma, avg(net) mb, var_samp(l_extendedprice) va, var_samp(net) vb, covar_samp(l_extendedprice, net) c
     FROM {lineitem_corr})))) p"""
AXIS_1 = "((l_extendedprice - ma) * ca + (net - mb) * sa)"
# the second axis is the first turned by 90 degrees, its largest loading made positive
AXIS_2 = "((l_extendedprice - ma) * -sa + (net - mb) * ca) * CASE WHEN (CASE WHEN abs(sa) > abs(ca) THEN -sa ELSE ca END) < 0 THEN -1 ELSE 1 END"


@query(
    "pca_reduce",
    f"""SELECT l_orderkey, l_linenumber, l_quantity, l_tax, fixed, {r(AXIS_1, 3)} AS pca_1, {r(AXIS_2, 3)} AS pca_2
        FROM {{lineitem_corr}} v, {PCA}""",
)
def pca_reduce(t):
    df = t.view("lineitem_corr")
    out = reduce.fit_reduction(df, ["l_extendedprice", "net", "no_such_column"], 2).transform(df)
    return round_columns(out, ["pca_1", "pca_2"], 3)


@query("pca_apply", f'SELECT {r(AXIS_1, 3)} AS "PC1" FROM {{lineitem_corr}} v, {PCA}')
def pca_apply(t):
    df = t.view("lineitem_corr").select("l_extendedprice", "net")
    return round_columns(reduce.fit_pca(df, 1).transform(df), ["PC1"], 3)


@query(
    "pca_explained_variance",
    f"""SELECT 1::BIGINT AS component, {r("l1 / vt")} AS ratio FROM {PCA} UNION ALL SELECT 2, {r("l2 / vt")} FROM {PCA}""",
)
def pca_explained_variance(t):
    df = t.view("lineitem_corr").select("l_extendedprice", "net")
    return round_columns(reduce.explained_variance(df, reduce.fit_pca(df, 2)), ["ratio"])


STEPS = [
    {"operation": "handle_missing_values", "config": {"strategy": "mean", "columns": ["price"]}},
    {"operation": "drop_outliers", "config": {"columns": ["price"], "method": "iqr", "threshold": 0.5}},
    {"operation": "standard_scale", "config": {"columns": ["price"]}},
    {"operation": "one_hot_encode", "config": {"columns": ["o_orderstatus"]}},
    {"operation": "drop_columns", "config": {"columns": ["o_custkey"]}},
]
STAGED = """
    WITH filled AS (SELECT * REPLACE (coalesce(price, (SELECT avg(price) FROM {orders_missing})) AS price) FROM {orders_missing}),
    q AS (SELECT quantile_cont(price, 0.25) q1, quantile_cont(price, 0.75) q3 FROM filled),
    kept AS (SELECT filled.* FROM filled, q WHERE price BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)),
    st AS (SELECT avg(price) m, stddev_pop(price) s FROM kept)"""


@query(
    "run_sequence",
    STAGED + f" SELECT o_orderkey, {r('(price - m) / s')} AS price, priority, {_flags('o_orderstatus', ['F', 'O', 'P'])} FROM kept, st",
)
def sequence(t):
    out, _ = run_sequence(t.view("orders_missing"), STEPS)
    return round_columns(out, ["price"])


@query(
    "replay_sequence",
    STAGED
    + f""", shifted AS (SELECT o_orderkey, o_orderstatus, o_totalprice AS price, o_orderpriority AS priority FROM {{orders_shifted}}),
    again AS (SELECT shifted.* FROM shifted, q WHERE price BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1))
    SELECT o_orderkey, {r('(price - m) / s')} AS price, priority, {_flags('o_orderstatus', ['F', 'O', 'P'])} FROM again, st""",
)
def replayed(t):
    _, configs = run_sequence(t.view("orders_missing"), STEPS)
    other = t.view("orders_shifted").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority")
    )
    return round_columns(replay_sequence(other, configs), ["price"])


@query(
    "preview_sequence",
    STAGED
    + """ SELECT count(*) AS row_count, 6::BIGINT AS column_count, 'o_orderkey, price, priority, o_orderstatus_F, o_orderstatus_O' AS first_columns FROM kept""",
)
def previewed(t):
    p = preview_sequence(t.view("orders_missing"), STEPS)
    return t.spark.createDataFrame(
        [(p["rows"], p["columns"], ", ".join(p["first_columns"]))],
        "row_count bigint, column_count bigint, first_columns string",
    )


@query(
    "train_test_split",
    f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {ROW_ORDER}, o_orderkey) <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split
        FROM orders, (SELECT count(*) n FROM orders)""",
)
def plain_split(t):
    return split.train_test_split(t.table("orders").select("o_orderkey"), ["o_orderkey"], 0.2)


@query(
    "stratified_split",
    f"""WITH c AS (SELECT cls k, count(*) n, floor(count(*) * ceil(total * 0.3) / total) base,
              count(*) * ceil(total * 0.3) / total - floor(count(*) * ceil(total * 0.3) / total) frac, ceil(total * 0.3) wanted
              FROM {{orders_classes}}, (SELECT count(*) total FROM orders) GROUP BY cls, total),
        m AS (SELECT k, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, k) <= wanted - sum(base) OVER () THEN 1 ELSE 0 END AS n_test FROM c)
        SELECT o_orderkey, cls, CASE WHEN row_number() OVER (PARTITION BY cls ORDER BY {ROW_ORDER}, o_orderkey) <= n_test THEN 'test' ELSE 'train' END AS split
        FROM {{orders_classes}} v JOIN m ON k = cls""",
)
def stratified_split(t):
    df = t.view("orders_classes").select("o_orderkey", "cls")
    return split.train_test_split(df, ["o_orderkey"], 0.3, stratify="cls")


# customers with one order share the class -1
KEPT_CUSTOMERS = "(SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN o_custkey ELSE -1 END AS cls FROM orders)"


@query(
    "stratified_split_many_classes",
    f"""WITH v AS {KEPT_CUSTOMERS}, t AS (SELECT count(*) AS total, CAST(ceil(count(*) * 0.3) AS BIGINT) AS wanted FROM v),
        c AS (SELECT cls AS k, count(*) * wanted // total AS base, count(*) * wanted % total AS over FROM v, t GROUP BY cls, wanted, total),
        m AS (SELECT k, base + CAST(row_number() OVER (ORDER BY over DESC, CAST(k AS varchar)) <= wanted - sum(base) OVER () AS BIGINT) AS n_test FROM c, t)
        SELECT o_orderkey, cls, CASE WHEN row_number() OVER (PARTITION BY cls ORDER BY {ROW_ORDER}, o_orderkey) <= n_test THEN 'test' ELSE 'train' END AS split
        FROM v JOIN m ON k = cls""",
)
def stratified_split_many_classes(t):
    """Every customer with two orders or more is a class, so class counts and leftovers stay tables."""
    orders = t.table("orders").select("o_orderkey", "o_custkey")
    sizes = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    df = orders.join(sizes, "o_custkey").select("o_orderkey", F.expr("CASE WHEN n > 1 THEN o_custkey ELSE -1 END AS cls"))
    return split.train_test_split(df, ["o_orderkey"], 0.3, stratify="cls")


@query(
    "stratified_folds",
    f"""SELECT o_orderkey, cls, CAST((rn > ceil(n / 3)) AS INTEGER) + CAST((rn > ceil(n * 2 / 3)) AS INTEGER) AS fold FROM
        (SELECT o_orderkey, cls, count(*) OVER (PARTITION BY cls) n, row_number() OVER (PARTITION BY cls ORDER BY {ROW_ORDER}, o_orderkey) rn
         FROM {{orders_classes}})""",
)
def stratified_folds(t):
    return split.assign_folds(t.view("orders_classes").select("o_orderkey", "cls"), ["o_orderkey"], 3, stratify="cls")
