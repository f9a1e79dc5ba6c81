"""Synthetic rows and their quality."""

from pyspark.sql import functions as F

from millrace.operators import quality, synth
from workload.book import query, r, round_columns

PAIR = ["o_totalprice", "o_custkey"]
LABELS = ["o_orderstatus", "o_orderpriority"]


def _ks_sql(column: str) -> str:
    return f"""(SELECT 1 - max(abs(cr / nr - cs / ns)) FROM (SELECT sum(r) OVER (ORDER BY v) cr, sum(s) OVER (ORDER BY v) cs,
        sum(r) OVER ()::DOUBLE nr, sum(s) OVER ()::DOUBLE ns FROM (SELECT v, sum(f) r, sum(1 - f) s FROM
        (SELECT {column}::DOUBLE v, 1 f FROM orders UNION ALL SELECT {column}::DOUBLE, 0 FROM {{orders_shifted}}) GROUP BY v)))"""


def _tv_sql(a: str, b: str = "''") -> str:
    return f"""(SELECT 1 - sum(abs(r / (SELECT count(*) FROM orders)::DOUBLE - s / (SELECT count(*) FROM orders)::DOUBLE)) / 2 FROM
        (SELECT a, b, sum(f) r, sum(1 - f) s FROM (SELECT {a} a, {b} b, 1 f FROM orders UNION ALL SELECT {a}, {b}, 0 FROM {{orders_shifted}}) GROUP BY a, b))"""


def _bins_sql(column: str) -> str:
    low, high = f"(SELECT min({column}) FROM orders)", f"(SELECT max({column}) FROM orders)"
    return f"greatest(0, least(9, floor(({column} - {low}) / (({high} - {low}) / 10::DOUBLE))))::BIGINT"


def _corr_sql(a: str, b: str) -> str:
    return f"(SELECT 1 - abs((SELECT corr({a}, {b}) FROM orders) - (SELECT corr({a}, {b}) FROM {{orders_shifted}})) / 2)"


@query("detect_roles", """SELECT 'c_custkey' AS "column", 'id' AS role FROM customer HAVING count(DISTINCT c_custkey) = count(*)
    UNION ALL SELECT 'c_name', 'id' FROM customer HAVING count(DISTINCT c_name) = count(*)
    UNION ALL SELECT 'c_nationkey', CASE WHEN count(DISTINCT c_nationkey) <= least(round(count(*) / 10), 10) THEN 'categorical' ELSE 'numerical' END FROM customer
    UNION ALL SELECT 'c_acctbal', 'numerical' FROM customer HAVING count_if(c_acctbal <> floor(c_acctbal)) > 0
    UNION ALL SELECT 'c_mktsegment', 'categorical' FROM customer HAVING count(DISTINCT c_mktsegment) <= round(count(*) / 5)""")
def detect_roles(t):
    return synth.roles_table(t.table("customer"))


@query(
    "continuous_shapes",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 'KSComplement' AS metric, {r(_ks_sql(c))} AS score" for c in PAIR),
)
def continuous_shapes(t):
    return round_columns(quality.continuous_shapes(t.table("orders"), t.view("orders_shifted"), PAIR), ["score"])


@query(
    "discrete_shapes",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 'TVComplement' AS metric, {r(_tv_sql(c))} AS score" for c in LABELS),
)
def discrete_shapes(t):
    return round_columns(quality.discrete_shapes(t.table("orders"), t.view("orders_shifted"), LABELS), ["score"])


@query(
    "correlation_trends",
    f"SELECT 'o_totalprice' AS a, 'o_custkey' AS b, 'CorrelationSimilarity' AS metric, {r(_corr_sql(*PAIR))} AS score",
)
def correlation_trends(t):
    return round_columns(quality.correlation_trends(t.table("orders"), t.view("orders_shifted"), PAIR), ["score"])


MIXED = [("o_orderstatus", "o_orderpriority"), ("o_orderstatus", "o_totalprice")]


def _pair_sql(a: str, b: str) -> str:
    return _tv_sql(*[_bins_sql(c) if c in PAIR else c for c in (a, b)])


@query(
    "contingency_trends",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, 'ContingencySimilarity' AS metric, {r(_pair_sql(a, b))} AS score" for a, b in MIXED
    ),
)
def contingency_trends(t):
    return round_columns(quality.contingency_trends(t.table("orders"), t.view("orders_shifted"), MIXED), ["score"])


REPORT = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _report_sql() -> str:
    rows = []
    for c in REPORT:
        metric, score = ("KSComplement", _ks_sql(c)) if c in PAIR else ("TVComplement", _tv_sql(c))
        rows.append(f"SELECT 'Column Shapes' AS property, '{c}' AS a, NULL AS b, '{metric}' AS metric, {score} AS score")
    for i, a in enumerate(REPORT):
        for b in REPORT[i + 1 :]:
            both = a in PAIR and b in PAIR
            metric, score = ("CorrelationSimilarity", _corr_sql(a, b)) if both else ("ContingencySimilarity", _pair_sql(a, b))
            rows.append(f"SELECT 'Column Pair Trends', '{a}', '{b}', '{metric}', {score}")
    return f"""WITH d AS ({' UNION ALL '.join(rows)}), p AS (SELECT property, avg(score) s FROM d GROUP BY property)
        SELECT property, a, b, metric, {r('score')} AS score FROM d UNION ALL SELECT property, NULL, NULL, 'Property', {r('s')} FROM p
        UNION ALL SELECT 'Overall', NULL, NULL, 'Overall', {r('avg(s)')} FROM p"""


@query("quality_report", _report_sql())
def quality_report(t):
    return round_columns(quality.quality_report(t.table("orders").select(*REPORT), t.view("orders_shifted").select(*REPORT)), ["score"])


@query("copula_correlation", "SELECT * FROM (VALUES (0, 0, 1.0::DOUBLE), (1, 0, 1.0::DOUBLE), (1, 1, 0.0::DOUBLE)) AS v(i, j, weight) WHERE (SELECT count(*) FROM orders) > 0")
def copula_correlation(t):
    """A column and a monotone copy of it have the same normal scores."""
    fitted = synth.fit_copula(t.table("orders").selectExpr("o_totalprice AS a", "o_totalprice * 3 + 7.5 AS b"))
    rows = [(i, j, round(w, 2) + 0.0) for i, line in enumerate(fitted.cholesky) for j, w in enumerate(line) if j <= i]
    return t.spark.createDataFrame(rows, "i int, j int, weight double")


@query("sample_many_categories", "SELECT count(*) AS n, count(*) AS known, true AS many FROM orders")
def sample_many_categories(t):
    """A text column with a value for every few orders keeps its values, however many there are."""
    orders = _named_orders(t)
    rows = orders.count()
    made = synth.sample_copula(t.spark, synth.fit_copula(orders), rows)
    names = orders.select("name").distinct().withColumn("known", F.lit(1))
    found = made.join(names, "name", "left")
    distinct = F.count_distinct("name") > rows / 20
    return found.agg(F.count("*").alias("n"), F.count("known").alias("known"), distinct.alias("many"))


def _named_orders(t):
    """Twelve orders share a name."""
    return t.table("orders").selectExpr("concat('name ', CAST(floor(o_orderkey / 12) AS string)) AS name", "o_totalprice")


@query("sample_copula", "SELECT count(*) AS n, true AS in_range FROM orders")
def sample_copula(t):
    """As many synthetic rows as there are orders; every price stays in the learnt range."""
    orders = t.table("orders").drop("o_orderkey")
    ends = orders.agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")).first()
    made = synth.sample_copula(t.spark, synth.fit_copula(orders), orders.count())
    inside = F.col("o_totalprice").between(ends["low"], ends["high"]) & F.col("o_orderstatus").isin("F", "O", "P")
    return made.agg(F.count("*").alias("n"), F.bool_and(inside).alias("in_range"))


@query("synthesize", "SELECT count(*) AS n, true AS graded, true AS close FROM customer")
def synthesize(t):
    """The synthesis run on customers: as many rows, graded, and close to them."""
    customers = t.table("customer").drop("c_name")
    made, config = synth.synthesize(customers, customers.count())
    grade = config["quality_evaluation"]
    parts = [(len(grade["details"]) > 0, grade["overall_score"] > 0.8)]
    return made.agg(F.count("*").alias("n")).select("n", F.lit(parts[0][0]).alias("graded"), F.lit(parts[0][1]).alias("close"))
