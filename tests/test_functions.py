import random
import statistics

import pytest
from pyspark.sql import functions as F

from millrace.functions import quantiles as q
from millrace.functions.columns import column_kinds, column_types, without_nan
from millrace.functions.counts import distinct_counts, modes, top_values, value_counts
from millrace.functions.ranking import exact_sample, first_rows, numbered, running_sums, seeded_hash


def _expected(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


@pytest.mark.parametrize("shape", ["spread", "hot", "two", "one"])
def test_quantiles_match_sorting(spark, shape, monkeypatch):
    """Small limits force several narrowing rounds; a hot value holds most rows in one case."""
    monkeypatch.setattr(q, "GATHER_ROWS", 40)
    monkeypatch.setattr(q, "SMALL_SPAN", 10)
    rng = random.Random(7)
    values = {
        "spread": [rng.lognormvariate(0, 3) for _ in range(5_000)],
        "hot": [1.5] * 2_000 + [rng.random() * 3 for _ in range(3_000)],
        "two": [0.0, 1.0] * 500,
        "one": [4.0],
    }[shape]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = q.quantiles(df, {"x": F.col("x")}, probs)["x"]
    assert found == pytest.approx([_expected(values, p) for p in probs])


def test_quantiles_of_nothing(frame):
    df = frame([(None,), (None,)], "x double")
    assert q.quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": [None]}
    assert q.quantiles(df, {}, [0.5]) == {}


def test_approximate_quantiles_are_one_pass(frame):
    df = frame([(float(i),) for i in range(101)], "x double")
    assert q.quantiles(df, {"x": F.col("x")}, [0.5], accuracy=1000)["x"] == [50.0]


def test_uniform_ranks_recover_from_a_wrong_guess(spark, monkeypatch):
    """Values bunched at the low end lie outside the first bracket."""
    monkeypatch.setattr(q, "GATHER_ROWS", 50)
    df = spark.range(1000).select((F.col("id") * 1.0).alias("x"))
    found = q.uniform_ranks(df, {"x": F.col("x")}, {"x": 1000}, {"x": [0, 499, 999]}, 1 << 52)
    assert {r: v.value for r, v in found["x"].items()} == {0: 0.0, 499: 499.0, 999: 999.0}


def test_column_kinds_and_nan(frame):
    df = frame([(1, float("nan"), True, "a")], "i int, d double, b boolean, s string")
    assert column_kinds(df) == {"i": "numeric", "d": "numeric", "b": "boolean", "s": "categorical"}
    assert column_types(df)["b"] == "numeric"
    assert without_nan(df).first()["d"] is None


def test_value_counts_keep_types_apart(frame):
    df = frame([(1, 1.5, "x", True), (1, 1.5, None, False), (2, None, "x", True)], "i bigint, d double, s string, b boolean")
    found = {(r["column"], r["value"]): r["n"] for r in value_counts(df, df.columns).collect()}
    assert found == {
        ("i", "1"): 2, ("i", "2"): 1, ("d", "1.5"): 2, ("s", "x"): 2, ("b", "true"): 2, ("b", "false"): 1,
    }
    assert distinct_counts(df, df.columns) == {"i": 2, "d": 1, "s": 1, "b": 2}


def test_mode_takes_the_smallest_on_ties(frame):
    df = frame([("b", 10), ("a", 9), ("a", 10), ("b", 9)], "s string, n int")
    assert modes(df, ["s", "n"]) == {"s": "a", "n": "9"}
    assert modes(frame([(None,)], "s string"), ["s"]) == {}


def test_top_values_order(frame):
    df = frame([(v,) for v in [10, 9, 9, 10, 2]], "n int")
    assert [(r["value"], r["n"]) for r in top_values(df, ["n"], 2).orderBy("rank").collect()] == [("9", 2), ("10", 2)]


def test_exact_sample_is_exact_and_stable(spark):
    df = spark.range(5_000)
    first = {r["id"] for r in exact_sample(df, ["id"], 321, 7).collect()}
    again = {r["id"] for r in exact_sample(df.repartition(13), ["id"], 321, 7).collect()}
    assert len(first) == 321 and first == again
    assert first != {r["id"] for r in exact_sample(df, ["id"], 321, 8).collect()}
    assert exact_sample(df, ["id"], 9_999, 7).count() == 5_000


def test_repeated_keys_are_reported(frame):
    df = frame([(1,)] * 50, "id bigint")
    with pytest.raises(ValueError, match="do not identify rows"):
        exact_sample(df, ["id"], 10, 1)


def test_tied_hashes_fall_back_to_the_key(spark, monkeypatch):
    from millrace.functions import ranking

    monkeypatch.setattr(ranking, "seeded_hash", lambda seed, *parts: F.lit(5).cast("long"))
    df = spark.range(100)
    cut = first_rows(df, ["id"], 1, {"all": (F.lit(True), 100, [10])})["all"][0]
    assert {r["id"] for r in df.where(cut.takes(F.lit(5).cast("long"), ["id"])).collect()} == set(range(10))


@pytest.mark.parametrize("largest", [1_000, 2_000_000])
def test_numbering_is_dense_whatever_the_slices(spark, largest):
    """A large ``largest`` makes the hash range fall into slices."""
    df = spark.range(1_000).withColumn("g", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2))
    rows = numbered(df, "g", ["id"], 3, largest).withColumn("h", seeded_hash(3, "id")).collect()
    for g in (None, 0, 1):
        part = sorted((r for r in rows if r["g"] == g), key=lambda r: r["row_no"])
        assert [r["row_no"] for r in part] == list(range(1, len(part) + 1))
        assert [r["h"] for r in part] == sorted(r["h"] for r in part)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"), F.lit(2).alias("n"))
    rows = running_sums(df, "x", ["n"], "g", descending).collect()
    for g in range(3):
        part = sorted((r for r in rows if r["g"] == g), key=lambda r: r["x"], reverse=descending)
        assert [r["cum_n"] for r in part] == [2 * (i + 1) for i in range(len(part))]


def test_median_agrees_with_statistics(spark):
    values = [random.Random(1).gauss(0, 1) for _ in range(999)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert q.quantiles(df, {"x": F.col("x")}, [0.5])["x"] == [statistics.median(values)]
