import json
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import ranking
from millrace.session import cut_lineage
from millrace.operators import balance, clean, encode, reduce, scale
from millrace.operators.base import replay
from millrace.plans.sequence import run_sequence

NAN = float("nan")


def test_all_null_column_stays_null(frame):
    df = frame([(None, None), (None, None)], "x double, s string")
    for strategy in ("mean", "median", "mode"):
        assert [tuple(r) for r in clean.handle_missing(df, strategy).collect()] == [(None, None)] * 2


def test_nan_counts_as_missing(frame):
    df = frame([(1.0,), (NAN,), (None,), (3.0,)], "x double")
    assert sorted(r["x"] for r in clean.handle_missing(df, "mean").collect()) == [1.0, 2.0, 2.0, 3.0]
    assert clean.handle_missing(df, "drop_rows").count() == 2


def test_complete_integers_keep_their_type(frame):
    df = frame([(1, 1), (2, None)], "a int, b int")
    assert clean.handle_missing(df, "mean").dtypes == [("a", "int"), ("b", "double")]
    assert clean.handle_missing(df, "mode").dtypes == [("a", "int"), ("b", "int")]


def test_bad_strategy(frame):
    with pytest.raises(ValueError):
        clean.fit_missing(frame([(1,)], "a int"), "guess")


def test_outliers_on_constant_columns(frame):
    df = frame([(5.0,)] * 4, "x double")
    assert clean.fit_outliers(df, ["x"], "iqr").transform(df).count() == 4
    assert clean.fit_outliers(df, ["x"], "zscore").transform(df).count() == 0


def test_outlier_nulls(frame):
    df = frame([(float(i),) for i in range(10)] + [(None,)], "x double")
    assert clean.fit_outliers(df, ["x"], "iqr").transform(df).count() == 10
    assert clean.fit_outliers(df, ["x"], "zscore", 3.0).transform(df).count() == 11
    assert clean.fit_outliers(df, ["x"], "zscore").transform(df).count() == 9  # 1.5 by default, as for iqr
    fitted = clean.fit_outliers(df, ["x", "nope"], "iqr")
    assert fitted.config["rows_removed"] == 1 and fitted.config["columns"] == ["x"]


def test_outlier_bounds_come_from_unfiltered_rows(frame):
    df = frame([(float(i), 0.0) for i in range(20)] + [(1000.0, 0.0), (3.0, 99.0)], "a double, b double")
    kept = clean.fit_outliers(df, None, "iqr").transform(df)
    assert kept.count() == 20


def test_correlation_ignores_constants_and_keeps_the_first(frame):
    df = frame([(float(i), 2.0 * i, 5.0, "s") for i in range(10)], "a double, b double, c double, s string")
    assert clean.correlation(df)[("a", "c")] is None
    assert clean.fit_high_correlation(df).config["dropped_columns"] == ["b"]
    assert clean.fit_high_correlation(df, 1.0).config["dropped_columns"] == []
    assert clean.fit_high_correlation(df.select("s")).config["dropped_columns"] == []


def test_scalers_keep_nulls_and_survive_constants(frame):
    df = frame([(1.0, 7.0), (2.0, 7.0), (None, 7.0), (6.0, 7.0)], "x double, k double")
    out = scale.fit_standard(df, ["x", "k"]).transform(df)
    row = out.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max("k").alias("k"), F.count("x").alias("n")).first()
    assert row["m"] == pytest.approx(0) and row["s"] == pytest.approx(1) and row["k"] == 0 and row["n"] == 3
    out = scale.fit_minmax(df, ["x", "k"]).transform(df)
    assert tuple(out.agg(F.min("x"), F.max("x"), F.max("k")).first()) == (0.0, 1.0, 0.0)
    assert scale.fit_robust(df, ["k"]).transform(df).agg(F.max("k")).first()[0] == 0.0


def test_scaler_errors(frame):
    df = frame([(1.0, "a")], "x double, s string")
    for columns in (["nope"], ["s"]):
        with pytest.raises(ValueError):
            scale.fit_standard(df, columns)


def test_one_hot_order_nulls_and_replay(frame):
    df = frame([(1, "b", 2), (2, "a", 1), (3, None, 1)], "id int, s string, n int")
    fitted = encode.fit_one_hot(df, ["s", "n"])
    out = fitted.transform(df)
    assert out.columns == ["id", "s_a", "s_b", "n_1", "n_2"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 0, 1, 0, 1), (2, 1, 0, 1, 0), (3, 0, 0, 1, 0)]
    again = replay(json.loads(json.dumps(fitted.config)), df)
    assert again.collect() == out.collect()
    assert encode.fit_one_hot(df, ["s"], drop_first=True).transform(df).columns == ["id", "n", "s_b"]


def test_sparse_one_hot_sets_what_the_wide_one_sets(frame):
    rows = [(i, f"c{i % 7}" if i % 5 else None, i % 3 if i % 4 else None) for i in range(40)]
    df = frame(rows, "id int, kind string, no int")
    for drop in (False, True):
        wide = encode.fit_one_hot(df, ["no", "kind"], drop).transform(df).collect()
        fitted = encode.fit_sparse_one_hot(df, ["no", "kind"], drop)
        out = encode.Fitted(json.loads(json.dumps(fitted.config))).transform(df)
        assert out.columns == ["id", "indicators"]
        found = {r["id"]: [int(v) for v in r["indicators"].toArray()] for r in out.collect()}
        assert found == {r["id"]: list(r)[1:] for r in wide}


def test_sparse_one_hot_of_unseen_single_and_no_values(frame):
    seen = frame([(1, "a", "x"), (2, "b", "x")], "id int, kind string, one string")
    new = frame([(3, "zz", "x"), (4, "b", "y"), (5, None, None)], "id int, kind string, one string")
    out = encode.fit_sparse_one_hot(seen, ["kind", "one"], drop_first=True).transform(new)
    assert {r["id"]: list(r["indicators"].toArray()) for r in out.collect()} == {3: [0.0], 4: [1.0], 5: [0.0]}
    with pytest.raises(ValueError, match="no categories"):
        encode.fit_sparse_one_hot(seen, ["one"], drop_first=True)
    with pytest.raises(ValueError, match="exists"):
        encode.fit_sparse_one_hot(seen.withColumn("indicators", seen.id), ["kind"])


def test_one_hot_guard_is_the_callers(spark):
    with pytest.raises(ValueError, match="more than 3"):
        encode.fit_one_hot(spark.range(5), ["id"], max_categories=3)
    assert len(encode.fit_one_hot(spark.range(5), ["id"]).transform(spark.range(5)).columns) == 5


def test_encode_classes_sorts_by_type(frame):
    df = frame([(10,), (9,), (None,), (10,)], "n int")
    out = encode.encode_classes(df, "n")
    assert sorted((r["n"] for r in out.collect()), key=str) == [0, 1, 1, None]
    assert out.dtypes == [("n", "bigint")]


def test_encoding_replays_from_its_table(spark, tmp_path):
    df = spark.range(12_000).selectExpr("id", "CASE WHEN id % 5 = 0 THEN NULL ELSE concat('v', lpad(id, 6, '0')) END AS s")
    fitted = encode.fit_classes(df, "s", str(tmp_path))
    again = replay(json.loads(json.dumps(fitted.config)), df)
    assert again.dtypes == [("id", "bigint"), ("s", "bigint")]
    codes = [r["s"] for r in again.where("s IS NOT NULL").orderBy("id").collect()]
    assert codes == list(range(9_600)) and again.count() == 12_000
    assert replay(fitted.config, df.where("id < 0").union(spark.createDataFrame([(1, "new")], df.schema))).first()["s"] is None


def _targets(df, shares):
    return {r["class"]: r["target"] for r in balance.balance_plan(df, "c", shares).collect()}


def test_targets_never_shrink_a_class(frame):
    df = frame([("a",)] * 100 + [("b",)] * 10, "c string")
    assert _targets(df, {"a": 50, "b": 50}) == {"a": 100, "b": 100}
    skewed = _targets(df, {"a": 1, "b": 99})
    assert skewed["a"] >= 100 and skewed["b"] >= 10


@pytest.mark.parametrize("shares", [{"a": -1, "b": 2}, {"a": 0, "b": 0}, {"a": 1, "b": 0}, {}])
def test_bad_shares(frame, shares):
    with pytest.raises(ValueError):
        balance.balance_plan(frame([("a",), ("b",)], "c string"), "c", shares)


def test_balance_of_logical_classes(frame):
    df = frame([(True,)] * 3 + [(False,)], "c boolean")
    assert _targets(df, {True: 1, "False": 1}) == {True: 3, False: 3}


def test_synthetic_oversampling_repeats_no_key(frame):
    df = frame([(i, float(i % 7), "x" if i < 60 else "y" if i < 80 else "z") for i in range(100)], "id long, v double, c string")
    out, _ = balance.oversample(df, "c", {"x": 1, "y": 1, "z": 1}, ["id"], "synthesis")
    assert out.count() == 180 and out.select("id").distinct().count() == 180


def test_balance_of_floating_point_classes(frame):
    df = frame([(1.0e7,)] * 3 + [(1.5,)], "c double")
    for shares in ({1.0e7: 1, 1.5: 1}, {"1.0E7": 1, "1.50": 1}, frame([(1.0e7, 1), (1.5, 1)], "class double, share int")):
        assert _targets(df, shares) == {1.0e7: 3, 1.5: 3}


def test_synthesis_of_many_classes_in_as_many_jobs(spark, frame):
    """Marginals and dependence of each class on its own: opposite slopes, shifted ranges, own categories, gaps and a null class."""

    def rows(classes):
        out = []
        for c in range(classes):
            for i in range(60 if c % 2 else 40):
                x = (i * 37 % 60) + 100.0 * c + 0.5
                y = (1 if c % 2 else -1) * x + (i % 3)
                out.append((len(out), x, None if i % 4 == 0 else y, f"k{c % 3}-{i % 2}", None if c == 2 else f"c{c}"))
        return frame(out, "id long, x double, y double, kind string, c string")

    def jobs(df, group):
        """Jobs until the result is written."""
        spark.sparkContext.setJobGroup(group, "")
        shares = df.select(F.col("c").alias("class"), F.lit(1).alias("share")).distinct()
        out = cut_lineage(balance.oversample(df, "c", shares, ["id"], "synthesis")[0])
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("other", "")
        return out, n

    few, n_few = jobs(rows(4), "few")
    many, n_many = jobs(rows(40), "many")
    assert n_many <= n_few + 8  # the optimizer may join small tables in fewer jobs
    assert many.count() == 40 * 60 and many.select("id").distinct().count() == 40 * 60
    new = many.where("id >= 2000").groupBy("c").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.corr("x", "y").alias("r"), F.collect_set("kind").alias("kinds"), F.avg(F.col("y").isNull().cast("int")).alias("gaps"), F.count("*").alias("n")
    )
    seen = new.collect()
    assert len(seen) == 20 and sum(r["n"] for r in seen) == 400
    for r in seen:
        c = 2 if r["c"] is None else int(r["c"][1:])
        assert c % 2 == 0 and 100 * c <= r["low"] and r["high"] <= 100 * c + 60.5 and r["n"] == 20
        assert set(r["kinds"]) <= {f"k{c % 3}-0", f"k{c % 3}-1"}
    assert sum(r["r"] < -0.5 for r in seen) >= 18 and 0.1 < sum(r["gaps"] for r in seen) / 20 < 0.4


def test_oversample_keeps_originals_and_null_class(frame):
    rows = [(i, "x" if i < 40 else None if i < 45 else "y") for i in range(50)]
    df = frame(rows, "id int, c string")
    out, config = balance.oversample(df, "c", {"x": 1, "y": 1, "None": 1}, ["id"])
    counts = {r["c"]: r["n"] for r in out.groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert counts == {"x": 40, None: 40, "y": 40}
    assert out.select("id").distinct().count() == 50
    assert config["rows_after"] == 120 and config["rows_added_by_class"]["y"] == 35
    assert out.where("id < 40 and c <> 'x' or id >= 45 and c <> 'y'").count() == 0


def test_oversample_of_classes_numbered_in_slices(frame, monkeypatch):
    """A class of more rows than a window takes is numbered slice by slice, with the same numbers."""
    rows = [(i, "x" if i < 120 else None if i < 170 else "y") for i in range(200)]
    df = frame(rows, "id int, c string")
    shares = {"x": 2, "y": 1, "None": 1}

    def drawn():
        out = balance.oversample(df, "c", shares, ["id"])[0]
        assert out.columns == ["id", "c"]
        return sorted((r["id"], str(r["c"])) for r in out.collect())

    whole = drawn()
    assert len(whole) == 240
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 10)
    assert drawn() == whole


def test_picks_of_oversampling_are_not_sent_whole(spark):
    """The plan has a row per class, the picks one per new row."""
    df = cut_lineage(spark.range(50).selectExpr("id", "IF(id < 40, 'x', 'y') AS c"))
    out, _ = balance.oversample(df, "c", {"x": 1, "y": 1}, ["id"])
    plan = _plan(out)
    assert "SortMergeJoin" in plan and out.count() == 80


def test_draws_do_not_depend_on_chunks(frame, monkeypatch):
    plan = frame([("a", 7, 5), ("b", 11, 23), ("c", 9, 0)], "class string, original long, added long")
    whole = sorted(balance.draws(plan, 1).collect())
    monkeypatch.setattr(balance, "CHUNK", 4)
    assert sorted(balance.draws(plan, 1).collect()) == whole and len(whole) == 28


def test_wide_frames_use_the_grouped_layout(spark):
    """More columns than fit one aggregate give the same statistics."""
    wide = spark.range(50).selectExpr("id", *[f"CASE WHEN id % {i + 2} = 0 THEN NULL ELSE id * {i + 1}.0D END AS c{i}" for i in range(12)])
    names = [f"c{i}" for i in range(12)]
    together = scale.fit_standard(wide, names).config["stats"]
    for c in names:
        assert together[c] == pytest.approx(scale.fit_standard(wide, [c]).config["stats"][c])
    filled = clean.fit_missing(wide, "mean", names).config["fills"]
    assert filled == pytest.approx({c: v[0] for c, v in together.items()})


def test_oversample_errors(frame):
    df = frame([(1, "a"), (2, "a")], "id int, c string")
    for args in (("c", {"a": 1}), ("nope", {"a": 1})):
        with pytest.raises(ValueError):
            balance.oversample(df, *args, ["id"])
    with pytest.raises(ValueError):
        balance.oversample(df.limit(0), "c", {"a": 1}, ["id"])
    with pytest.raises(ValueError):
        balance.oversample(df, "c", {"a": 1}, ["id"], "magic")


def test_pca_separates_variance(frame):
    df = frame([(float(i), 2.0 * i + (i % 3), 1000.0 - i, "k") for i in range(60)], "a double, b double, c double, s string")
    fitted = reduce.fit_reduction(df, ["a", "b", "c", "s"], 2)
    out = fitted.transform(df)
    assert out.columns == ["s", "pca_1", "pca_2"]
    row = out.agg(F.avg("pca_1"), F.corr("pca_1", "pca_2"), F.var_samp("pca_1"), F.var_samp("pca_2")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(0, abs=1e-6)
    total = df.agg(F.var_samp("a") + F.var_samp("b") + F.var_samp("c")).first()[0]
    assert row[2] / total == pytest.approx(fitted.config["explained_variance"][0])
    assert row[3] / total == pytest.approx(fitted.config["explained_variance"][1])
    for line in fitted.config["loadings"]:
        assert max(line, key=abs) > 0


def test_pca_errors(frame):
    df = frame([(1.0, "a"), (None, "b")], "x double, s string")
    for columns, k in ((["x"], 2), (["x"], 0), (["s"], 1), (["nope"], 1), (["x"], 1)):
        with pytest.raises(ValueError):
            reduce.fit_reduction(df, columns, k)


def test_sequence_with_oversampling_goes_on(frame):
    df = frame([(i, "a" if i % 5 else "b", float(i)) for i in range(50)], "id int, c string, x double")
    steps = [
        {"operation": "oversample_classes", "config": {"class_column": "c", "target_proportions": {"a": 1, "b": 1}}},
        {"operation": "standard_scale", "config": {"columns": ["x"]}},
    ]
    out, configs = run_sequence(df, steps, key=["id"])
    assert out.count() == 80
    assert math.isclose(out.agg(F.stddev_pop("x")).first()[0], 1.0)
    assert [c["operation"] for c in configs] == ["oversample_classes", "standard_scale"]
    with pytest.raises(ValueError):
        run_sequence(df, [{"operation": "nope", "config": {}}])
    with pytest.raises(ValueError):
        run_sequence(df, steps)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_transforms_stay_narrow_and_jvm_side(spark):
    """Fitted transforms are one projection or filter over the pruned scan."""
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_quantity", "l_returnflag")
    outs = [
        scale.fit_standard(items, ["l_quantity"]).transform(items),
        clean.fit_outliers(items, ["l_quantity"]).transform(items),
        clean.handle_missing(items, "mean"),
        encode.fit_one_hot(items, ["l_returnflag"]).transform(items),
    ]
    for out in outs:
        plan = _plan(out)
        assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan
        assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
