import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel

from millrace.operators import profile
from millrace.plans import workbench
from millrace.session import cut_lineage
from millrace.sources import experiments, lineage
from millrace.sources.catalog import Catalog, preview
from millrace.sources.experiments import ExperimentLog
from millrace.sources.files import export, read_csv


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('id,name,price,day\n1,"a, b",1.5,2024-01-01\n2,,,2024-02-01\n3,c,3.25,\n')
    return str(path)


def test_csv_types(spark, csv):
    df = read_csv(spark, csv)
    assert df.dtypes == [("id", "int"), ("name", "string"), ("price", "double"), ("day", "date")]
    assert df.where("name IS NULL").count() == 1


def test_import_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        read_csv(spark, "table.xlsx")
    with pytest.raises(ValueError):
        export(spark.range(1), str(tmp_path / "x"), "excel")


def test_versions_branch_and_drop(spark, catalog, csv):
    catalog.create_dataset("people", csv)
    raw = catalog.load_version("people", "raw")
    catalog.create_version("people", "a", raw.drop("name"), "raw", "drop_columns", {"columns": ["name"]})
    catalog.create_version("people", "b", raw.na.drop(), "a", "handle_missing_values")
    catalog.create_version("people", "c", raw, "raw", "copy")
    with pytest.raises(ValueError, match="already exists"):
        catalog.create_version("people", "a", raw.limit(0), "raw", "x")
    assert catalog.load_version("people", "a").count() == 3
    with pytest.raises(ValueError, match="parent"):
        catalog.create_version("people", "d", raw, "zzz", "x")
    path = lineage.lineage(catalog.versions(), "people", "b").orderBy("step").collect()
    assert [r["member"] for r in path] == ["raw", "a", "b"]
    for version, text in (("raw", "cannot"), ("a", "child"), ("zzz", "does not exist")):
        with pytest.raises(ValueError, match=text):
            catalog.drop_version("people", version)
    catalog.drop_version("people", "b")
    assert {r["version"] for r in catalog.versions("people").collect()} == {"raw", "a", "c"}
    with pytest.raises(FileNotFoundError):
        catalog.load_version("people", "b")
    catalog.create_version("people", "b", raw, "a", "again")
    assert lineage.metadata(catalog.versions(), "people", "b")["operation"] == "again"
    with pytest.raises(ValueError):
        lineage.metadata(catalog.versions(), "people", "nope")


def test_empty_catalog(catalog):
    assert catalog.versions().count() == 0


@pytest.fixture
def tree(frame):
    day = dt.datetime(2024, 1, 1)
    rows = [
        ("d", "raw", None, "import", "{}", day),
        ("d", "a", "raw", "scale", "{}", day.replace(day=3)),
        ("d", "B", "a", "encode", "{}", None),
        ("d", "c", "raw", "scale", "{}", day.replace(day=2)),
        ("e", "raw", None, "import", "{}", day),
    ]
    return frame(rows, lineage.VERSIONS_SCHEMA)


def test_tree_questions(tree):
    assert [(r["dataset"], r["version"]) for r in lineage.listing(tree, "d").collect()][0] == ("d", "B")
    assert {r["version"] for r in lineage.removable(tree).collect()} == {"B", "c"}
    assert [r["version"] for r in lineage.search(tree, "b").collect()] == ["B"]
    assert [r["version"] for r in lineage.by_time(tree).collect()] == ["a", "c", "raw", "raw", "B"]
    assert lineage.by_time(tree, False).first()["version"] == "B"
    assert [r["operation"] for r in lineage.operations(tree).collect()] == ["encode", "import", "scale"]
    shown = {r["version"]: (r["shown_parent"], r["depth"]) for r in lineage.forest(tree.where("version <> 'a' AND dataset = 'd'")).collect()}
    assert shown == {"raw": (None, 0), "B": (None, 0), "c": ("raw", 1)}
    with pytest.raises(ValueError):
        lineage.lineage(tree, "d", "zzz")


def test_long_chains_need_few_rounds(spark):
    chain = spark.range(300).selectExpr("'d' AS dataset", "concat('v', id) AS version", "CASE WHEN id > 0 THEN concat('v', id - 1) END AS parent")
    path = lineage.lineage(chain, "d", "v299").orderBy("step").collect()
    assert [r["member"] for r in path] == [f"v{i}" for i in range(300)]


def test_preview_is_text(frame):
    rows = preview(frame([(1, None), (2, "x")], "a int, b string")).collect()
    assert [tuple(r) for r in rows] == [("1", ""), ("2", "x")]


def test_saved_work(spark, catalog):
    df = spark.range(60).selectExpr("id", "id % 3 AS g", "id * 1.5 AS x", "CASE WHEN id % 4 = 0 THEN NULL ELSE id * 2.0 END AS y")
    catalog.create_version("t", "raw", df, None, "import")
    steps = [{"operation": "handle_missing_values", "config": {"strategy": "mean"}}]
    assert workbench.save_sequence(catalog, "t", "raw", "filled", steps).where("y IS NULL").count() == 0
    assert "cluster" in workbench.save_clusters(catalog, "t", "filled", "grouped", ["x"], n_clusters=2).columns
    assert workbench.save_synthesis(catalog, "t", "filled", "made", 25, evaluate=False).count() == 25
    found = {r["version"]: (r["parent"], r["operation"]) for r in catalog.versions("t").collect()}
    assert found["filled"] == ("raw", "operations_sequence") and found["made"] == ("filled", "synthesis")
    assert found["grouped"] == ("filled", "clustering")


def test_experiment_log(spark, catalog, tmp_path):
    log = ExperimentLog(spark, str(tmp_path / "runs"))
    assert log.table().count() == 0
    df = spark.range(100).selectExpr("id", "id % 7 AS x", "(id % 7) * 2.0 + 1 AS y")
    catalog.create_version("t", "raw", df, None, "import")
    run = workbench.run_experiment(catalog, log, "t", "raw", "y", "regression", "linear_regression", ["id"], ["x"], name="first")
    row = log.load(run)
    assert row["dataset"] == {"name": "t", "version": "raw"} and row["main_metric"] == "mse"
    assert row["feature_columns"] == ["x"] and row["metrics"]["r2"] == pytest.approx(1.0)
    assert isinstance(log.load_model(run), PipelineModel)
    other = log.create("t", "raw", "svm", {"C": 1.0}, {"accuracy": 0.5})
    with pytest.raises(FileNotFoundError):
        log.load_model(other)
    with pytest.raises(FileNotFoundError):
        log.load("exp_none")
    listed = experiments.list_experiments(log.table(), min_metric={"accuracy": 0.4}).collect()
    assert [r["experiment_id"] for r in listed] == [other]
    assert experiments.list_experiments(log.table(), model_type="svm", date_from="2000-01-01").count() == 1
    assert experiments.list_experiments(log.table(), date_to="2000-01-01").count() == 0
    rows = {(r["section"], r["name"]): r for r in experiments.compare_two(log.table(), run, other).collect()}
    assert rows[("metric", "accuracy")]["value1"] == "N/A" and rows[("metric", "accuracy")]["better"] is None
    assert rows[("hyperparameter", "C")]["value2"] == "1.0" and rows[("field", "model")]["differs"]


@pytest.mark.parametrize(
    "name, first, second, winner",
    [
        ("accuracy", 0.9, 0.8, 1), ("RMSE", 1.0, 2.0, 1), ("mse", 3.0, 2.0, 2), ("neg_mean_squared_error", -1.0, -2.0, 1),
        ("something", 1.0, 2.0, 2), ("f1", 0.5, 0.5, None), ("balanced_accuracy_error", 1.0, 2.0, 2), ("loss", None, 2.0, None),
    ],
)
def test_better_side(frame, name, first, second, winner):
    from pyspark.sql import functions as F

    df = frame([(name, first, second)], "n string, a double, b double")
    assert df.select(experiments.better_side(F.col("n"), F.col("a"), F.col("b"))).first()[0] == winner


def test_profiles_of_odd_columns(frame):
    df = frame([(None, None, True), (None, None, None)], "x double, s string, b boolean")
    row = profile.numeric_summary(df).first()
    assert (row["count"], row["missing"], row["missing_pct"], row["mean"], row["q50"], row["unique"]) == (0, 2, 1.0, None, None, 0)
    assert profile.categorical_summary(df).first()["top_values"] == []
    assert profile.boolean_summary(df).first()["distribution"] == {"true": 1}
    assert {r["column"]: r["fill_pct"] for r in profile.fill_rate(df).collect()} == {"x": 0, "s": 0, "b": 50}
    assert profile.table_summary(df).where("stat = 'num_rows'").first()["value"] == "2"
    assert profile.shape(df).first()["num_columns"] == 3


def _versions(frame, links):
    return frame([("d", v, p, "op", None, None) for v, p in links], lineage.VERSIONS_SCHEMA)


def test_depths_of_a_chain_and_a_star(frame):
    chain = _versions(frame, [("v0", None)] + [(f"v{i}", f"v{i - 1}") for i in range(1, 150)])
    assert {int(r["version"][1:]): r["depth"] for r in lineage.depths(chain).collect()} == {i: i for i in range(150)}
    star = _versions(frame, [("raw", None), ("a", "raw")] + [(f"v{i}", "a") for i in range(200)])
    assert {r["depth"] for r in lineage.depths(star).where("version LIKE 'v%'").collect()} == {2}


@pytest.mark.parametrize("links", [[("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("raw", None)], [("a", "a")]])
def test_cycles_are_errors(frame, links):
    for question in (lineage.depths, lineage.ancestors):
        with pytest.raises(ValueError, match="cycle"):
            question(_versions(frame, links))


def test_a_name_is_given_once(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    df = spark.range(3)
    catalog.create_version("d", "raw", df, None, "import")
    files, claim = catalog._claim("d", "late")
    assert files.createNewFile(claim)  # another writer got there first
    with pytest.raises(ValueError, match="being written"):
        catalog.create_version("d", "late", df, "raw", "x")
    with pytest.raises(Exception):
        catalog.create_version("d", "broken", df.selectExpr("raise_error('no') AS x"), "raw", "x")
    catalog.create_version("d", "broken", df, "raw", "x")
    catalog.drop_version("d", "broken")
    catalog.create_version("d", "broken", df, "raw", "x")
    for name in ("../up", "_hidden", "", "a/b"):
        with pytest.raises(ValueError):
            catalog.create_version("d", name, df, "raw", "x")


def _paths_by_hand(links):
    parent = {(d, v): p for d, v, p in links}
    out = set()
    for d, v, _ in links:
        path = [v]
        while parent.get((d, path[-1])) is not None:
            path.append(parent[d, path[-1]])
        out |= {(d, v, i, m) for i, m in enumerate(reversed(path))}
    return out


@pytest.mark.parametrize("together", [50_000, 40, 1])  # walked in one task, both ways, ranked
def test_paths_by_intervals(spark, monkeypatch, together):
    monkeypatch.setattr(lineage, "TOGETHER", together)
    draw = random.Random(8)
    links = [("tree", "raw", None)] + [("tree", f"v{i}", draw.choice(["raw", *[f"v{j}" for j in range(i)]])) for i in range(60)]
    links += [("star", "raw", None)] + [("star", f"v{i}", "raw") for i in range(50)]
    links += [("chain", "v0", None)] + [("chain", f"v{i}", f"v{i - 1}") for i in range(1, 45)]
    links += [("roots", "a", None), ("roots", "b", None), ("roots", "c", "gone"), ("roots", "d", "gone"), ("one", "raw", None)]
    versions = spark.createDataFrame(links, "dataset string, version string, parent string")
    assert {tuple(r) for r in lineage.lineage(versions).collect()} == _paths_by_hand(links)
    assert {tuple(r) for r in lineage.lineage(versions, "tree", "v59").collect()} == {p for p in _paths_by_hand(links) if p[:2] == ("tree", "v59")}
    of = versions.where("version = 'v40'")
    found = {(r["dataset"], r["version"], r["ancestor"], r["distance"]) for r in lineage.ancestors(versions, of).collect()}
    wanted = {p for p in _paths_by_hand(links) if p[1] == "v40"}
    assert found == {(d, v, m, max(q[2] for q in wanted if q[0] == d) - i) for d, v, i, m in wanted}
    numbered = lineage.intervals(versions).collect()
    assert len(numbered) == len(links) + 1  # one row per version, and one for the parent that is gone
    assert all(r["leave"] > r["enter"] >= 0 for r in numbered)


def test_cycles_in_large_datasets_are_errors(spark, monkeypatch):
    monkeypatch.setattr(lineage, "TOGETHER", 2)
    links = [("d", "a", "b"), ("d", "b", "c"), ("d", "c", "a"), ("d", "raw", None), ("d", "x", "raw"), ("e", "raw", None)]
    with pytest.raises(ValueError, match="cycle"):
        lineage.lineage(spark.createDataFrame(links, "dataset string, version string, parent string"))


def test_a_name_left_by_a_killed_writer_can_be_freed(spark, catalog):
    df = spark.range(3)
    catalog.create_version("d", "raw", df, None, "import")
    files, claim = catalog._claim("d", "late")
    assert files.createNewFile(claim)  # and the writer is gone
    assert catalog.release_name("d", "late") and not catalog.release_name("d", "late")
    catalog.create_version("d", "late", df, "raw", "copy")
    for name in ("raw", "late"):
        with pytest.raises(ValueError, match="exists"):
            catalog.release_name("d", name)
    assert catalog.load_version("d", "late").count() == 3


def test_tables_of_versions_are_never_sent_whole(spark):
    """A small file can be many rows in memory, and a cover many blocks, so no join goes by the size of the files."""
    links = [("d", "raw", None)] + [("d", f"v{i}", f"v{i // 2}" if i > 1 else "raw") for i in range(1, 60)]
    versions = cut_lineage(spark.createDataFrame(links, "dataset string, version string, parent string"))
    for found in (lineage.lineage(versions), lineage.ancestors(versions), lineage.forest(versions), lineage.removable(versions)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in lineage.lineage(versions).collect()} == _paths_by_hand(links)


def test_large_datasets_are_walked_and_paths_made_without_joins(spark, monkeypatch):
    """60 000 versions of a dataset need no ranking, and no row per version and ancestor is shuffled."""
    monkeypatch.setattr(lineage, "_ranked", None)
    monkeypatch.setattr(lineage, "LEAST_IN_SPAN", 100)
    monkeypatch.setattr(lineage, "SPAN_ROWS", 20_000)
    name = lambda c: f"CASE WHEN {c} = 0 THEN 'raw' ELSE concat('V', {c}) END"
    versions = spark.range(60_000).selectExpr("'d' AS dataset", f"{name('id')} AS version", f"CASE WHEN id > 0 THEN {name('(id - 1) div 2')} END AS parent")
    found = lineage.lineage(versions)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("RepartitionByExpression")
    lengths = [(i + 1).bit_length() for i in range(60_000)]
    assert found.count() == sum(lengths)
    own = found.where("version = member").selectExpr("if(version = 'raw', 0, int(substr(version, 2))) AS n", "step")
    assert {r["n"]: r["step"] + 1 for r in own.collect()} == dict(enumerate(lengths))
    path = found.where("version = 'V59998'").orderBy("step").collect()
    assert [r["member"] for r in path] == ["raw"] + [f"V{(59_999 >> k) - 1}" for k in range((59_999).bit_length() - 2, -1, -1)]


def test_long_paths_are_handed_on_in_pieces(monkeypatch):
    monkeypatch.setattr(lineage, "AT_ONCE", 7)
    depths = [0, 1, 2, *range(3, 20), 5, 1, 0, 1]
    asked = [False, False, False, *[True] * 21]
    rows = pa.table({"dataset": ["d"] * 24, "depth": depths, "version": [f"v{i}" for i in range(24)], "asked": asked})
    stack, wanted = {}, set()
    for i, (depth, wish) in enumerate(zip(depths, asked)):
        stack[depth] = f"v{i}"
        wanted |= {(f"v{i}", step, stack[step]) for step in range(depth + 1) if wish}
    for size in (24, 5, 1):
        pieces = [p for b in lineage._stacked(iter(rows.to_batches(max_chunksize=size))) for p in b.to_pylist()]
        assert {(p["version"], p["start"] + i, m) for p in pieces for i, m in enumerate(p["members"])} == wanted
        assert sum(len(p["members"]) for p in pieces) == len(wanted) and max(len(p["members"]) for p in pieces) <= 7


def test_sums_along_lists(spark, monkeypatch):
    monkeypatch.setattr(lineage, "TOGETHER", 4)
    steps = [(i * 10, (i + 1) * 10 if i < 30 else None, i % 3, 1) for i in range(31)] + [(1, None, 5, 1), (3, 3, 1, 1), (5, 7, 1, 1), (7, 5, 1, 1)]
    found = lineage._suffix_sums(spark.createDataFrame(steps, "step long, next long, height long, behind long")).collect()
    wanted = {i * 10: (sum(j % 3 for j in range(i, 31)), 31 - i) for i in range(31)} | {1: (5, 1)} | {i: (None, None) for i in (3, 5, 7)}
    assert {r["step"]: (r["height"], r["behind"]) for r in found} == wanted and len(found) == len(steps)
