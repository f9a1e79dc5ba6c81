"""Queries of the subpackage over the smallest tables: those with SQL equal DuckDB, all return one row or more."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from millrace.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    rows = QUERIES[name](spark, FOLDER).select(names).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(name, spark):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_registered():
    names = contract.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(9001, None, None, None, None), (9002, "", "en", None, 0), (9003, "12", None, "s", 2), (0, "zz", "en", "s", 2)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).union(docs.limit(3)).withColumn("score", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, FOLDER)
    assert not {9001, 9002, 9003} & {r["doc_id"] for r in known.collect()}
    one = stages["near_duplicates"](spark, docs, FOLDER)
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert len(rows) == len(set(rows)) and {9001, 9002, 9003} <= {i for i, _ in rows} and (0, "zz") in rows
    masked = stages["secret_scan"](spark, one, FOLDER)
    assert masked.count() == one.count()
    assert not masked.where(F.col("text").rlike("AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}")).count()
    mixed = stages["source_mix"](spark, masked, FOLDER)
    assert mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 2
    for frame in (known, one, masked, mixed):
        assert frame.columns == corpus_pipeline.COLUMNS
    packed = stages["best_fit_packing"](spark, mixed, FOLDER)
    assert packed.where("piece = 0").count() == mixed.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id < 0"), FOLDER).count() == 0, name


def test_mix_stage_keeps_rows_without_ids(spark):
    """Every row is taken once: sources of equal weight, a total of all their words."""
    docs = spark.createDataFrame([(i if i % 3 else None, f"some words number {i}", "en", None, i) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.union(docs.limit(4))
    mixed = corpus_pipeline.source_mix(spark, docs, FOLDER)
    counts = {r["text"]: r["count"] for r in mixed.groupBy("text").count().collect()}
    words = mixed.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(words - 1.5 * 34 * 4) <= 34 * 2 and max(counts.values()) <= 4
    assert any(r["doc_id"] is None for r in mixed.collect()) and mixed.columns == corpus_pipeline.COLUMNS
