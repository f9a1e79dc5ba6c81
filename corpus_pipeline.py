"""The corpus pipeline: from raw documents to packed sequences, one table per stage.

Every stage works on all that the one before kept, and handles nulls in any column, empty and very long texts, repeated rows, empty tables and further
columns as its operator says. All but the last return the columns of ``documents``; the last returns one row per piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language, mixing, packing, secrets, superminhash
from millrace.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that are near no learned language: also those with a null text or without a letter."""
    docs = docs.select(COLUMNS)
    return language.identify(docs, language.fit(docs), keep=COLUMNS).where("NOT rejected").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity 0.8.

    It is the one with the smallest id, of several with that id one with the smallest digest, null ids last. Rows that share an id, or have none, are
    duplicates only if their texts are. All rows without a word stay.
    """
    order = F.struct(F.col("id").isNull(), "id", "mark")
    kept = superminhash.grouped(docs).where("n > 0").groupBy("component").agg(F.min(order)["mark"].alias("mark")).select("mark")
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = docs.where(~wordless).select(superminhash.identity().alias("mark"), F.struct(*COLUMNS).alias("row")).join(kept.hint("merge"), "mark")
    return one.groupBy("mark").agg(F.min("row").alias("row")).select("row.*").union(docs.where(wordless).select(COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret in the texts; no document is dropped."""
    docs = docs.select(COLUMNS)
    masked = secrets.redact(docs, secrets.learn(docs))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of it, rounded: none, one or two.

    Rows meet what is taken of them by a digest of all their columns, so ids may repeat or be null. Rows that agree in all columns come
    together as often as all of them are taken.
    """
    facts = [*[F.col(c).isNull() for c in COLUMNS], *COLUMNS]
    marked = docs.select(*COLUMNS, F.xxhash64(*facts).alias("mark"), F.xxhash64(F.lit(8), *facts).alias("also"))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    marks = ["mark", "also"]
    taken = cut_lineage(mixing.mix(marked, keep=marks).groupBy(*marks).agg(F.sum(times).alias("times"), F.count("*").alias("n")).where("times > 0"))
    rows = marked.join(taken.where("n = 1").hint("merge"), marks)
    alike = taken.where("n > 1")
    if not alike.isEmpty():
        rows = rows.union(marked.join(alike.hint("merge"), marks).dropDuplicates(marks))
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("best_fit_packing", sequences),
]

ORACLE_SQL: str | None = None  # trained models and token ids have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written as Parquet to shared storage and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
