"""How filters of documents interact: what each would remove in every order of application.

1. ``measure``: the failure bits A to D, the part and two 64-bit hashes of every whole text, in one pass.
2. ``later_copies``, an existential self-join: a left-semi join on the hash, the exact text and a smaller id marks filter E. The right side holds one row per
   distinct text with its smallest id; only texts whose hash repeats are moved.
3. ``failures``: the union of the ids that E marks with the ids and bits of the other filters, one row per document.
4. ``audit``: documents per combination of bits, which is all that the 120 orders need.

No group of copies meets in one task: counts and smallest ids are combined before they are shuffled, and the left side of a join may be split.

Defined results: a null text is the empty text, which has no word, so it fails A alone, and E if a smaller id has an empty text. A null part is the empty
string. Null ids are larger than all others and not smaller than each other, and have no labels. Rows that repeat an id with the same text count each,
and do not make each other fail E. Of several label rows of an id any 1 counts; null labels are not 1. An empty table has no part and gives no row. Only the
named columns are read, so further ones may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytetext import IS_SPACE
from millrace.llm.wordstream import Texts
from millrace.session import cut_lineage

FILTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}
SPECIAL = "#$%&*|"
BYTES = np.arange(256)
IS_UPPER = (BYTES >= 65) & (BYTES <= 90)
IS_SPECIAL = np.isin(BYTES, list(SPECIAL.encode()))
IS_LATER_BYTE = (BYTES & 0xC0) == 0x80  # of a code point


def _bits(texts: Texts, fewest: int, distinct: int, upper: int) -> np.ndarray:
    n = len(texts)
    rows, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for row, hashed, _ in texts.words(~IS_SPACE, lowered=False):
        rows.append(row)
        hashes.append(hashed)
    row, hashed = np.concatenate(rows), np.concatenate(hashes)
    words = np.bincount(row, minlength=n)
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    kinds = np.bincount(row[new], minlength=n)
    points = np.diff(texts.cuts) - texts.counts(IS_LATER_BYTE)
    fails = [words < fewest, 100 * kinds < distinct * words, 100 * texts.counts(IS_UPPER) > upper * points, texts.counts(IS_SPECIAL) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _marks(text: str) -> list[Column]:
    return [F.xxhash64(_whole(text)).alias("hash"), F.xxhash64(F.lit(12), _whole(text)).alias("more")]


def measure(
    df: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source", fewest: int = 50, distinct: int = 65, upper: int = 5
) -> DataFrame:
    """``id``, ``part``, ``hash``, ``more`` and ``bits`` (filters A to D that fail) of every row.

    A: fewer than ``fewest`` words; B: under ``distinct`` per cent of them distinct; C: over ``upper`` per cent of the code points in A-Z; D: a special character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits(Texts(batch.column(4)), fewest, distinct, upper)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bits, pa.int32())], ["id", "part", "hash", "more", "bits"])

    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *_marks(text), _whole(text).alias("text"))
    return rows.mapInArrow(run, "id long, part string, hash long, more long, bits int")


def later_copies(df: DataFrame, measured: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """``id``, ``part``, ``hash`` and ``more`` of the rows whose exact text a smaller id has too."""
    repeated = measured.groupBy("hash", "more").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("id").alias("with_id"), F.count("*").alias("n"))
    repeated = cut_lineage(repeated.where("low < high OR 0 < with_id AND with_id < n").select("hash", "more"))
    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *_marks(text), _whole(text).alias("text"))
    copies = cut_lineage(rows.join(repeated, ["hash", "more"], "left_semi"))
    first = copies.groupBy("hash", "text").agg(F.min("id").alias("id"))
    first = cut_lineage(first.where("id IS NOT NULL"))  # a plain table, so that Spark can split the copies of one text
    a, b = copies.alias("a"), first.alias("b")
    smaller = F.col("a.id").isNull() | (F.col("b.id") < F.col("a.id"))
    return a.join(b, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.text") == F.col("b.text")) & smaller, "left_semi").select("id", "part", "hash", "more")


def failures(df: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """``id``, ``part``, ``hash``, ``more``, ``bits`` (all five filters) and ``n`` (rows that are alike in id, part and text)."""
    measured = cut_lineage(measure(df, text, key, part))
    marked = later_copies(df, measured, text, key, part)
    both = measured.withColumn("n", F.lit(1)).unionByName(marked.select("*", F.lit(BIT["E"]).alias("bits"), F.lit(0).alias("n")))
    return both.groupBy("id", "part", "hash", "more").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def combinations(failed: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``part``, ``bits``, and how many documents have them: ``n``, ``good`` (quality 1), ``toxic`` (toxic 1)."""
    known = labels.groupBy(F.col(key).cast("long").alias("id")).agg(
        *[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    )
    seen = failed.join(known, "id", "left")
    sums = [F.sum(F.col("n") * F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("good", "toxic")]
    return seen.groupBy("part", "bits").agg(F.sum("n").cast("long").alias("n"), *sums)


def audit(counted: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, from the counts per combination of bits (32 per part at most)."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(before).alias("before"), F.lit(BIT[letter]).alias("own")))
            before |= BIT[letter]
    own, before, bits = F.col("own"), F.col("before"), F.col("bits")
    fails, gone = bits.bitwiseAND(own) != 0, bits.bitwiseAND(before) != 0
    # an order removes a document by the first of its failing filters, and each of them is first equally often
    share = F.lit(120) / F.bit_count(bits)

    def total(condition: Column, what: str | Column = "n") -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(what) if isinstance(what, str) else what)), F.lit(0)).cast("long")

    laid = counted.select("*", F.explode(F.array(*steps)).alias("at")).select("*", "at.*")  # 600 steps, whatever the input
    return laid.groupBy("part", "filter_order", "step").agg(
        total(~gone & ~fails).alias("kept"),
        total(~gone & fails).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(bits == own).alias("unique_fails"),
        total(~gone & fails, "good").alias("good_lost"),
        total(~gone & fails, "toxic").alias("toxic_lost"),
        total(fails, F.col("n") * F.floor(share)).alias("shapley"),
    )
