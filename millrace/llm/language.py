"""Language ID by nearest centroids of TF-IDF character n-grams.

A text becomes a vector of hashed character 2- and 3-grams with weight ``(1 + ln count) * idf``, scaled to length 1.
Each language has several centroids, found by spherical k-means over a bounded sample of its labelled rows. A text gets
the language of the centroid with the largest cosine. It is rejected if its distance ``1 - cosine`` is larger than the
centroid's radius. Short texts lie further from any centroid than long ones, so there is a radius for each class of length: the largest
distance of the sample's texts of that length, and of pieces of that length, times a slack. A class that fewer than ``FEW`` of the
sample's texts reach has no smaller radius than the class below it, where the texts lie further away.

Defined results: a null text and one without a letter are ``und`` with score 0 and rejected. Rows without a label are not
learned from; with nothing to learn from, every text is ``und``. Equal cosines go to the language that sorts first.
Repeated rows get equal results. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

UNKNOWN = "und"
ROWS = 128  # texts whose vectors are held at once
LENGTHS = np.array([16, 64, 256, 1024])  # upper ends of the classes of length, in characters; longer texts are the last
FEW = 20
FARTHEST = 0.999  # what shares next to nothing with a language is rejected at any length
SCORED = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]


@dataclass(frozen=True)
class LanguageModel:
    """What was learned. ``centroids[i]`` belongs to ``langs[i]``; its size depends on the languages, not on the rows."""

    langs: list[str]
    centroids: np.ndarray
    radius: np.ndarray  # by centroid and class of length
    idf: np.ndarray
    buckets: int


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def gram_counts(text: str | None, buckets: int) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of the whole lower-cased text; what is no letter counts as a blank."""
    text = (text or "").lower()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (codes >= 128) | ((codes >= 97) & (codes <= 122))
    codes = np.where(letter, codes, np.uint32(32))
    if len(codes):  # runs of blanks become one
        keep = np.ones(len(codes), bool)
        keep[1:] = letter[1:] | letter[:-1]
        codes = codes[keep]
    codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
    shift = np.uint32(32 - (buckets.bit_length() - 2))
    pair = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA6B)
    triple = pair[:-1] * np.uint32(0x27D4EB2F) + codes[2:] * np.uint32(0xC2B2AE35)
    half = buckets // 2
    low = np.bincount((pair ^ (pair >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, minlength=half)
    high = np.bincount((triple ^ (triple >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, minlength=half)
    return np.concatenate((low, high))


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None]


def vectors(texts: list[str | None], idf: np.ndarray, buckets: int) -> np.ndarray:
    x = np.zeros((len(texts), buckets), np.float32)
    for row, text in zip(x, texts):
        counts = gram_counts(text, buckets)
        at = np.flatnonzero(counts)
        row[at] = (1 + np.log(counts[at])) * idf[at]
    return unit_rows(x)


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means with farthest-first starts; returns the centroids."""
    chosen = [0]
    best = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[chosen[-1]])
    centres = x[chosen]
    at = np.zeros(len(x), int)
    for _ in range(rounds):
        at = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where((sums != 0).any(axis=1)[:, None], unit_rows(sums), centres)
    return centres


def sample(df: DataFrame, text: str, lang: str, key: str, where: Column | None, per_language: int) -> DataFrame | None:
    """About ``per_language`` labelled texts of each language (``lang``, ``text``), the same ones in every run; None without any.

    Those whose seeded hash of key and text lies under the language's share. Rows that agree in both are one, so neither ids that repeat
    or are null nor groups of copies let the sample of a language grow or vanish.
    """
    rows = df if where is None else df.where(where)
    drawn = F.xxhash64(F.lit(17), F.col(key).cast("string"), F.col(text)).alias("drawn")
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), drawn)
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("drawn").alias("n")).collect()}  # one row per language
    if not sizes:
        return None
    top = 1 << 30
    limits = F.create_map(*[F.lit(v) for g in sorted(sizes) for v in (g, int(top * min(1.0, per_language / sizes[g])))])
    taken = rows.where(F.pmod(F.col("drawn"), F.lit(top)) < limits[F.col("lang")])
    return taken.groupBy("lang", "drawn").agg(F.min("text").alias("text")).select("lang", "text")


def fit(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    where: Column | None = None,
    sample_per_language: int = 600,
    centroids: int = 4,
    buckets: int = 8192,
    slack: float = 1.05,
) -> LanguageModel:
    """Learn from labelled rows.

    ``sample_per_language`` bounds the labelled rows per language, see ``sample``. Vectors of one language meet in one task, which
    the bound makes small; only centroids, radii and the gram frequencies reach the driver.
    """
    taken = sample(df, text, lang, key, where, sample_per_language)
    if taken is None:
        return LanguageModel([], np.zeros((0, buckets), np.float32), np.zeros((0, 5)), np.ones(buckets, np.float32), buckets)
    counted = taken.select("text").mapInArrow(lambda batches: _seen(batches, buckets), "bucket int, seen long")
    seen = np.zeros(buckets + 1)
    for r in counted.groupBy("bucket").agg(F.sum("seen").alias("seen")).collect():  # one row per bucket
        seen[r["bucket"]] = r["seen"]
    seen, total = seen[:buckets], seen[buckets]
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(group["text"])
        centres = cluster(vectors(texts, idf, buckets), centroids)
        radius: list[float] = []
        random = np.random.default_rng(17)
        for low, high in zip([0, *LENGTHS], [*LENGTHS, 2 * LENGTHS[-1]]):
            long = [t for t in texts if len(t) > low]
            spans = [(t, int(random.integers(low + 1, min(high, len(t)) + 1))) for t in long for _ in range(2)]
            parts = [t[(start := int(random.integers(len(t) - n + 1))) : start + n] for t, n in spans]
            parts += [t for t in long if len(t) <= high or high > LENGTHS[-1]]
            y = vectors([p for p in parts if has_letter(p)], idf, buckets)
            own = [1 - (y @ centres.T).max(axis=1).min()] if len(y) else []
            radius.append(max(own + (radius[-1:] if len(long) < FEW else []), default=FARTHEST))
        radius = np.minimum(FARTHEST, slack * np.array(radius))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.tobytes() for c in centres], "radius": [radius] * len(centres)})

    learned = taken.groupBy("lang").applyInPandas(learn, "lang string, centre binary, radius array<double>").collect()
    learned = sorted(learned, key=lambda r: (r["lang"], bytes(r["centre"])))
    return LanguageModel(
        [r["lang"] for r in learned],
        np.stack([np.frombuffer(r["centre"], np.float32) for r in learned]),
        np.array([r["radius"] for r in learned]),
        idf,
        buckets,
    )


def _seen(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """For each bucket the number of texts with a gram in it, and last the number of texts, once per task."""
    seen = np.zeros(buckets + 1, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen[:buckets] += gram_counts(text, buckets) > 0
            seen[buckets] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], ["bucket", "seen"])


def identify(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected`` for every row, in one pass without a shuffle.

    ``lang_pred`` is the nearest language also where ``rejected`` says that nothing is near enough.
    """
    keep = keep if keep is not None else ["doc_id"]
    shared = df.sparkSession.sparkContext.broadcast(model)  # bound: languages x centroids x buckets floats
    out = [c for c in ("lang_pred", "score", "rejected") if c in keep]
    if out:
        raise ValueError(f"columns {out} would be made twice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            preds, scores, rejected = [], [], []
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for start in range(0, len(texts), ROWS):
                part = texts[start : start + ROWS]
                known = np.array([has_letter(t) for t in part]) & bool(m.langs)
                if m.langs:
                    near = vectors(part, m.idf, m.buckets) @ m.centroids.T
                    best = np.argmax(near, axis=1)
                    cosine = np.clip(near[np.arange(len(part)), best].astype(float), 0, 1)
                    far = 1 - cosine > m.radius[best, [np.searchsorted(LENGTHS, len(t or "")) for t in part]]
                else:
                    best, cosine, far = np.zeros(len(part), int), np.zeros(len(part)), np.ones(len(part), bool)
                preds += [m.langs[i] if ok else UNKNOWN for i, ok in zip(best, known)]
                scores += list(np.where(known, cosine, 0.0))
                rejected += list(far | ~known)
            made = [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*keep, "lang_pred", "score", "rejected"])

    rows = df.select(*keep, F.col(text).alias("_text"))
    kinds = StructType([*df.select(*keep).schema, *SCORED])
    return rows.mapInArrow(run, kinds)
