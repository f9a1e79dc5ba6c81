"""Gaussian copulas of all classes at once.

Marginals are mergeable: one grouped aggregate gives the quantile grids and gaps of every class, another the category counts. The dependence of a class is
a matrix of sums of products of normal scores; rows of a class are dealt over as many tasks as its size asks for, each of which hands on one row per pair of
columns, and the sums are added up per class. New rows are made in chunks, each with the model of its class. So the number of jobs does not depend on the classes, nothing
is gathered on the driver but one row of facts about columns, and a class of any size spreads over all tasks.

Column roles are those of all growing classes together. Classes are told apart by a 64-bit hash of their text.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col, without_nan
from millrace.functions.ranking import running_sums
from millrace.operators.quality import as_number
from millrace.operators.synth import BUCKETS, MAX_DECIMALS, Copula, _typed, _unit, detect_roles
from millrace.operators.trees import scrambled
from millrace.session import cut_lineage

GRID = 200
CHUNK = 50_000  # rows of a class that meet in a task, learnt from or made


def _scores() -> np.ndarray:
    p = np.linspace(0.0, 1.0, GRID + 1)
    p[0], p[-1] = 0.25 / GRID, 1 - 0.25 / GRID
    return np.array([NormalDist().inv_cdf(float(x)) for x in p])


def _shares(flat: DataFrame, labels: int) -> DataFrame:
    """``_no``, ``c``, ``value``, its part ``start`` to ``end`` of the unit interval, the score of its ``middle``, and ``buckets`` of the interval."""
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"l{i}").alias("value")) for i in range(labels)]))
    counts = flat.select("_no", entries.alias("e")).select("_no", "e.c", "e.value").where("value IS NOT NULL").groupBy("_no", "c", "value").agg(F.count("*").alias("n"))
    counts = counts.withColumn("group", F.concat_ws(":", F.hex("_no"), "c"))
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"), F.greatest(F.count("*"), F.lit(BUCKETS)).alias("buckets"))
    ordered = counts.withColumn("place", F.struct((-F.col("n")).alias("fewer"), "value"))
    ends = running_sums(ordered, "place", ["n"], "group").join(totals, "group")
    parts = ends.select("_no", "c", "value", ((F.col("cum_n") - F.col("n")) / F.col("total")).alias("start"), (F.col("cum_n") / F.col("total")).alias("end"), "buckets")

    def with_middle(batches):
        for batch in batches:
            middle = ((batch["start"] + batch["end"]) / 2).clip(1e-9, 1 - 1e-9)
            yield batch.assign(middle=[NormalDist().inv_cdf(p) for p in middle])

    return cut_lineage(parts.mapInPandas(with_middle, "_no long, c int, value string, start double, end double, buckets long, middle double"))


def _products(scored: DataFrame, margins: DataFrame, numbers: int, k: int) -> DataFrame:
    """Per class and pair of columns the sums that a correlation needs, over rows that have both."""
    z = _scores()

    def work(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or model.empty:
            return pd.DataFrame({c: [] for c in ("_no", "i", "j", "n", "x", "y", "xx", "yy", "xy")})
        values = rows[[f"z{i}" for i in range(k)]].to_numpy(float)
        for i in range(numbers):
            grid = model[f"q{i}"].iloc[0]
            if grid is None:
                values[:, i] = np.nan
                continue
            points, at = np.unique(np.array(grid, float), return_inverse=True)
            means = np.bincount(at, weights=z) / np.bincount(at)
            values[:, i] = np.where(np.isnan(values[:, i]), np.nan, np.interp(values[:, i], points, means))
        there = (~np.isnan(values)).astype(float)
        values = np.nan_to_num(values)
        i, j = np.triu_indices(k, 1)
        one, two = values.T @ there, (values * values).T @ there
        sums = {"n": (there.T @ there)[i, j], "x": one[i, j], "y": one[j, i], "xx": two[i, j], "yy": two[j, i], "xy": (values.T @ values)[i, j]}
        return pd.DataFrame({"_no": model["_no"].iloc[0], "i": i, "j": j, **sums})

    spread = margins.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    kinds = "_no long, i int, j int, n double, x double, y double, xx double, yy double, xy double"
    pairs = scored.groupBy("_no", "salt").cogroup(spread.groupBy("_no", "salt")).applyInPandas(work, kinds)
    return pairs.groupBy("_no", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])


def _with_factor(models: DataFrame, k: int) -> DataFrame:
    """``factor``: the Cholesky factor of the correlations of each class, row by row."""

    def work(batches):
        for batch in batches:
            factors = []
            for pairs in batch["pairs"]:
                matrix = np.eye(k)
                for p in pairs if pairs is not None else ():
                    sx, sy = p["xx"] * p["n"] - p["x"] ** 2, p["yy"] * p["n"] - p["y"] ** 2
                    if p["n"] > 1 and sx > 1e-9 and sy > 1e-9:
                        matrix[p["i"], p["j"]] = matrix[p["j"], p["i"]] = np.clip((p["xy"] * p["n"] - p["x"] * p["y"]) / np.sqrt(sx * sy), -1, 1)
                values, vectors = np.linalg.eigh(matrix)  # pairwise correlations need not be consistent; lift negative eigenvalues
                matrix = vectors @ np.diag(np.maximum(values, 1e-9)) @ vectors.T
                scale = np.sqrt(np.diag(matrix))
                factors.append(np.linalg.cholesky(matrix / np.outer(scale, scale)).ravel().tolist())
            yield batch.drop(columns=["pairs"]).assign(factor=factors)

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in models.schema.fields if f.name != "pairs"]
    return models.mapInPandas(work, ", ".join([*kept, "factor array<double>"]))


def synthesize_classes(df: DataFrame, class_column: str, plan: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """``added`` new rows for every class of ``plan`` (``class``, ``original``, ``added``), like its rows in marginals and dependence.

    A whole-number key goes on behind the largest one, so that no key repeats. A class that is to grow needs two rows.
    """
    number = F.xxhash64(F.col("class").cast("string"))
    plan = plan.where("added > 0").select("class", "original", "added", number.alias("_no"), F.ceil(F.col("original") / CHUNK).cast("int").alias("parts"))
    if not plan.where("original < 2").isEmpty():
        raise ValueError("a class needs at least two rows to learn from")
    offsets = running_sums(plan, "_no", ["added"])
    plan = cut_lineage(offsets.select("class", "_no", "parts", "added", (F.col("cum_added") - F.col("added")).alias("offset")))

    clean = without_nan(df)
    rows = clean.withColumn("_no", F.xxhash64(col(class_column).cast("string"))).join(plan.select("_no", "parts"), "_no")
    columns = [c for c in df.columns if c != class_column]
    roles = detect_roles(rows.select(*[col(c) for c in columns]))
    numbers = [c for c in columns if roles[c] in ("numerical", "datetime")]
    labels = [c for c in columns if roles[c] == "categorical"]
    k = len(numbers) + len(labels)
    salt = F.pmod(F.xxhash64(*[col(c) for c in key]), F.col("parts"))
    flat = cut_lineage(
        rows.select(
            "_no", "parts", salt.cast("int").alias("salt"), *[as_number(clean, c).alias(f"z{i}") for i, c in enumerate(numbers)], *[col(c).cast("string").alias(f"l{i}") for i, c in enumerate(labels)]
        )
    )

    probs = [float(p) for p in np.linspace(0, 1, GRID + 1)]
    aggs = [F.count("*").alias("rows"), F.first("parts").alias("parts")]
    for i in range(len(numbers)):
        x = F.col(f"z{i}")
        grid = F.percentile_approx(x, probs, 10 * GRID)
        aggs += [F.concat(F.array(F.min(x)), F.slice(grid, 2, GRID - 1), F.array(F.max(x))).alias(f"q{i}"), F.count(x).alias(f"n{i}")]
        aggs += [F.count_if(x != F.round(x, d)).alias(f"d{i}_{d}") for d in range(MAX_DECIMALS + 1)]
    aggs += [F.count(f"l{i}").alias(f"n{len(numbers) + i}") for i in range(len(labels))]
    margins = cut_lineage(flat.groupBy("_no").agg(*aggs))
    odd = [f"d{i}_{d}" for i in range(len(numbers)) for d in range(MAX_DECIMALS + 1)]
    facts = margins.agg(*[F.sum(c).alias(c) for c in odd], F.count("*").alias("classes")).first()  # one row
    decimals = {c: next((d for d in range(MAX_DECIMALS + 1) if facts[f"d{i}_{d}"] == 0), None) for i, c in enumerate(numbers)}

    shares = _shares(flat, len(labels)) if labels else None
    models = margins.drop(*odd)
    if k > 1:
        scored = flat
        for i in range(len(labels)):
            own = shares.where(F.col("c") == i).select("_no", F.col("value").alias(f"l{i}"), F.col("middle").alias(f"z{len(numbers) + i}"))
            scored = scored.join(own, ["_no", f"l{i}"], "left")
        pairs = _products(scored.drop("parts", *[f"l{i}" for i in range(len(labels))]), models, len(numbers), k)
        gathered = pairs.groupBy("_no").agg(F.collect_list(F.struct("i", "j", "n", "x", "y", "xx", "yy", "xy")).alias("pairs"))  # one entry per pair of columns
        models = _with_factor(models.join(gathered, "_no", "left"), k)
    else:
        models = models.withColumn("factor", F.array(*[F.lit(1.0)] * k))
    for i in range(len(labels)):
        models = models.join(shares.where(F.col("c") == i).groupBy("_no").agg(F.first("buckets").alias(f"b{i}")), "_no", "left")

    chunks = plan.select("_no", F.col("class").cast("string").alias("_class"), "offset", "added", F.explode(F.sequence(F.lit(0), F.floor((F.col("added") - 1) / CHUNK).cast("int"))).alias("chunk"))
    laid = chunks.join(models.drop("parts"), "_no")
    z = _scores()

    def make(batches):
        for batch in batches:
            for r in batch.to_dict("records"):
                first = r["chunk"] * CHUNK
                i = np.arange(first, min(first + CHUNK, r["added"]), dtype=np.int64)
                hashed = i.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64((int(r["_no"]) + seed) % (1 << 64))
                factor = np.array(r["factor"]).reshape(k, k) if k else np.empty((0, 0))
                drawn = [np.sqrt(-2 * np.log(np.maximum(scrambled(hashed, 3 * j), 2.0**-54))) * np.cos(2 * np.pi * scrambled(hashed, 3 * j + 1)) for j in range(k)]
                mixed = np.stack(drawn, axis=1) @ factor.T if k else np.empty((len(i), 0))
                out = {"_no": r["_no"], "_class": r["_class"], "id": r["offset"] + i}
                for j in range(k):
                    here = scrambled(hashed, 3 * j + 2) < r[f"n{j}"] / r["rows"]
                    if j < len(numbers):
                        made = np.full(len(i), np.nan) if r[f"q{j}"] is None or r[f"n{j}"] == 0 else np.interp(mixed[:, j], z, np.array(r[f"q{j}"], float))
                    else:
                        made = _unit(mixed[:, j])
                        buckets = r[f"b{j - len(numbers)}"]
                        out[f"b{j}"] = np.where(here, np.floor(made * (1 if pd.isna(buckets) else buckets)), -1).astype(np.int64)
                    out[f"v{j}"] = np.where(here, made, np.nan)
                yield pd.DataFrame(out)

    made_kinds = ["_no long", "_class string", "id long", *[f"v{j} double" for j in range(k)], *[f"b{j} long" for j in range(len(numbers), k)]]
    values = laid.mapInPandas(lambda batches: (b[[c.split()[0] for c in made_kinds]] for b in make(batches)), ", ".join(made_kinds))
    for j in range(len(numbers), k):
        own = shares.where(F.col("c") == j - len(numbers))
        low, high = F.floor(F.col("start") * F.col("buckets")), F.least(F.floor(F.col("end") * F.col("buckets")), F.col("buckets") - 1)
        parts = own.select(F.col("_no").alias("_own"), "start", "end", "value", F.explode(F.sequence(low, high)).alias("_bucket"))
        inside = (F.col("_no") == F.col("_own")) & (F.col(f"b{j}") == F.col("_bucket")) & (F.col(f"v{j}") >= F.col("start")) & (F.col(f"v{j}") < F.col("end"))
        values = values.join(parts, inside, "left").withColumn(f"v{j}", F.col("value")).drop("_own", "start", "end", "value", "_bucket")
    for j in range(len(numbers)):
        values = values.withColumn(f"v{j}", F.when(~F.isnan(f"v{j}"), F.col(f"v{j}")))

    fitted = Copula(columns, {f.name: f.dataType for f in df.schema.fields}, roles, dict.fromkeys(numbers, []), dict.fromkeys(labels), {}, decimals, [])
    whole = [c for c in key if c in columns and roles[c] == "id" and df.schema[c].dataType.simpleString() in ("int", "bigint")]
    last = dict(zip(whole, df.agg(*[F.max(col(c)) for c in whole]).first())) if whole else {}
    at = {c: j for j, c in enumerate([*numbers, *labels])}
    made = {c: _typed(fitted, c, at.get(c), last.get(c, -1) + 1) for c in columns}
    made[class_column] = F.col("_class").cast(df.schema[class_column].dataType)
    return values.select(*[made[c].alias(c) for c in df.columns])
