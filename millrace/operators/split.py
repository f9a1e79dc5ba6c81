"""Train/test splits and folds of exact size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, col, is_number
from millrace.functions.ranking import CLASSES_PER_PASS, HASH_TOP, WINDOW_ROWS, first_rows, running_sums, seeded_hash
from millrace.session import cut_lineage


def largest_remainder(counts: dict, total: int) -> dict:
    """Share ``total`` out in proportion to ``counts``; leftovers go to the largest fractions, ties by text, null last."""
    rows = sum(counts.values())
    given = {c: n * total // rows for c, n in counts.items()}
    order = sorted(counts, key=lambda c: (-(counts[c] * total % rows), c is None, str(c)))
    for c in order[: total - sum(given.values())]:
        given[c] += 1
    return given


def class_rows(df: DataFrame, by: str) -> DataFrame:
    """``(class, rows)`` of every class, null included, fixed as a table."""
    return cut_lineage(df.groupBy(col(by).alias("class")).agg(F.count("*").alias("rows")))


def largest_remainders(classes: DataFrame, total: int) -> DataFrame:
    """``largest_remainder`` for any number of classes: ``(class, rows)`` with ``given`` added.

    Fractions are compared as whole remainders, and a class takes a leftover if its running count along them reaches so
    far; the classes stay in their tasks.
    """
    exact = F.col("rows").cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)")
    all_rows = classes.agg(F.sum("rows")).first()[0]
    shared = classes.withColumn("_exact", exact).withColumn("_all", F.lit(all_rows).cast("decimal(19,0)"))
    shared = shared.withColumn("_base", F.expr("_exact div _all")).withColumn("_over", F.expr("_exact % _all"))
    left = total - (shared.agg(F.sum("_base")).first()[0] or 0)
    text = F.col("class").cast("string")
    shared = shared.withColumn("_at", F.struct(-F.col("_over"), text.isNull(), text)).withColumn("one", F.lit(1))
    placed = running_sums(shared, "_at", ["one"])
    return placed.select("class", "rows", (F.col("_base") + (F.col("cum_one") <= left).cast("long")).alias("given"))


def assign_parts(
    df: DataFrame, key: list[str], seed: int, sizes: list[int], name: str, by: str | None = None,
    marks: DataFrame | None = None,
) -> DataFrame:
    """Add integer ``name``: which part a row falls in when its group is cut in seeded order.

    Without ``by``, ``sizes`` are the cumulative sizes of all parts but the last. With it, ``marks`` holds one row
    ``(class, rows, marks)`` per class, the cumulative sizes as an array. Few classes are cut by literal hash
    thresholds, so no row moves; with many, rows are ranked.
    """
    hashed = seeded_hash(seed, *key)

    def passed(cuts) -> Column:
        place = F.lit(0)
        for cut in cuts:
            place = place + (~cut.takes(hashed, key)).cast("int")
        return place

    if by is None:
        total = df.count()
        cuts = first_rows(df, key, seed, {"all": (F.lit(True), total, sizes)})["all"]
        return df.withColumn(name, passed(cuts))

    few = marks.limit(CLASSES_PER_PASS + 1).collect()
    if len(few) > CLASSES_PER_PASS:
        return _ranked_parts(df, key, hashed, name, by, marks)
    groups = {
        str(i): (col(by).isNull() if r["class"] is None else col(by) == F.lit(r["class"]), r["rows"], r["marks"])
        for i, r in enumerate(few)
    }
    cuts = first_rows(df, key, seed, groups)
    place = F.lit(None).cast("int")
    for g, (mine, _, _) in groups.items():
        place = F.when(mine, passed(cuts[g])).otherwise(place)
    return df.withColumn(name, place)


def _ranked_parts(df: DataFrame, key: list[str], hashed: Column, name: str, by: str, marks: DataFrame) -> DataFrame:
    """Parts by rank within the class. A class of many rows is ranked in slices of its hash range, each a window of about
    ``WINDOW_ROWS`` rows, and the rows of the slices before are added; only such classes have rows in that table."""
    marks = marks.select(
        F.col("class").alias("_class"), F.col("marks").alias("_marks"), F.ceil(F.col("rows") / WINDOW_ROWS).alias("_slices")
    )
    placed = df.withColumn("_hash", hashed).join(marks, col(by).eqNullSafe(F.col("_class")))
    # the quotient of a power of two is exact, so the slices follow the order of the hash
    placed = placed.withColumn("_slice", F.floor(F.col("_hash") / F.lit(float(HASH_TOP)) * F.col("_slices")).cast("long"))
    rank = F.row_number().over(Window.partitionBy("_class", "_slice").orderBy("_hash", *[col(k) for k in key])).cast("long")
    if marks.where("_slices > 1").isEmpty():
        placed = placed.withColumn("_rank", rank)
    else:
        sizes = placed.where("_slices > 1").groupBy("_class", "_slice").agg(F.count("*").alias("_n"))
        before = Window.partitionBy("_class").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        shifts = cut_lineage(
            sizes.select(F.col("_class").alias("_of"), F.col("_slice").alias("_in"), F.sum("_n").over(before).alias("_shift"))
        )
        placed = placed.withColumn("_rank", rank).join(
            shifts, F.col("_class").eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_in")), "left"
        )
        placed = placed.withColumn("_rank", F.col("_rank") + F.coalesce("_shift", F.lit(0)))
    part = F.size(F.filter("_marks", lambda m: m < F.col("_rank")))
    return placed.select(*[col(c) for c in df.columns], part.alias(name))


def validate_target(df: DataFrame, target: str, test_size: float) -> int:
    """Check a supervised request and return the row count."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} does not exist")
    if not 0.0 < test_size < 1.0:
        raise ValueError(f"test_size must lie between 0 and 1, got {test_size}")
    value = as_double(df, target) if is_number(df.schema[target].dataType) else col(target)
    row = df.agg(F.count("*").alias("rows"), F.count(value).alias("present")).first()
    if row["rows"] == 0:
        raise ValueError("the frame is empty")
    if row["rows"] - max(1, int(row["rows"] * test_size)) < 1:
        raise ValueError(f"{row['rows']} rows are too few for test_size={test_size}")
    if row["present"] == 0:
        raise ValueError(f"target column {target!r} holds only missing values")
    return row["rows"]


def train_test_split(
    df: DataFrame, key: list[str], test_size: float = 0.2, seed: int = 42, stratify: str | None = None
) -> DataFrame:
    """Add ``split`` = ``train``/``test`` with exactly ``ceil(rows * test_size)`` test rows.

    A stratified split needs at least two classes of at least two rows, otherwise it falls back to the plain one. The
    class counts stay a table, whatever their number.
    """
    part = F.when(F.col("_part") == 0, "test").otherwise("train")
    if stratify:
        classes = class_rows(df, stratify)
        known = F.col("class").isNotNull()
        least = F.min(F.when(known, F.col("rows"))).alias("least")
        found = classes.agg(F.count("*").alias("all"), F.count("class").alias("n"), least, F.sum("rows").alias("rows")).first()
        if found["n"] >= 2 and found["least"] >= 2:
            wanted = math.ceil(found["rows"] * test_size)
            if found["all"] <= CLASSES_PER_PASS:
                rows = {r["class"]: r["rows"] for r in classes.collect()}
                given = largest_remainder(rows, wanted)
                schema = f"class {classes.schema['class'].dataType.simpleString()}, rows bigint, marks array<bigint>"
                marks = df.sparkSession.createDataFrame([(c, n, [given[c]]) for c, n in rows.items()], schema)
            else:
                marks = largest_remainders(classes, wanted).select("class", "rows", F.array("given").alias("marks"))
                marks = cut_lineage(marks)
            return assign_parts(df, key, seed, [], "_part", stratify, marks).withColumn("split", part).drop("_part")
    n_test = math.ceil(df.count() * test_size)
    return assign_parts(df, key, seed, [n_test], "_part").withColumn("split", part).drop("_part")


def assign_folds(df: DataFrame, key: list[str], folds: int, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """Add ``fold`` = 0..folds-1 of near-equal size, within each class when stratified."""
    if stratify is None:
        rows = df.count()
        return assign_parts(df, key, seed, [-(-rows * i // folds) for i in range(1, folds)], "fold")
    ends = [F.expr(f"(rows * {i} + {folds - 1}) div {folds}") for i in range(1, folds)]
    marks = class_rows(df, stratify).withColumn("marks", F.array(*ends).cast("array<bigint>"))
    return assign_parts(df, key, seed, [], "fold", stratify, marks)
