"""Seeded order of rows, exact-size draws and running sums without a one-task window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.functions.quantiles import uniform_ranks
from millrace.session import cut_lineage

HASH_HEX = 13
HASH_BITS = 4 * HASH_HEX  # exact in a double
HASH_TOP = 1 << HASH_BITS
CLASSES_PER_PASS = 64
WINDOW_ROWS = 500_000


def seeded_hash(seed: int, *parts: Column | str) -> Column:
    """A number in ``[0, 2**52)`` fixed by seed and key, whatever the partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_HEX), 16, 10).cast("long")


@dataclass(frozen=True)
class Cut:
    """Selects the first rows in (hash, key) order."""

    hash_at: int | None
    key_at: tuple | None = None

    def takes(self, hashed: Column, keys: list[str]) -> Column:
        if self.hash_at is None:
            return F.lit(False)
        if self.key_at is None:
            return hashed <= self.hash_at
        last = F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, self.key_at)])
        mine = F.struct(*[col(k).alias(k) for k in keys])
        return (hashed < self.hash_at) | ((hashed == self.hash_at) & (mine <= last))


def first_rows(
    df: DataFrame, keys: list[str], seed: int, groups: dict[str, tuple[Column, int, list[int]]]
) -> dict[str, list[Cut]]:
    """Cuts that take exactly the first ``m`` rows of each group in seeded order.

    ``groups`` maps a label to (row predicate, row count, list of ``m``). Only the key and
    the predicate columns are read and only counts are shuffled, so a group may hold any
    share of the table.
    """
    hashed = seeded_hash(seed, *keys)
    cuts: dict[str, list[Cut]] = {}
    labels = list(groups)
    hashes = df.withColumn("_hash", hashed.cast("double"))
    for start in range(0, len(labels), CLASSES_PER_PASS):
        part = labels[start : start + CLASSES_PER_PASS]
        items = {g: F.when(groups[g][0], F.col("_hash")) for g in part}
        sizes = {g: groups[g][1] for g in part}
        ranks = {g: [min(m, sizes[g]) - 1 for m in groups[g][2] if m > 0 and sizes[g]] for g in part}
        found = uniform_ranks(hashes, items, sizes, ranks, HASH_TOP)
        for g in part:
            cuts[g] = [
                _cut(df, keys, hashed, groups[g][0], found[g][min(m, sizes[g]) - 1], min(m, sizes[g]))
                if m > 0 and sizes[g]
                else Cut(None)
                for m in groups[g][2]
            ]
    return cuts


def _cut(df, keys, hashed, predicate, rank, wanted) -> Cut:
    at = int(rank.value)
    spare = rank.below + rank.equal - wanted
    if spare == 0:
        return Cut(at)
    tied = (
        df.where(predicate & (hashed == at))
        .select(*[col(k) for k in keys])
        .orderBy(*[col(k) for k in keys])
        .limit(wanted - rank.below + 1)
        .collect()
    )
    if tied[-1] == tied[-2]:
        raise ValueError(f"key columns {keys} do not identify rows: {tied[-1]} repeats")
    return Cut(at, tuple(tied[-2]))


def exact_sample(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows without replacement, as a filter; all rows if there are fewer."""
    total = df.count()
    if total <= n:
        return df
    cut = first_rows(df, keys, seed, {"all": (F.lit(True), total, [n])})["all"][0]
    return df.where(cut.takes(seeded_hash(seed, *keys), keys))


def numbered(df: DataFrame, group: str, keys: list[str], seed: int, largest: int, name: str = "row_no") -> DataFrame:
    """Number the rows of each group 1..n in seeded order.

    Large groups are cut into equal slices of the hash range; each slice is numbered on
    its own and shifted by the rows in the slices before it.
    """
    hashed = seeded_hash(seed, *keys)
    order = [F.col("_hash"), *[col(k) for k in keys]]
    slices = 1
    while largest / slices > WINDOW_ROWS:
        slices *= 2
    columns = df.columns
    df = df.withColumn("_hash", hashed)
    if slices == 1:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(col(group)).orderBy(*order)).cast("long")).drop("_hash")
    df = df.withColumn("_slice", F.floor(F.col("_hash") / F.lit(HASH_TOP // slices)).cast("long"))
    sizes = df.groupBy(col(group).alias("_group"), F.col("_slice").alias("_of_slice")).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_of_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_group", "_of_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy(col(group), "_slice").orderBy(*order))
    numbers = (F.col("_local").cast("long") + F.col("_shift")).alias(name)  # the caller's name may be any, so no helper is dropped by name after it
    return (
        df.withColumn("_local", local)
        .join(sizes, F.col("_slice").eqNullSafe(F.col("_of_slice")) & col(group).eqNullSafe(F.col("_group")))
        .select(*[col(c) for c in columns], numbers)
    )


def running_sums(
    df: DataFrame, order: str, sums: list[str], group: str | None = None, descending: bool = False
) -> DataFrame:
    """Add ``cum_<c>``, the running total of every ``c`` along ``order`` (per ``group``).

    ``order`` must be unique within a group (aggregate first). Rows are range-partitioned
    and fixed in shared storage, each range is summed in its own task, and the totals of
    the ranges before it (one row per range and group) are added.
    """
    spark = df.sparkSession
    along = F.col(order).desc() if descending else F.col(order).asc()
    by = [group] if group else []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(parts, *[F.col(g) for g in by], along).withColumn("_range", F.spark_partition_id())
    )
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums]
    )
    inner = Window.partitionBy(*by, "_range").orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(totals, [*by, "_range"])
        .select("*", *[(F.sum(c).over(inner) + F.col(f"_b_{c}")).alias(f"cum_{c}") for c in sums])
        .drop("_range", *[f"_b_{c}" for c in sums])
    )
