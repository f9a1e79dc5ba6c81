"""Vectors in shards, queries in blocks, and every shard meeting every block in a task of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage

SHARD_ROWS = 16_384
BLOCK_QUERIES = 512
HITS = "query_id long, vec_id long, score {}"


def usable(df: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part.

    Null keys, null or empty vectors and those with a null or non-finite component do not, nor, unless ``zero``, those that
    are zero throughout.
    """
    whole = F.col(vector).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(key).cast("long").alias("id"), whole.alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vector") > 0) & finite)
    return rows if zero else rows.where(F.exists("vector", lambda x: x != 0))


def unpack(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group in id order; a repeated id counts once, with the vector that sorts first."""
    ids, x = group["id"].to_numpy(np.int64), np.stack(group["vector"].to_list()).astype(float)
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], x[first]


def lengths(rows: DataFrame, is_query: Column) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """``rows`` with each id once, and the numbers of rows and queries by vector length.

    With one length ``unpack`` sees to repeated ids; an id with several lengths keeps the vector that sorts first.
    """

    def count(rows: DataFrame) -> dict[int, tuple[int, int]]:
        found = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries"))
        return {r["dim"]: (r["n"], r["queries"]) for r in found.collect()}

    sizes = count(rows)
    if len(sizes) > 1:
        rows = cut_lineage(rows.groupBy("id").agg(F.min("vector").alias("vector")))
        sizes = count(rows)
    return rows, sizes


def search(
    rows: DataFrame,
    sizes: dict[int, tuple[int, int]],
    is_query: Column,
    build: Callable[[np.ndarray, np.ndarray], dict[str, bytes]],
    fields: list[str],
    find: Callable[[dict[str, bytes], np.ndarray, np.ndarray], pd.DataFrame],
    k: int,
    nearest: bool,
    kind: str,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` best rows of every query.

    ``build`` makes the index of one shard, ``find`` looks a block of queries up in it and returns at most ``k`` rows (``HITS``,
    with scores of type ``kind``) a query. ``rows`` and ``sizes`` are those of ``lengths``; queries meet the vectors of their own length. A shard and a block hold a
    fixed number of rows, by a hash of the id, so that copies of a vector spread; what is shuffled is one packed row per shard and block.
    """
    sizes = {dim: n for dim, n in sizes.items() if n[1]}
    if not sizes:
        rows, sizes = rows.where(F.lit(False)), {0: (0, 0)}

    def by_length(at: int, rows: int) -> Column:
        return F.create_map(*[F.lit(v) for dim, n in sizes.items() for v in (dim, max(1, -(-n[at] // rows)))])[F.col("dim")]

    shards, blocks = by_length(0, shard_rows), by_length(1, block_queries)
    rows = rows.withColumn("dim", F.size("vector")).where(F.col("dim").isin(list(sizes)))
    packed = ", ".join(f"{f} binary" for f in fields)

    def index(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"dim": group["dim"].iloc[0], "shard": group["shard"].iloc[0], **build(*unpack(group))}])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        ids, x = unpack(group)
        return pd.DataFrame([{"dim": group["dim"].iloc[0], "block": group["block"].iloc[0], "ids": ids.tobytes(), "vectors": x.tobytes()}])

    def meet(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids = np.frombuffer(block["ids"].iloc[0], np.int64)
        x = np.frombuffer(block["vectors"].iloc[0]).reshape(len(ids), -1)
        return find({f: shard[f].iloc[0] for f in fields}, ids, x)

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("id"), shards).cast("int"))
    indexes = sharded.groupBy("dim", "shard").applyInPandas(index, f"dim int, shard int, {packed}")
    indexes = indexes.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    asked = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), blocks).cast("int"))
    asked = asked.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, ids binary, vectors binary")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    pairs = indexes.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block"))
    best = F.col("score").asc() if nearest else F.col("score").desc()
    window = Window.partitionBy("query_id").orderBy(best, F.col("vec_id"))
    ranked = pairs.applyInPandas(meet, HITS.format(kind)).withColumn("rank", F.row_number().over(window))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def hits(queries: list[int], found: list[np.ndarray], scores: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "query_id": np.repeat(np.array(queries, np.int64), [len(f) for f in found]),
            "vec_id": np.concatenate([np.empty(0, np.int64), *found]),
            "score": np.concatenate([np.empty(0), *scores]),
        }
    )
