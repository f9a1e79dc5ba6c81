"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: a token total is shared among the sources by weight; no source gets more than ``repeats`` times its own size, and
   what it can't take is shared again among the others.
2. Every source's rows are laid end to end in a seeded order and cut into blocks of equal token number.
3. A schedule of slots, one block each, is drawn: slot ``i`` maps the golden-ratio point ``frac(i * 0.618...)`` through the
   cumulative targets to a source, so that every stretch of the schedule has the sources in proportion. The slots of a source
   are ranked, the ``r``-th slot takes the source's ``r``-th block and starts over behind its last one. Slots behind a source's target are left
   out, missing ones follow at the end, and the last slot takes the rest of the target.
4. Slots and blocks meet in a join on (source, block).

Sources are told apart by their own value, null included (last in order). One row per source reaches the driver; rows, blocks and slots stay
distributed, and no step puts a source into one task. The seeded order makes reruns agree.

Defined results: null and word-free texts have size 0 and are never taken; a source of size 0 has target 0. Repeated rows count each on
their own. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.ranking import running, with_slices
from millrace.session import cut_lineage

BLOCK = 1024  # tokens, at most
FINEST = 1 << 20  # slots up to which blocks are made smaller for the sake of small sources
PERIOD = 1 << 31
GOLDEN = 1_327_217_885  # the odd number nearest to PERIOD * 0.6180339887
RANGE = 1 << 16  # slots ranked together
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Source:
    """``number`` in order; ``target`` in tokens."""

    name: str | None
    number: int
    size: int
    target: float


def targets(sizes: dict[str | None, int], weights: list[float], share: float, repeats: float) -> list[Source]:
    """Targets of the sources, which weigh ``weights`` in turn by code point order, null last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = [float(weights[i % len(weights)]) for i in range(len(names))]
    cap = [float(repeats * sizes[s]) for s in names]
    left = min(share * sum(sizes.values()), sum(cap))
    target = [0.0] * len(names)
    free = set(range(len(names)))
    while free:
        total = sum(weight[i] for i in free)
        each = {i: left * weight[i] / total for i in free}
        full = [i for i in free if each[i] >= cap[i]]
        for i in full:
            target[i] = cap[i]
            left -= cap[i]
            free.remove(i)
        if not full:
            for i in free:
                target[i] = each[i]
            break
    return [Source(s, i, sizes[s], target[i]) for i, s in enumerate(names)]


def schedule(df: DataFrame, sources: list[Source], block: int) -> DataFrame:
    """``slot``, ``number`` (of the source), ``block`` (of the source) and ``tokens`` (what the slot takes of the block, from its start on)."""
    spark = df.sparkSession
    want = np.array([round(s.target) for s in sources], np.int64)
    sizes = np.array([s.size for s in sources], np.int64)
    slots = int(-(-want.sum() // block))
    ends = np.floor(np.cumsum(want) / want.sum() * PERIOD).astype(np.int64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_numpy()
            number = np.minimum(np.searchsorted(ends, i % PERIOD * GOLDEN % PERIOD, "right"), len(ends) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32())], ["slot", "number"])

    drawn = spark.range(slots).mapInArrow(draw, "slot long, number int")
    drawn = drawn.withColumn("_slice", F.floor(F.col("slot") / RANGE).cast("long"))
    ranked = running(drawn, ["number"], F.lit(1), [F.col("slot")], "rank")
    taken = {r["number"]: r["n"] for r in drawn.groupBy("number").agg(F.count("*").alias("n")).collect()}  # one row per source
    # a source whose last slots are missing gets them at the end of the schedule
    needed = [int(w // n * -(-n // block) + -(-(w % n) // block)) if w else 0 for w, n in zip(want, sizes)]
    short = [(i, taken.get(i, 0), needed[i]) for i in range(len(sources)) if want[i]]
    short = spark.createDataFrame([s for s in short if s[1] < s[2]], "number int, have long, need long")
    tail = short.select("number", F.explode(F.sequence("have", F.col("need") - 1)).alias("rank"))
    tail = tail.select((F.col("rank") + F.lit(slots)).alias("slot"), "number", "rank")
    bounds = [(s.number, int(want[i]), int(sizes[i])) for i, s in enumerate(sources) if want[i]]
    bounds = spark.createDataFrame(bounds, "number int, want long, size long")
    all_slots = ranked.select("slot", "number", "rank").union(tail).join(F.broadcast(bounds), "number")  # one row per source
    # the r-th slot takes the r-th block of a round; the last block of a round is shorter, so places are counted in whole rounds
    per_round = F.ceil(F.col("size") / block)
    nth = F.floor(F.col("rank") / per_round)
    at = F.col("rank") % per_round
    begins = nth * F.col("size") + at * block
    tokens = F.least(F.lit(block), F.col("size") - at * block, F.col("want") - begins)
    return all_slots.select("slot", "number", at.cast("long").alias("block"), tokens.cast("long").alias("tokens")).where("tokens > 0")


def mix(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    repeats: float = 2,
    block: int = BLOCK,
    seed: int = 17,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns (the key by default), ``size``, ``source_size``, ``target`` and ``taken`` of every row.

    Sizes are fixed in shared storage while the result is being built.
    """
    keep = keep if keep is not None else [key]
    clash = {"size", "source_size", "target", "taken"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be made twice")
    rows = df.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
        F.col(source).cast("string").alias("_source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("_order"),
        F.col(key).alias("_key"),
    )
    rows = cut_lineage(rows)
    found = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).collect()  # one row per source
    sources = targets({r["_source"]: r["size"] for r in found}, list(weights), share, repeats)
    goal = sum(s.target for s in sources)
    facts = {"size": "_size", "source_size": "_whole", "target": "_target"}
    shown = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)] + [F.col(v).alias(k) for k, v in facts.items()]
    known = df.sparkSession.createDataFrame(
        [(s.name, s.number, s.size, s.target) for s in sources], "_name string, _number int, _whole long, _target double"
    )
    rows = rows.join(F.broadcast(known), F.col("_source").eqNullSafe(F.col("_name")))  # one row per source
    nothing = F.lit(0).cast("long").alias("taken")
    if not goal:
        return rows.select(*shown, nothing)
    least = min(s.target for s in sources if s.target)
    block = max(1, min(block, max(int(goal) // FINEST, int(least) // 32)))
    slots = schedule(df, sources, block)
    slots = slots.groupBy("number", "block").agg(F.collect_list("tokens").alias("tokens"))  # at most one per round of the source
    laid = with_slices(rows.where("_size > 0"), sum(r["n"] for r in found), F.col("_order"))
    laid = running(laid, ["_number"], F.col("_size"), [F.col("_order"), F.col("_key"), F.col("_size")], "_start")
    last = F.floor((F.col("_start") + F.col("_size") - 1) / block)
    cut = laid.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / block), last)))
    low = F.greatest(F.col("_start") - F.col("_block") * block, F.lit(0))
    high = F.least(F.col("_start") + F.col("_size") - F.col("_block") * block, F.lit(block))
    met = cut.select("*", low.alias("_low"), high.alias("_high")).join(
        slots, (F.col("_number") == F.col("number")) & (F.col("_block") == F.col("block")), "left"
    )
    part = F.aggregate(
        F.coalesce("tokens", F.array().cast("array<bigint>")),
        F.lit(0).cast("long"),
        lambda total, tokens: total + F.greatest(F.least("_high", tokens) - F.col("_low"), F.lit(0)),
    )
    kept = [f"_k{i}" for i in range(len(keep))]
    by_row = ["_number", "_start", "_size", "_whole", "_target", *kept]
    whole = met.withColumn("_part", part).groupBy(*by_row).agg(F.sum("_part").alias("taken"))
    return whole.select(*shown, "taken").union(rows.where("_size = 0").select(*shown, nothing))
