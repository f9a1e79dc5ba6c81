"""Best-fit packing of token sequences by bin completion over size classes.

Texts become ids, one closing id is added, and only what is longer than a sequence is cut: full pieces from the end, so that
the first piece may be shorter. Whole sequences need no packing. For the others only the number of pieces of each length
matters, and there are at most ``capacity`` lengths whatever the corpus. On these counts a branch-and-bound search runs:

* best-fit decreasing gives the first incumbent;
* a node takes the largest remaining length and enumerates its undominated fillings (no filling that fits can be had by
  swapping parts for a larger one), smallest waste first; a filling is used as often as the counts allow;
* a branch is left as soon as its waste exceeds what would still beat the incumbent, and the search ends when the incumbent
  meets the lower bound.

The result is a list of patterns with how often each is used. Pieces of a length are numbered in slices and take the places of their
length in pattern order, so nothing but the counts is gathered anywhere.

Defined results: a null or empty text is the closing id alone. Repeated rows are packed each on its own. Only the named
columns are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.ranking import running, with_slices
from millrace.llm.tokenids import encoder
from millrace.session import cut_lineage

NODES = 12_000  # nodes of the search; what it has found by then stands
FILLINGS = 12  # fillings tried at a node
STEPS = 400  # steps of the enumeration at a node


@dataclass(frozen=True)
class Pattern:
    """``sizes`` lie one after the other in each of ``times`` sequences."""

    sizes: tuple[int, ...]
    times: int


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over classes: bins with equal contents are handled together."""
    bins: dict[tuple[int, ...], int] = {}
    by_room: dict[int, list[tuple[int, ...]]] = {}
    rooms: list[int] = []

    def put(content: tuple[int, ...], times: int) -> None:
        room = capacity - sum(content)
        if content not in bins:
            by_room.setdefault(room, []).append(content)
            if len(by_room[room]) == 1:
                bisect.insort(rooms, room)
        bins[content] = bins.get(content, 0) + times

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                if left >= each:
                    put((size,) * each, left // each)
                    left %= each
                if left:
                    put((size,) * left, 1)
                    left = 0
                continue
            room = rooms[at]
            content = by_room[room][-1]
            each = min(room // size, left)
            times = min(bins[content], left // each)
            left -= each * times
            bins[content] -= times
            if not bins[content]:
                del bins[content]
                by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            put(content + (size,) * each, times)
    return [Pattern(c, t) for c, t in bins.items()]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The largest Martello-Toth bound: what is too large to share with pieces of ``k`` or more stands alone."""
    n = np.zeros(capacity + 2, np.int64)
    n[list(counts)] = list(counts.values())
    pieces = np.concatenate((np.cumsum(n[::-1])[::-1], [0]))  # of at least a size
    tokens = np.concatenate((np.cumsum((n * np.arange(capacity + 2))[::-1])[::-1], [0]))
    half = capacity // 2
    best = 0
    for k in range(half + 1):
        alone = pieces[capacity - k + 1]
        large = pieces[half + 1] - alone
        room = large * capacity - (tokens[half + 1] - tokens[capacity - k + 1])
        over = tokens[k] - tokens[half + 1] - room
        best = max(best, alone + large + max(0, -(-over // capacity)))
    return int(best)


def fillings(sizes: list[int], counts: dict[int, int], room: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, smallest waste first, then those with the largest parts.

    Fillings without waste of up to three parts are looked up; they dominate all others. If there are none, the fullest of
    any number of parts follow, of which none has a part that could give way to a larger one.
    """
    fit = sizes[: bisect.bisect_right(sizes, room)][::-1]
    found: list[tuple[int, ...]] = []

    def has(*parts: int) -> bool:
        return all(counts.get(p, 0) >= parts.count(p) for p in parts)

    if has(room):
        found.append((room,))
    for a in fit:
        if 2 * a < room or len(found) >= FILLINGS:
            break
        if a < room and has(a, room - a):
            found.append((a, room - a))
    steps = 0
    for a in fit:
        if 3 * a < room or len(found) >= FILLINGS or steps > STEPS:
            break
        for b in sizes[: bisect.bisect_right(sizes, min(a, room - a - 1))][::-1]:
            steps += 1
            if 2 * b < room - a or len(found) >= FILLINGS or steps > STEPS:
                break
            if has(a, b, room - a - b):
                found.append((a, b, room - a - b))
    return found or fullest(sizes, counts, room)


def fullest(sizes: list[int], counts: dict[int, int], room: int) -> list[tuple[int, ...]]:
    """Fillings of any number of parts that leave the least of ``room``, from the sums that can be reached.

    Bit ``t`` of a number says that sum ``t`` can be reached. A smaller sum, or the same with a smaller largest part, follows.
    """
    parts = [s for s in sizes if s <= room for _ in range(min(counts[s], room // s))]
    reached = [1]
    within = (1 << (room + 1)) - 1
    for part in parts:
        reached.append((reached[-1] | reached[-1] << part) & within)
    found: list[tuple[int, ...]] = []
    top, target = len(parts), reached[-1].bit_length() - 1
    while len(found) < FILLINGS // 3 and target > 0:
        left, at, chosen = target, top, []
        while left:
            at -= 1
            # the largest part without which the rest cannot be reached, or that leads to a reachable rest
            if left >= parts[at] and reached[at] >> (left - parts[at]) & 1:
                chosen.append(parts[at])
                left -= parts[at]
        found.append(tuple(chosen))
        top = bisect.bisect_left(parts, chosen[0])
        if not reached[top] >> target & 1:
            top, rest = len(parts), reached[-1] & ((1 << target) - 1)
            target = rest.bit_length() - 1
    return found or [()]


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[Pattern]:
    """The fewest sequences found for pieces given by ``counts`` per size, as patterns."""
    counts = {s: c for s, c in counts.items() if c}
    total = sum(s * c for s, c in counts.items())
    bound = lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    best = sum(p.times for p in incumbent)
    left = dict(counts)
    sizes = sorted(left)
    used: list[Pattern] = []
    bins = waste = 0
    # one frame per node: its fillings still to be tried, and the pattern that is applied now
    stack: list[list] = []

    def take(pattern: Pattern, sign: int) -> None:
        nonlocal bins, waste
        for size in pattern.sizes:
            if left[size] == 0 and sign < 0:
                bisect.insort(sizes, size)
            left[size] -= sign * pattern.times
            if left[size] == 0 and sign > 0:
                sizes.pop(bisect.bisect_left(sizes, size))
        bins += sign * pattern.times
        waste += sign * pattern.times * (capacity - sum(pattern.sizes))

    def options() -> list[Pattern]:
        top = sizes[-1]
        left[top] -= 1
        out = []
        for filling in fillings(sizes, left, capacity - top):
            whole = (top, *filling)
            times = min((left[s] + (s == top)) // whole.count(s) for s in set(whole))
            out.append(Pattern(whole, times))
        left[top] += 1
        return out[::-1]

    while best > bound and nodes:
        nodes -= 1
        allowed = (best - 1) * capacity - total
        if not sizes:
            if bins < best:
                best, incumbent = bins, list(used)
        elif waste <= allowed:
            stack.append([options(), None])
        while stack:  # the next untried filling, from the deepest node up
            frame = stack[-1]
            if frame[1] is not None:
                take(used.pop(), -1)
                frame[1] = None
            if frame[0]:
                frame[1] = frame[0].pop()
                used.append(frame[1])
                take(frame[1], 1)
                break
            stack.pop()
        if not stack:
            break
    return incumbent


def pieces(
    df: DataFrame, text: str, key: str, capacity: int, closing: int, path: str | None, ranks_path: str | None
) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of every piece, in one pass without a shuffle."""
    names = [key, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks_path)
        end = np.array([closing], "<u4")
        for batch in batches:
            at, rows = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate((encode(text), end))
                start, length = 0, len(ids) % capacity or capacity
                for piece in range(-(-len(ids) // capacity)):
                    at.append(row)
                    rows.append((piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    start, length = start + length, capacity
            made = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *made], names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("text")).mapInArrow(
        run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long"
    )


def pack(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    capacity: int = 2048,
    closing: int = 0,
    nodes: int = NODES,
    path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset`` of every piece.

    The pieces are fixed in shared storage while the result is being built; only their counts per length reach the driver.
    """
    spark = df.sparkSession
    cut = cut_lineage(pieces(df, text, key, capacity, closing, path, ranks_path))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = complete_bins(counts, capacity, nodes)
    # where each pattern's places of a length begin among all places of that length
    filled: dict[int, int] = {}
    places, sequences = [], 0
    for number, pattern in enumerate(sorted(patterns, key=lambda p: p.sizes)):
        offset = 0
        for size in sorted(set(pattern.sizes), reverse=True):
            each = pattern.sizes.count(size)
            first = filled.get(size, 0)
            places.append((size, first, first + each * pattern.times, each, sequences, offset))
            filled[size] = first + each * pattern.times
            offset += each * size
        sequences += pattern.times
    kind = "_size long, _from long, _to long, _each long, _sequence long, _offset long"
    placed = spark.createDataFrame(places, kind)
    order = [F.col(key), F.col("piece"), F.col("ids_crc32"), F.col("start")]
    spread = F.xxhash64(F.col(key), F.col("piece"))
    ranked = running(with_slices(cut, sum(counts.values()), spread), ["length"], F.lit(1), order, "_rank")
    inside = (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    nth = F.col("_rank") - F.col("_from")
    return ranked.join(F.broadcast(placed), inside).select(
        key, "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )
