"""Exact order statistics by repeated narrowing.

Spark's exact ``percentile`` keeps every distinct value of a column in one aggregation
buffer, so a continuous column of a large table ends up in one task. Here each round
runs two aggregates instead: a sketch that brackets every wanted rank, and a count of the
rows below, inside and above each bracket. Both combine on the map side, so no round
shuffles rows. A bracket holds about 1/2000 of its rows; the values are only gathered once
the bracket is known to be small, otherwise the next round narrows it again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
BRACKET = 2.5 / SKETCH_ACCURACY
GATHER_ROWS = 200_000
ITEMS_PER_PASS = 40
SMALL_SPAN = 16_000  # below this a bracket is only a handful of rows wide


@dataclass(frozen=True)
class Rank:
    """An order statistic: its value, rows strictly below it, rows equal to it."""

    value: float
    below: int
    equal: int


@dataclass
class _Span:
    """Rows of one item between ``low`` and ``high``; ``below`` rows lie under ``low``."""

    item: str
    low: float | None
    high: float | None
    below: int
    rows: int
    ranks: list[int]
    cuts: list[float] = field(default_factory=list)
    gather: list[tuple[float | None, float | None]] = field(default_factory=list)

    def inside(self, value: Column) -> Column:
        if self.low is None:
            return value
        return F.when(value.between(self.low, self.high), value)


def quantiles(
    df: DataFrame, items: dict[str, Column], probs: list[float], accuracy: int | None = None
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of every item; ``ITEMS_PER_PASS`` items share their passes.

    ``accuracy`` switches to one approximate pass.
    """
    names = list(items)
    found: dict[str, list[float | None]] = {}
    for start in range(0, len(names), ITEMS_PER_PASS):
        part = {name: items[name] for name in names[start : start + ITEMS_PER_PASS]}
        found |= _quantiles(df, part, probs, accuracy)
    return found


def _quantiles(
    df: DataFrame, items: dict[str, Column], probs: list[float], accuracy: int | None
) -> dict[str, list[float | None]]:
    # evaluate each item once per row, however often a pass refers to it
    df = df.select(*[value.cast("double").alias(f"v{i}") for i, value in enumerate(items.values())])
    items = {name: F.col(f"v{i}") for i, name in enumerate(items)}
    if accuracy is not None:
        row = df.agg(
            *[
                F.percentile_approx(value, [float(p) for p in probs], accuracy).alias(f"i{i}")
                for i, value in enumerate(items.values())
            ]
        ).first()
        return {
            name: list(row[i]) if row[i] is not None else [None] * len(probs)
            for i, name in enumerate(items)
        }

    opening, sizes = _sketch_spans(df, items, probs)
    places = {
        name: [p * (n - 1) for p in probs] for name, n in sizes.items() if n
    }
    wanted = {
        name: sorted({r for place in at for r in (math.floor(place), math.ceil(place))})
        for name, at in places.items()
    }
    for span in opening:
        span.ranks = wanted[span.item]
        _mark_gather(span, probs, len(opening))
    found = _search(df, items, opening)

    def interpolate(name: str, place: float) -> float:
        low = found[name][math.floor(place)].value
        high = found[name][math.ceil(place)].value
        return low + (high - low) * (place - math.floor(place))

    return {
        name: [interpolate(name, at) for at in places[name]] if name in places else [None] * len(probs)
        for name in items
    }


def uniform_ranks(
    df: DataFrame, items: dict[str, Column], sizes: dict[str, int], ranks: dict[str, list[int]], top: int
) -> dict[str, dict[int, Rank]]:
    """Order statistics of values spread evenly over ``[0, top)``, such as hashes.

    The first brackets follow from the row counts (eight standard deviations around the
    expected place), so no sketch is needed.
    """
    spans = []
    for name, at in ranks.items():
        if not at:
            continue
        n = sizes[name]
        span = _Span(name, None, None, 0, n, sorted(set(at)))
        cuts = set()
        for r in span.ranks:
            p = (r + 0.5) / n
            slack = 8 * math.sqrt(p * (1 - p) / n) + 4 / n
            low, high = math.floor((p - slack) * top), math.ceil((p + slack) * top)
            cuts |= {float(low), float(high)}
            if 2 * slack * n <= GATHER_ROWS / sum(map(len, ranks.values())):
                span.gather.append((float(low), float(high)))
        span.cuts = sorted(cuts)
        spans.append(span)
    return _search(df, items, spans)


def _probes(probs: list[float]) -> list[float]:
    return sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-BRACKET, BRACKET)})


def _sketch_spans(df: DataFrame, items: dict[str, Column], probs: list[float]):
    probes = _probes(probs)
    aggs = []
    for i, value in enumerate(items.values()):
        aggs += [
            F.count(value).alias(f"n{i}"),
            F.percentile_approx(value, probes, SKETCH_ACCURACY).alias(f"s{i}"),
        ]
    row = df.agg(*aggs).first()
    sizes = {name: row[f"n{i}"] for i, name in enumerate(items)}
    spans = [
        _Span(name, None, None, 0, sizes[name], [], cuts=list(row[f"s{i}"]))
        for i, name in enumerate(items)
        if sizes[name]
    ]
    return spans, sizes


def _mark_gather(span: _Span, probs: list[float], spans: int) -> None:
    """Choose the brackets whose values may be gathered, from their proven width."""
    if span.rows <= SMALL_SPAN and span.rows * spans <= GATHER_ROWS:
        span.cuts, span.gather = [], [(None, None)]
        return
    share = 2 * BRACKET + 2 / SKETCH_ACCURACY
    if span.rows * share * len(probs) * spans > GATHER_ROWS:
        span.cuts = sorted(set(span.cuts))
        return
    at = dict(zip(_probes(probs), span.cuts))
    for p in probs:
        span.gather.append((at[max(0.0, p - BRACKET)], at[min(1.0, p + BRACKET)]))
    span.cuts = sorted(set(span.cuts))


def _resketch(df: DataFrame, items: dict[str, Column], spans: list[_Span]) -> None:
    """Put new cuts inside spans that are still too wide to gather."""
    wide = []
    for span in spans:
        if span.rows * len(spans) <= GATHER_ROWS:
            span.cuts, span.gather = [], [(None, None)]
        else:
            wide.append(span)
    if not wide:
        return
    local = [[(r - s.below) / (s.rows - 1) for r in s.ranks] for s in wide]
    row = df.agg(
        *[
            F.percentile_approx(s.inside(items[s.item]), _probes(at), SKETCH_ACCURACY).alias(f"s{i}")
            for i, (s, at) in enumerate(zip(wide, local))
        ]
    ).first()
    for i, (span, at) in enumerate(zip(wide, local)):
        span.cuts, span.gather = list(row[i]), []
        _mark_gather(span, at, len(spans))


def _search(df: DataFrame, items: dict[str, Column], spans: list[_Span]) -> dict[str, dict[int, Rank]]:
    found: dict[str, dict[int, Rank]] = {s.item: {} for s in spans}
    while spans:
        left: list[_Span] = []
        groups = _count_regions(df, items, spans)
        for i, span in enumerate(spans):
            open_ranks: dict[tuple, list[int]] = {}
            start = span.below
            for low, high, n in groups[i]:
                for r in span.ranks:
                    if not start <= r < start + n:
                        continue
                    if low == high:
                        found[span.item][r] = Rank(low, start, n)
                    else:
                        open_ranks.setdefault((low, high, start, n), []).append(r)
                start += n
            left += [
                _Span(span.item, low, high, below, n, ranks)
                for (low, high, below, n), ranks in open_ranks.items()
            ]
        spans = left
        if spans:
            _resketch(df, items, spans)
    return found


def _count_regions(df: DataFrame, items: dict[str, Column], spans: list[_Span]):
    """Per span, ``(min, max, rows)`` of each region between cuts, in value order.

    A cut value is a region of its own, so rows piled up on one value settle at once.
    """
    columns, entries = [], []
    for i, span in enumerate(spans):
        value = span.inside(items[span.item].cast("double"))
        columns += [value.alias(f"x{i}"), _region(value, span.cuts).alias(f"r{i}")]
        x, region = F.col(f"x{i}"), F.col(f"r{i}")
        gathered = _gathered_regions(span)
        keep = F.lit(True) if gathered is None else region.isin(gathered) if gathered else F.lit(False)
        entries.append(
            F.struct(F.lit(i).alias("span"), region.alias("region"), F.when(keep, x).alias("exact"), x.alias("value"))
        )
    rows = (
        df.select(*columns)
        .select(F.inline(F.array(*entries)))
        .where("value IS NOT NULL")
        .groupBy("span", "region", "exact")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
        .collect()
    )
    groups: list[list[tuple[float, float, int]]] = [[] for _ in spans]
    for r in rows:
        groups[r["span"]].append((r["low"], r["high"], r["n"]))
    for g in groups:
        g.sort()
    return groups


def _region(value: Column, cuts: list[float]) -> Column:
    """2i for values between cuts i-1 and i, 2i+1 for values equal to cut i."""
    if not cuts:
        return F.lit(0)
    region = F.when(value < cuts[0], 0).when(value == cuts[0], 1)
    for i, cut in enumerate(cuts[1:], 1):
        region = region.when(value < cut, 2 * i).when(value == cut, 2 * i + 1)
    return region.otherwise(2 * len(cuts))


def _gathered_regions(span: _Span) -> list[int] | None:
    """The open regions inside a bracket; None if the whole span is gathered."""
    if any(low is None for low, _ in span.gather):
        return None
    return [
        2 * i
        for i in range(1, len(span.cuts))
        if any(low <= span.cuts[i - 1] and span.cuts[i] <= high for low, high in span.gather)
    ]
