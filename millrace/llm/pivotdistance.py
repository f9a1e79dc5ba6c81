"""Exact top-k inner products by a pivot-distance index.

Components become integers ``floor(scale * x)``. With one more component ``sqrt(M**2 - |x|**2)`` for the rows of a shard, ``M``
being its largest norm, and 0 for queries, the nearest rows are those with the largest inner product. In that space
every row is keyed by its nearest pivot and its distance to it, and the rows of a pivot are cut, in distance order, into
annuli. By the triangle inequality no row of an annulus ``[low, high]`` is closer to a query at distance ``d`` from the
pivot than ``max(low - d, d - high)``. A query visits the annuli in the order of this bound, and stops at the first whose bound
lies beyond its k-th best so far; queries that visit the same annulus in a round share the work. Scores are exact integers.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part; zero vectors do. A repeated
id counts once. A query meets the vectors of its own length. Equal scores are ranked by id. Fewer rows than asked for are all returned; an empty table has no result. Scores that
don't fit a long raise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.vectorblocks import lengths, search, usable

PIVOTS = 16
ANNULUS = 256
EXACT = float(1 << 53)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)
    return np.sqrt(np.maximum(square, 0))


def largest(x: np.ndarray, q: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` and scores of the ``k`` best of every query, -1 where there are fewer."""
    norms = (x**2).sum(axis=1)
    top = norms.max()
    lifted = np.column_stack((x, np.sqrt(np.maximum(top - norms, 0))))
    asking = np.column_stack((q, np.zeros(len(q))))
    # farthest-first pivots from the row with the smallest id
    chosen = [0]
    away = distances(lifted, lifted[:1])[:, 0]
    while len(chosen) < min(pivots, len(x)):
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, distances(lifted, lifted[chosen[-1:]])[:, 0])
    to_pivot = distances(lifted, lifted[chosen])
    cell = to_pivot.argmin(axis=1)
    key = to_pivot[np.arange(len(x)), cell]
    order = np.lexsort((key, cell))
    annuli = []
    for p in range(len(chosen)):
        own = order[np.searchsorted(cell[order], p) : np.searchsorted(cell[order], p, "right")]
        annuli += [(p, own[i : i + ANNULUS]) for i in range(0, len(own), ANNULUS)]
    low = np.array([key[m[0]] for _, m in annuli])
    high = np.array([key[m[-1]] for _, m in annuli])
    d = distances(asking, lifted[chosen])[:, [p for p, _ in annuli]]
    bound = np.maximum(0, np.maximum(low - d, d - high))
    turn = np.argsort(bound, axis=1, kind="stable")
    square = (q**2).sum(axis=1) + top
    slack = 1e-9 * (1 + square)  # of the rounding in distances; only ever visits more

    places = np.full((len(q), k), -1)
    scores = np.full((len(q), k), -np.inf)
    active = np.arange(len(q))
    for step in range(len(annuli)):
        at = turn[active, step]
        # a row beats the k-th best score s only within distance sqrt(square - 2 s); ties may still have smaller ids
        reach = np.sqrt(np.maximum(square[active] - 2 * scores[active, -1] + slack[active], 0))
        go = bound[active, at] <= reach * (1 + 1e-9) + 1e-9
        active, at = active[go], at[go]
        if not len(active):
            break
        for a in np.unique(at):
            rows, members = active[at == a], annuli[a][1]
            new = q[rows] @ x[members].T
            new[asked[rows][:, None] == ids[members][None, :]] = -np.inf
            both = np.concatenate((scores[rows], new), axis=1)
            where = np.concatenate((places[rows], np.broadcast_to(members, new.shape)), axis=1)
            best = np.lexsort((np.where(where < 0, len(x), where), -both), axis=1)[:, :k]  # places are in id order
            scores[rows] = np.take_along_axis(both, best, axis=1)
            places[rows] = np.where(np.isinf(scores[rows]), -1, np.take_along_axis(where, best, axis=1))
    return places, scores


def top_products(
    df: DataFrame,
    is_query: Column,
    vector: str = "embedding",
    key: str = "vec_id",
    k: int = 20,
    scale: int = 64,
    pivots: int = PIVOTS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (long) of the ``k`` rows with the largest integer inner product.

    ``is_query`` is a condition on a column ``id`` that holds the key.
    """
    rows = usable(df, key, vector, zero=True)
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))

    def build(ids: np.ndarray, x: np.ndarray) -> dict[str, bytes]:
        return {"ids": ids.tobytes(), "vectors": x.tobytes()}

    def find(index: dict[str, bytes], asked: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        ids = np.frombuffer(index["ids"], np.int64)
        x = np.frombuffer(index["vectors"]).reshape(len(ids), -1)
        if np.abs(x).max() * np.abs(q).max() * x.shape[1] * 2 >= EXACT:
            return _by_whole_numbers(ids, x, asked, q, k)
        places, scores = largest(x, q, ids, asked, k, pivots)
        row, at = np.nonzero(places >= 0)
        return pd.DataFrame({"query_id": asked[row], "vec_id": ids[places[row, at]], "score": scores[row, at].astype(np.int64)})

    return search(*lengths(rows, is_query), is_query, build, ["ids", "vectors"], find, k, nearest=False, kind="long")


def _by_whole_numbers(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """For components too large for exact doubles: every product, in unbounded integers."""
    whole = np.array([[int(v) for v in row] for row in x], dtype=object)
    out = []
    for one, row in zip(asked, q):
        scores = whole @ np.array([int(v) for v in row], dtype=object)
        order = sorted((i for i in range(len(ids)) if ids[i] != one), key=lambda i: (-scores[i], ids[i]))[:k]
        out += [(one, ids[i], scores[i]) for i in order]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
