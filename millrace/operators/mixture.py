"""Gaussian mixtures with full covariances: all starts go through expectation and maximisation in the same passes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage

START_ROWS = 2_000
FLOOR = 1e-10  # least variance, as a share of the feature's own


@dataclass(frozen=True)
class Mixture:
    """Weights, means and covariances of the components, and the log likelihood of the rows it was fitted to."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float
    passes: int

    def cluster(self, x: list[Column]) -> Column:
        """The most likely component of a row, the first on ties."""
        logs = []
        for w, mean, cov in zip(self.weights, self.means, self.covariances):
            back = np.linalg.inv(np.linalg.cholesky(cov))
            apart = [c - float(m) for c, m in zip(x, mean)]
            log = F.lit(float(np.log(w) + np.log(np.diag(back)).sum()) if w > 0 else -math.inf)
            for i in range(len(x)):
                side = sum((apart[j] * float(back[i, j]) for j in range(1, i + 1)), apart[0] * float(back[i, 0]))
                log = log - side * side / 2
            logs.append(log)
        every = F.array(*logs)
        return (F.array_position(every, F.array_max(every)) - 1).cast("int")


def _sample(points: DataFrame) -> np.ndarray:
    """The ``START_ROWS`` distinct points of least hash, whatever the partitioning; a task hands on no more than so many."""
    width, names = len(points.columns), ["at", *points.columns]

    def least(batches):
        kept = np.empty(0, dtype=[("at", "i8"), ("x", "f8", (width,))])
        for batch in batches:
            at, *x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if len(kept) == START_ROWS:
                near = at < kept["at"][-1]
                at, x = at[near], [v[near] for v in x]
            new = np.empty(len(at), dtype=kept.dtype)
            new["at"], new["x"] = at, np.column_stack(x)
            both = np.concatenate([kept, new])
            kept = both[np.unique(both["at"], return_index=True)[1][:START_ROWS]]
        columns = [pa.array(kept["at"]), *[pa.array(np.ascontiguousarray(kept["x"][:, i])) for i in range(width)]]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    hashed = points.select(F.xxhash64(*points.columns).alias("at"), *points.columns)
    drawn = hashed.mapInArrow(least, hashed.schema).dropDuplicates(["at"]).orderBy("at").limit(START_ROWS)
    return np.array([r[1:] for r in drawn.collect()], dtype=float)


def _start(sample: np.ndarray, k: int, floor: np.ndarray, rng) -> tuple:
    """Centres far apart (k-means++ on the sample), then weights, means and covariances of the rows nearest to each."""
    centres = [sample[rng.integers(len(sample))]]
    for _ in range(k - 1):
        near = np.min([((sample - c) ** 2).sum(axis=1) for c in centres], axis=0)
        share = near / near.sum() if near.sum() > 0 else None
        centres.append(sample[rng.choice(len(sample), p=share)])
    nearest = np.argmin([((sample - c) ** 2).sum(axis=1) for c in centres], axis=0)
    weights, means, covs = np.empty(k), np.array(centres), np.empty((k, sample.shape[1], sample.shape[1]))
    whole = np.diag(sample.var(axis=0))
    for c in range(k):
        mine = sample[nearest == c]
        weights[c] = max(1, len(mine))
        if len(mine):
            means[c] = mine.mean(axis=0)
        covs[c] = (np.cov(mine.T, bias=True).reshape(whole.shape) if len(mine) > len(whole) else whole) + np.diag(floor)
    return weights / weights.sum(), means, covs


def _sums(points: DataFrame, centre: np.ndarray, scale: np.ndarray, models: dict[int, tuple]) -> tuple[dict, dict]:
    """One pass: per start the log likelihood, and per component the responsibilities' sums of 1, x and xx'.

    A task adds up its batches and hands on one row per number; the driver gets starts x components x features^2 of them.
    """
    k, d = next(iter(models.values()))[1].shape
    width = 1 + d + d * d
    ready = {}
    for s, (weights, means, covs) in models.items():
        backs = np.linalg.inv(np.linalg.cholesky(covs))
        with np.errstate(divide="ignore"):
            level = np.log(weights) + np.log(np.diagonal(backs, axis1=1, axis2=2)).sum(axis=1) - d / 2 * math.log(2 * math.pi)
        ready[s] = (level, means, backs)

    def expect(batches):
        total = {s: np.zeros(1 + k * width) for s in ready}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            x = (x.astype(float) - centre) / scale
            for s, (level, means, backs) in ready.items():
                log = np.column_stack([level[c] - (((x - means[c]) @ backs[c].T) ** 2).sum(axis=1) / 2 for c in range(k)])
                top = log.max(axis=1, keepdims=True)
                like = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
                share = np.exp(log - like[:, None])
                total[s][0] += like.sum()
                parts = [np.concatenate([[share[:, c].sum()], share[:, c] @ x, ((x * share[:, [c]]).T @ x).ravel()]) for c in range(k)]
                total[s][1:] += np.concatenate(parts)
        for s, numbers in total.items():
            columns = [pa.array(np.full(len(numbers), s), pa.int32()), pa.array(np.arange(len(numbers)), pa.int32()), pa.array(numbers)]
            yield pa.RecordBatch.from_arrays(columns, names=["start", "at", "s"])

    found = {s: np.zeros(1 + k * width) for s in models}
    for r in points.mapInArrow(expect, "start int, at int, s double").groupBy("start", "at").agg(F.sum("s").alias("s")).collect():
        found[r["start"]][r["at"]] = r["s"]
    return {s: v[0] for s, v in found.items()}, {s: v[1:].reshape(k, width) for s, v in found.items()}


def _maximised(model: tuple, sums: np.ndarray, rows: int, floor: np.ndarray) -> tuple:
    """Parameters from the sums; a component without rows stays where it was, without weight."""
    weights, means, covs = (v.copy() for v in model)
    d = means.shape[1]
    for c, part in enumerate(sums):
        weights[c] = part[0] / rows
        if part[0] > 1e-9:
            means[c] = part[1 : 1 + d] / part[0]
            covs[c] = part[1 + d :].reshape(d, d) / part[0] - np.outer(means[c], means[c])
            covs[c] = (covs[c] + covs[c].T) / 2 + np.diag(floor)
    return weights / weights.sum(), means, covs


def fit_mixture(
    df: DataFrame, x: list[Column], k: int, max_iter: int = 100, n_init: int = 1, seed: int = 42, tol: float = 1e-4, reg_covar: float = 1e-6
) -> Mixture:
    """The most likely of ``n_init`` mixtures of ``k`` components; the first on ties.

    Starts come from a sample of ``START_ROWS`` points, the same for every seed; every expectation step reads all rows once for all starts. A start
    is done when its mean log likelihood grows by less than ``tol``. ``reg_covar`` is added to the variances.
    """
    points = cut_lineage(df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)]))
    aggs = [f(f"x{i}") for i in range(len(x)) for f in (F.count, F.avg, F.stddev_pop)]
    rows, *stats = points.agg(F.count("*"), *aggs).first()
    if rows < max(1, k):
        raise ValueError(f"{rows} rows are too few for {k} components")
    if any(n != rows for n in stats[::3]) or not all(math.isfinite(v) for v in stats):
        raise ValueError("features hold missing or infinite values; fill or drop them first")
    centre, scale = np.array(stats[1::3]), np.array([s or 1.0 for s in stats[2::3]])
    floor = np.maximum(reg_covar / scale**2, FLOOR)
    sample = (_sample(points) - centre) / scale
    models = {s: _start(sample, k, floor, np.random.default_rng(seed + s)) for s in range(n_init)}
    done: dict[int, tuple[float, tuple]] = {}
    before = dict.fromkeys(models, -math.inf)
    for passes in range(1, max_iter + 2):  # the last pass only measures
        likes, sums = _sums(points, centre, scale, models)
        for s, like in likes.items():
            if like / rows - before[s] < tol or passes > max_iter:
                done[s] = (like, models.pop(s))
            else:
                before[s], models[s] = like / rows, _maximised(models[s], sums[s], rows, floor)
        if not models:
            break
    like, (weights, means, covs) = max(done.values(), key=lambda v: v[0])
    like -= rows * float(np.log(scale).sum())
    return Mixture(weights, means * scale + centre, covs * np.outer(scale, scale), float(like), passes)
