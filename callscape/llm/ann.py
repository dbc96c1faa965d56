"""Approximate nearest neighbours: stable projections, a kd-tree, and a chi-square stopping test.

Largest inner product becomes least distance by one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm of all vectors, 0 in queries. Each
block of vectors is projected by `dims` Gaussian vectors, whose squared length
over the true squared distance follows a chi-square law with `dims` degrees of
freedom, and a kd-tree over the projections orders its leaves. A query walks
the leaves by projected distance and verifies the points within them on the
original vectors. With d the distance of its k-th hit so far, it stops where
the projected distance reaches d * sqrt(q), q the `sure` quantile: a nearer
point would have come up already with probability `sure` or more. Points of a
leaf beyond that radius need no verifying either.

Every row is indexed. Defined results: see vectors.py, and zero vectors take
no part; equal scores go to the smaller vec_id; fewer candidates than k give
all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table
from .vectors import best, blocks, is_query, lists, merge, pairs, usable

LEAF = 64


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile of the chi-square law for an even number of degrees of freedom, by bisection of its closed form."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def projector(dim: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, dims]).standard_normal((dim + 1, dims))


def leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: median cuts across the widest side."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        own = points[rows]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        half = len(rows) // 2
        order = rows[np.argpartition(own[:, axis], half)]
        todo += [order[:half], order[half:]]
    return out


def index(data: DataFrame, top: float, dims: int, seed: int) -> DataFrame:
    """Blocks in leaf order, with their projections and leaf sizes."""

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                x = np.frombuffer(r.vectors).reshape(len(ids), -1)
                lifted = np.hstack((x, np.sqrt(np.maximum(0, top * top - (x * x).sum(1)))[:, None]))
                p = lifted @ projector(x.shape[1], dims, seed)
                cut = leaves(p)
                order = np.concatenate(cut)
                out.append((r.block, r.dim, ids[order].tobytes(), x[order].tobytes(), p[order].tobytes(), np.array([len(c) for c in cut], np.int64).tobytes()))
            yield pd.DataFrame(out, columns=["block", "dim", "ids", "vectors", "points", "sizes"])

    return materialize(data.mapInPandas(run, "block long, dim int, ids binary, vectors binary, points binary, sizes binary"), "kdtree")


def walk(ids, x, points, sizes, q, q_ids, k: int, top: float, quantile: float, direction: np.ndarray, steps: int = 8):
    """Hits of each query in one block: (scores, row numbers), best first."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
    at = q @ direction[:-1]
    box = sum((np.maximum(0, np.maximum(low[None, :, j] - at[:, None, j], at[:, None, j] - high[None, :, j]))) ** 2 for j in range(points.shape[1]))
    order = np.argsort(box, axis=1, kind="stable")
    length = (q * q).sum(1) + top * top
    hits = [(np.empty(0), np.empty(0, np.int64))] * len(q)
    radius = np.full(len(q), np.inf)
    squares = (points * points).sum(1)
    step = -(-len(sizes) // steps)
    for first in range(0, len(sizes), step):
        turn = order[:, first : first + step]
        active = np.flatnonzero(np.take_along_axis(box, turn[:, :1], 1)[:, 0] < radius)
        if not len(active):
            break
        buffer = np.full((len(active), step * LEAF), -np.inf)
        rows = np.zeros((len(active), step * LEAF), np.int64)
        who, slot = np.divmod(np.arange(len(active) * turn.shape[1]), turn.shape[1])
        leaf = turn[active].ravel()
        sort = np.argsort(leaf, kind="stable")
        for group in np.split(sort, np.flatnonzero(np.diff(leaf[sort])) + 1):
            n = leaf[group[0]]
            own, a = slice(starts[n], ends[n]), who[group]
            near = squares[own][None] - 2 * at[active[a]] @ points[own].T + (at[active[a]] ** 2).sum(1)[:, None] < radius[active[a]][:, None]
            if not near.any():
                continue
            s = np.where(near, q[active[a]] @ x[own].T, -np.inf)
            s[ids[own][None] == q_ids[active[a]][:, None]] = -np.inf
            cols = slot[group][:, None] * LEAF + np.arange(sizes[n])
            buffer[a[:, None], cols] = s
            rows[a[:, None], cols] = np.arange(starts[n], ends[n])
        least = np.array([hits[i][0][-1] if len(hits[i][0]) == k else -np.inf for i in active])
        for j in np.flatnonzero(buffer.max(1) >= least):
            i, new = active[j], np.flatnonzero((buffer[j] >= least[j]) & (buffer[j] > -np.inf))
            score, row = np.concatenate((hits[i][0], buffer[j, new])), np.concatenate((hits[i][1], rows[j, new]))
            keep = np.lexsort((ids[row], -score))[:k]
            hits[i] = score[keep], row[keep]
            if len(keep) == k:
                radius[i] = quantile * max(0.0, length[i] - 2 * hits[i][0][-1]) + 1e-9
    return hits


def search(vectors: DataFrame, queries: DataFrame, k: int, dims: int = 16, sure: float = 0.9, seed: int = 1) -> DataFrame:
    """The k nearest found for each query: query_id, rank, vec_id, score."""
    data = blocks(vectors, None, "vectors")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v))
    top = (vectors.agg(F.max(norm)).first()[0] or 1.0) * (1 + 1e-9)
    found, n = pairs(index(data, top, dims, seed), blocks(queries, 1024, "queries"))
    quantile = chi_square_quantile(sure, dims)

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                ids, own = np.frombuffer(r.d_ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                x, q = np.frombuffer(r.d_vectors).reshape(len(ids), -1), np.frombuffer(r.q_vectors).reshape(len(own), -1)
                points, sizes = np.frombuffer(r.d_points).reshape(len(ids), -1), np.frombuffer(r.d_sizes, np.int64)
                out = []
                for at in range(0, len(own), 256):
                    hits = walk(ids, x, points, sizes, q[at : at + 256], own[at : at + 256], k, top, quantile, projector(x.shape[1], dims, seed))
                    for i, (score, row) in enumerate(hits):
                        out.append((r.q_block, at + i, int(own[at + i]), r.d_block, [{"minus": -float(s), "vec_id": int(v)} for s, v in zip(score, ids[row], strict=True)]))
                yield pd.DataFrame(out, columns=["q_block", "q_row", "query_id", "part", "top"])

    return merge(found.mapInPandas(run, lists("double")), k, n)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), zero=False)
    return search(vectors, vectors.where(is_query("vec_id", 20)), k)
