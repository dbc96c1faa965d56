"""Exact top-k search: tiled products, partial selection for each tile, tree merging of top lists.

Defined results: see vectors.py; equal scores go to the smaller vec_id; scores
are exact integers (by floating-point products where those cannot round, else
by Python's integers, held to 64 bits); fewer candidates than k give all of
them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .vectors import best, blocks, is_query, lists, merge, pairs, usable


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-valued doubles."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1] < 2**53:
        return q @ d.T
    whole = [[int(x) for x in row] for row in q], [[int(x) for x in row] for row in d]
    return np.array([[max(-(2**63), min(2**63 - 1, sum(map(int.__mul__, a, b)))) for b in whole[1]] for a in whole[0]], dtype=object)


def search(vectors: DataFrame, queries: DataFrame, k: int, tile: int | None = None) -> DataFrame:
    """The k candidates of highest integer inner product for each query: query_id, rank, vec_id, score."""
    found, n = pairs(blocks(vectors, tile, "tiles"), blocks(queries, 1024, "queries"))

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                ids, own = np.frombuffer(r.d_ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                order = np.argsort(ids, kind="stable")
                ids, d = ids[order], np.floor(1024 * np.frombuffer(r.d_vectors).reshape(len(order), -1)[order])
                q = np.floor(1024 * np.frombuffer(r.q_vectors).reshape(len(own), -1))
                out = []
                for at in range(0, len(own), 256):
                    s = products(q[at : at + 256], d)
                    tops = _tops(s, ids, own[at : at + 256], k)
                    out += [(r.q_block, at + i, int(own[at + i]), r.d_block, top) for i, top in enumerate(tops)]
                yield pd.DataFrame(out, columns=["q_block", "q_row", "query_id", "part", "top"])

    return merge(found.mapInPandas(run, lists("long")), k, n)


def _tops(s: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[list[dict]]:
    lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
    if s.dtype == object:
        rows = [sorted((-int(x), int(v)) for x, v in zip(row, ids, strict=True) if v != me)[:k] for row, me in zip(s, own, strict=True)]
        return [[{"minus": a, "vec_id": v} for a, v in row] for row in rows]
    for i in np.flatnonzero(lo < hi):
        s[i, lo[i] : hi[i]] = -np.inf
    return [[{"minus": -int(row[c]), "vec_id": int(ids[c])} for c in cols] for row, cols in zip(s, best(s, k), strict=True)]


def op2_exact_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(is_query("vec_id", 100)), k)


#: The contract as SQL; vec_ids of the tables are unique.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND q.vec_id % 100 = 0 AND len(q.e) = len(d.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
