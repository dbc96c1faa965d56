"""Blocks of vectors, pairing of query and data blocks, and merging of top lists: shared by both vector searches.

Vectors that are null, empty, or hold null or non-finite components take no
part (zero vectors only where the caller says so), and neither do rows without
an id. Vectors of different length are never compared. Rows that repeat a
vec_id each take part; a query is not compared with rows of its own id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dense_ids, materialize

#: Bytes of vectors in one block: a task holds a pair of blocks and their product.
BLOCK_BYTES = 8 << 20
#: Top lists merged at once; the merge is a tree of this fan-in.
FAN = 16


def usable(vectors: DataFrame, zero: bool = True) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    kept = kept.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(~bad)
    return kept if zero else kept.where(F.exists(x, lambda v: v != 0))


def blocks(vectors: DataFrame, rows: int | None, name: str) -> DataFrame:
    """Stored, numbered blocks (block, dim, n, ids, vectors), packed within partitions without a shuffle.

    A hot vec_id is spread like any other, since nothing is dealt out by key.
    """

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        waiting: dict[int, list] = {}

        def emit(dim, last):
            nonlocal made
            ids, x = (np.concatenate(c) for c in zip(*waiting.pop(dim), strict=True))
            full = rows or max(64, BLOCK_BYTES // (8 * dim))
            for at in range(0, len(ids), full):
                own, n = slice(at, at + full), min(full, len(ids) - at)
                if n < full and not last:
                    waiting[dim] = [(ids[own], x[own])]
                    return
                yield pa.RecordBatch.from_pylist([{"key": part << 24 | made, "dim": dim, "n": n, "ids": ids[own].tobytes(), "vectors": x[own].tobytes()}], schema=arrow)
                made += 1

        for batch in batches:
            ids, lists = batch["vec_id"].to_numpy(), batch["embedding"]
            ends = lists.offsets.to_numpy()
            flat, sizes = lists.values.to_numpy(zero_copy_only=False), np.diff(ends)
            for dim in np.unique(sizes).tolist():
                pick = np.flatnonzero(sizes == dim)
                waiting.setdefault(dim, []).append((ids[pick], flat[ends[pick][:, None] + np.arange(dim)]))
                if sum(len(p[0]) for p in waiting[dim]) >= (rows or max(64, BLOCK_BYTES // (8 * dim))):
                    yield from emit(dim, False)
        for dim in list(waiting):
            yield from emit(dim, True)

    arrow = pa.schema([("key", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
    packed = materialize(vectors.mapInArrow(run, "key long, dim int, n int, ids binary, vectors binary"), name)
    # one row stands for a whole block, so the single ordered pass that numbers them is short
    return packed.join(dense_ids(packed.select("key"), ["key"], "block"), "key")


def pairs(data: DataFrame, queries: DataFrame) -> tuple[DataFrame, int]:
    """Each query block beside each data block of its dimension (columns d_* and q_*), joined on both numbers so that pairs spread evenly."""
    n_d, n_q = data.count(), queries.count()
    d = data.select(*(F.col(c).alias(f"d_{c}") for c in data.columns if c != "key"))
    q = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns if c != "key"))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))
    left, right = d.withColumn("q_block", span(n_q)), q.withColumn("d_block", span(n_d))
    return left.join(right, ["d_block", "q_block"]).where("d_dim = q_dim"), n_d


def best(scores: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the columns of its k highest finite scores, highest first, ties to the smaller column."""
    n = scores.shape[1]
    bound = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    out = []
    for row, least in zip(scores, bound, strict=True):
        at = np.flatnonzero((row >= least) & (row > -np.inf))
        out.append(at[np.argsort(-row[at], kind="stable")[:k]])
    return out


def merge(tops: DataFrame, k: int, n_blocks: int) -> DataFrame:
    """Lists (q_block, q_row, query_id, part, top of (minus score, vec_id)) merged as a tree; then one row a hit, with its rank."""
    key = ["q_block", "q_row", "query_id"]
    spread = n_blocks
    while True:
        tops = tops.groupBy(*key, F.floor(F.col("part") / FAN).alias("part")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        spread = -(-spread // FAN)
        if spread <= 1:
            break
    hits = tops.select("query_id", F.posexplode("top").alias("rank", "hit"))
    return hits.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def lists(kind: str) -> str:
    return f"q_block long, q_row int, query_id long, part long, top array<struct<minus: {kind}, vec_id: long>>"


def is_query(column: str | Column, every: int) -> Column:
    return F.pmod(F.col(column), F.lit(every)) == 0
