"""Best-fit packing by exact-complement hashing.

All decisions are made on the histogram of piece lengths, which has at most
`capacity` entries however large the corpus is: single, pair and triple sums of
the lengths that occur are indexed, the gap that each length leaves is looked
up in them, and combinations that fill it exactly are consumed as often as
counts allow; what remains is placed best-fit, descending, also by class.
The result is a table of runs (length, ranks, first sequence, offset) of
bounded size. Pieces get their rank among pieces of equal length without a
shuffle of tokens: encoding numbers them within its task, and a prefix sum
over tasks gives each task its base. A hot length is thus a counter, not a
group.

Defined results: null and empty texts give one piece of the end token only;
repeated doc_ids give their own pieces; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BINARY, INT, LONG, materialize, schema, table
from .tokens import encoder

CAPACITY = 4096


class Sums:
    """Index of the sums of one, two and three lengths that occur: each by its largest members, descending.

    Lengths are small whole numbers, so every table is addressed by the sum itself. The index is made once; whether lengths are
    still to be had is for the caller to see.
    """

    def __init__(self, count: np.ndarray, capacity: int):
        self.one = count > 0
        self.pairs: list[np.ndarray] = []
        for s in range(capacity + 1):
            x = np.arange(s - 1, (s + 1) // 2 - 1, -1, dtype=np.int32)
            self.pairs.append(x[self.one[x] & self.one[s - x]] if len(x) else x)
        self.least = np.array([p[-1] if len(p) else capacity + 1 for p in self.pairs])  # least of the larger members of a pair sum
        self.lengths = np.flatnonzero(self.one)[::-1]

    def triples(self, s: int, most: int) -> np.ndarray:
        """The largest members, up to `most`, of three lengths that sum to s."""
        x = self.lengths[(self.lengths <= min(most, s - 2)) & (self.lengths * 3 >= s)]
        return x[self.least[s - x] <= x]


def exact_fills(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Consume combinations of at most four lengths that sum to `capacity`; (lengths, times) each. Changes `count`.

    For each length, descending, the gap that it leaves is looked up among the single, the pair and the triple sums.
    """
    out: list[tuple[tuple[int, ...], int]] = []
    index = Sums(count, capacity)

    def take(*lengths: int) -> None:
        times = min(int(count[x]) // lengths.count(x) for x in lengths)
        if times:
            for x in lengths:
                count[x] -= times
            out.append((lengths, times))

    def pairs(first: tuple[int, ...], gap: int, most: int) -> None:
        x = index.pairs[gap]
        for b in x[(x <= most) & (count[x] > 0) & (count[gap - x] > 0)].tolist():
            if any(count[f] <= 0 for f in first):
                return
            take(*first, b, gap - b)

    if count[capacity]:
        take(capacity)
    for a in range(capacity - 1, 0, -1):
        gap = capacity - a
        if count[a] and gap <= a and index.one[gap]:
            take(a, gap)
        if count[a]:
            pairs((a,), gap, min(a, gap - 1))
        if count[a]:
            for b in index.triples(gap, a).tolist():
                if not count[a]:
                    break
                if count[b]:
                    pairs((a, b), gap - b, b)
    return out


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over classes of equal bins. Changes `count`."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
        if not bins[gap]:
            insort(gaps, gap)
        bins[gap].append((lengths, times))

    for x in np.flatnonzero(count)[::-1]:
        x, left = int(x), int(count[x])
        while left and (i := bisect_left(gaps, x)) < len(gaps):
            gap = gaps[i]
            lengths, times = bins[gap].pop()
            if not bins[gap]:
                gaps.pop(i)
            n = min(times, left)
            if times > n:
                put(gap, lengths, times - n)
            put(gap - x, (*lengths, x), n)
            left -= n
        if left:
            each = capacity // x
            if left >= each:
                put(capacity - each * x, (x,) * each, left // each)
            if left % each:
                put(capacity - left % each * x, (x,) * (left % each), 1)
        count[x] = 0
    return [item for found in bins.values() for item in found]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs as rows (length, first rank, past last rank, first sequence, offset), sorted by length and rank."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for x, n in histogram.items():
        count[x] = n
    made = exact_fills(count, capacity) + best_fit(count, capacity)
    ranks: dict[int, int] = defaultdict(int)
    runs, sequence = [], 0
    for lengths, times in made:
        offset = 0
        for x in lengths:
            runs.append((x, ranks[x], ranks[x] + times, sequence, offset))
            ranks[x] += times
            offset += x
        sequence += times
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Encoded pieces: doc_id, piece, start, length, ids (little-endian u32), and chunk and local, which number equal lengths in a task."""

    def encode(batches):
        enc, chunk, seen = encoder(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for d, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    ids = enc(t) + end
                    for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        n = len(own) // 4
                        rows.append((d, k, start, n, own, chunk, seen[n]))
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids", "chunk", "local"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    made = schema(doc_id=LONG, piece=INT, start=LONG, length=LONG, ids=BINARY, chunk=LONG, local=LONG)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, made)


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces, which must be stored (their chunk and local may not change). Any further columns stay."""
    counts = found.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = plan(histogram, capacity)
    keys = runs[:, 0] * (1 << 44) + runs[:, 1]
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def look_up(frames):
        for pdf in frames:
            rank = (pdf.pop("base") + pdf.pop("local")).to_numpy()
            i = np.searchsorted(keys, pdf["length"].to_numpy() * (1 << 44) + rank, side="right") - 1
            yield pdf.drop(columns="chunk").assign(sequence_id=runs[i, 3] + rank - runs[i, 1], offset=runs[i, 4])

    kept = [f for f in found.schema.fields if f.name not in ("chunk", "local")]
    out = schema(**{f.name: f.dataType for f in kept}, sequence_id=LONG, offset=LONG)
    return found.join(bases, ["length", "chunk"]).select(*(f.name for f in kept), "chunk", "local", "base").mapInPandas(look_up, out)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids (little-endian u32). A sequence holds at most `capacity` tokens, so a group is bounded."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids")).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their digest, sequence and offset; token ids stay in the stored pieces and are not shuffled."""
    found = materialize(pieces(docs, vocabulary, end_id, capacity), "pieces")
    return place(found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "chunk", "local"), capacity)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: where every piece of every document goes."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))
