"""Substring deduplication over a log-structured fingerprint index.

A word is removed if a window of 50 consecutive words that covers it also
starts in a document with a smaller doc_id. Windows are found in two steps:

1. Winnowing: of every 26 consecutive 25-word windows, that is of every
   50-word window, the least hash is an anchor. Equal 50-word windows have
   equal anchors, so none is missed, at about 2/27 of the volume. Anchors of a
   batch become a sorted immutable run (hash, least and greatest text key),
   stored in buckets by hash. A new batch's run is merge-joined with each run
   of the log, bucket with bucket, so history is neither shuffled nor
   fingerprinted again; anchors that two different texts share are its hits.
   Beyond `fan` runs the log is compacted into one. The log is a folder with
   numbered manifests: kept, it takes later batches in later sessions.
2. Verifying: in texts with hits, all 50-word windows around shared anchors
   are hashed whole, and the least doc_id of each is found by aggregation. A
   window counts where that is smaller than its own. Copies of a whole text
   are settled by their text key and are not walked at all.

Hot passages are aggregated before they are shuffled; no step holds the
documents of a passage together. What decides removals, text keys and hashes
of whole windows, has 128 bits; anchors, which only lead there, have 64.

Defined results: null and empty texts have no words; rows with a null doc_id
lose nothing and take nothing from others; rows that share a doc_id do not
remove each other's words, unless an earlier document has them; an empty table
gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, release, shared_dir, split_by_filter, storing, table
from .words import bounds, mix, sequences, word_hashes

WINDOW, ANCHOR = 50, 25


def _slide(x: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every `size` neighbours, by doubling."""
    done, span = x, 1
    while span * 2 <= size:
        done, span = pick(done[:-span], done[span:]), span * 2
    rest = size - span
    return pick(done[: len(done) - rest], done[rest:]) if rest else done


def anchors(words: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the anchors: the least hashes of the anchor windows within each whole window."""
    h, many = sequences(words, anchor), window - anchor + 1
    if len(h) < many:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = _slide(h, many, np.minimum)
    pad = np.zeros(many - 1, np.uint64)
    best = _slide(np.concatenate((pad, least, pad)), many, np.maximum)
    at = np.flatnonzero(best == h)
    return at, h[at]


def _hashed(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    starts, ends = bounds(data)
    return word_hashes(data, starts, ends), starts, ends, raw


def _lists(rows: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.empty(0, kind)]).astype(kind)))


class FingerprintIndex:
    """A log of sorted immutable runs (h, lo, hi): an anchor hash with the least and greatest key of its texts.

    Runs are Parquet in buckets by hash, sorted within them. A numbered manifest names the runs and the number of buckets; it is
    written when they are. Opening a folder that has manifests goes on with its log.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fan: int = 4):
        self.spark, self.path, self.fan = spark, path, fan
        jvm = spark.sparkContext._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = sorted(n for n in self._names() if n.startswith("manifest-"))
        self.number = len(known) and int(known[-1][len("manifest-") :])
        if known:
            stream = self._fs.open(self._path(f"{path}/{known[-1]}"))
            state = json.loads(self._text.toString(stream, "UTF-8"))
            stream.close()
        else:
            state = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": []}
        self.buckets, self.runs, self.tables = state["buckets"], state["runs"], {}

    def _names(self) -> list[str]:
        home = self._path(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(home)] if self._fs.exists(home) else []

    def _commit(self) -> None:
        self.number += 1
        fresh = self._path(f"{self.path}/.next-{uuid.uuid4().hex}")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(json.dumps({"buckets": self.buckets, "runs": self.runs}).encode()))
        stream.close()
        if not self._fs.rename(fresh, self._path(f"{self.path}/manifest-{self.number:08}")):
            raise ValueError("another writer appended to the log")

    def run(self, name: str) -> DataFrame:
        """A run as a bucketed table, so that joins on its hash need no shuffle of it."""
        if name not in self.tables:
            table = self.tables[name] = f"fingerprints_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} (h BIGINT, lo BIGINT, hi BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(self.tables[name])

    def _write(self, rows: DataFrame) -> str:
        """Store (h, lo, hi), which are dealt out by h into as many parts as there are buckets, as a run."""
        name = f"run-{uuid.uuid4().hex}"
        self.run(name)
        with storing(self.spark, **{"shuffle.partitions": str(self.buckets)}):  # the aggregation's shuffle is the one into buckets
            rows.write.insertInto(self.tables[name])
        return name

    def append(self, batch: DataFrame) -> DataFrame:
        """Add a batch of (h, tkey); the hashes that two texts share, at least one of them new."""
        name = self._write(batch.groupBy("h").agg(F.min("tkey").alias("lo"), F.max("tkey").alias("hi")))
        run = self.run(name)
        hits = run.where("lo < hi").select("h")
        for old in self.runs:
            past = self.run(old).select("h", F.col("lo").alias("past_lo"), F.col("hi").alias("past_hi"))
            both = run.join(past.hint("merge"), "h").where("least(lo, past_lo) < greatest(hi, past_hi)")
            hits = hits.unionByName(both.select("h"))
        hits = materialize(hits.distinct(), "hits")
        self.runs = [*self.runs, name]
        self._commit()
        if len(self.runs) > self.fan:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merge all runs into one; the old ones go when the manifest no longer names them."""
        old, merged = self.runs, None
        for name in old:
            merged = self.run(name) if merged is None else merged.unionByName(self.run(name))
        self.runs = [self._write(merged.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))]
        self._commit()
        for name in old:
            self.spark.sql(f"DROP TABLE {self.tables.pop(name)}")
            self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def close(self, delete: bool = False) -> None:
        """Forget the tables; the log stays in its folder, unless it is to be deleted."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE {table}")
        self.tables = {}
        if delete:
            self._fs.delete(self._path(self.path), True)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, check, text): two hashes of a text tell texts apart without a shuffle; the first names a row beside its doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), F.xxhash64(F.lit("check"), "text", F.char_length("text")).alias("check"), "text")


def fingerprints(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, tkey, check, hashes) of the documents that have a whole window."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows, keep = batch.slice(at, 256), [], []
                for i, text in enumerate(part["text"].to_pylist()):
                    found = anchors(_hashed(text)[0], window, anchor)[1]
                    if len(found):
                        rows.append(np.unique(found).view(np.int64))
                        keep.append(i)
                if keep:
                    own = part.take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([own["doc_id"], own["tkey"], own["check"], _lists(rows, np.int64)], ["doc_id", "tkey", "check", "hashes"])

    return keyed(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, tkey long, check long, hashes array<long>")


def windows(docs: DataFrame, shared: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, tkey, starts, hashes, checks) of all whole windows around the shared anchors of each document; the last two are hashes of their words."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, starts, hashes, checks = batch.slice(at, 64), [], [], []
                for text, hits in zip(part["text"].to_pylist(), part["shared"], strict=True):
                    words = _hashed(text)[0]
                    where, found = anchors(words, window, anchor)
                    where = where[np.isin(found, hits.values.to_numpy().view(np.uint64))]
                    whole = sequences(words, window)
                    mark = np.zeros(len(whole) + 1, np.int32)
                    np.add.at(mark, np.maximum(0, where - (window - anchor)), 1)
                    np.add.at(mark, np.minimum(len(whole), where + 1), -1)
                    at_words = np.flatnonzero(np.cumsum(mark[:-1]))
                    starts.append(at_words)
                    hashes.append(whole[at_words].view(np.int64))
                    checks.append(sequences(mix(~words), window)[at_words].view(np.int64))
                columns = [part["doc_id"], part["tkey"], _lists(starts, np.int32), _lists(hashes, np.int64), _lists(checks, np.int64)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tkey", "starts", "hashes", "checks"])

    near = split_by_filter(keyed(docs).where("doc_id is not null"), ["doc_id", "tkey"], shared)[1]
    out = "doc_id long, tkey long, starts array<int>, hashes array<long>, checks array<long>"
    return near.join(shared, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "shared").dropDuplicates(["doc_id", "tkey"]).mapInArrow(run, out)


def covered(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = 4, fan: int = 2) -> DataFrame:
    """(doc_id, tkey, starts) of the windows that an earlier document has; starts is null where that is all of them.

    The documents go through a log in `batches` batches of ascending doc_id.
    """
    spark = docs.sparkSession
    marks = materialize(fingerprints(docs, window, anchor), "anchors")
    cuts = marks.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.05) if batches > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    index, hits = FingerprintIndex(spark, shared_dir(spark, "log"), fan=fan), []
    for low, high in zip(edges, edges[1:], strict=False):
        batch = marks
        batch = batch if low is None else batch.where(F.col("doc_id") > low)
        batch = batch if high is None else batch.where(F.col("doc_id") <= high)
        hits.append(index.append(batch.select("tkey", F.explode("hashes").alias("h"))))
    index.close(delete=True)
    found = verify(docs, marks, reduce(DataFrame.unionByName, hits), window, anchor)
    for done in (marks, *hits):
        release(done)
    return found


def verify(docs: DataFrame, marks: DataFrame, hits: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, tkey, starts) as `covered` gives them, from the fingerprints of all documents and the anchors that texts share."""
    firsts = marks.groupBy("tkey", "check").agg(F.min("doc_id").alias("first"))
    status = materialize(marks.select("doc_id", "tkey", "check").distinct().join(firsts, ["tkey", "check"]), "copies")
    leading = status.where("doc_id = first").select("doc_id", "tkey")
    touched = (
        marks.select("doc_id", "tkey", F.explode("hashes").alias("h"))
        .join(hits.distinct(), "h")
        .groupBy("doc_id", "tkey")
        .agg(F.collect_set("h").alias("shared"))  # no more than the document has
        .join(leading, ["doc_id", "tkey"], "left_semi")
    )
    touched = materialize(touched, "touched")
    found = materialize(windows(docs, touched, window, anchor), "windows")
    key = ["h", "check"]
    every = found.select("doc_id", "tkey", F.explode(F.arrays_zip("starts", "hashes", "checks")).alias("w")).select("doc_id", "tkey", "w.starts", F.col("w.hashes").alias("h"), F.col("w.checks").alias("check"))
    least = every.groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select(*key, "least")
    least = materialize(least, "least")  # stored, so that a hot window's side of the join can be split
    late = every.join(least, key).where("doc_id > least").groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_list("starts")).alias("starts"))
    copies = status.where("doc_id > first").select("doc_id", "tkey", F.lit(None).cast("array<int>").alias("starts"))
    out = materialize(late.unionByName(copies), "covered")
    for done in (touched, found, status, least):
        release(done)
    return out


def _kept(text: str | None, marked: bool, starts: list[int] | None, window: int) -> tuple[int, np.ndarray, np.ndarray, bytes]:
    """Number of words, offsets of those kept, and the text's bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    begin, end = bounds(np.frombuffer(raw, np.uint8))
    n = len(begin)
    if not marked:
        return n, begin, end, raw
    if starts is None:
        return n, begin[:0], end[:0], raw
    mark = np.zeros(n + 1, np.int32)
    at = np.asarray(starts)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + window, -1)
    keep = np.cumsum(mark[:-1]) == 0
    return n, begin[keep], end[keep], raw


def with_cuts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, with `cut mark` (true where words go) and `cut starts`. Only texts that may be cut are shuffled."""
    plain = docs.columns
    named = docs.withColumn("cut id", F.col("doc_id").cast("long")).withColumn("cut key", F.xxhash64("text"))
    edits = found.select(F.col("doc_id").alias("cut id"), F.col("tkey").alias("cut key"), F.lit(True).alias("cut mark"), F.col("starts").alias("cut starts"))
    clear, near = split_by_filter(named, ["cut id", "cut key"], edits)
    near = near.join(edits, ["cut id", "cut key"], "left").withColumn("cut mark", F.coalesce("cut mark", F.lit(False)))
    clear = clear.withColumn("cut mark", F.lit(False)).withColumn("cut starts", F.lit(None).cast("array<int>"))
    return clear.select(*plain, "cut mark", "cut starts").unionByName(near.select(*plain, "cut mark", "cut starts"))


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = 4) -> DataFrame:
    """`docs` with the covered words cut out of its texts, which keep their white space otherwise; untouched texts stay the same."""
    names, kinds = docs.columns, docs.schema
    at = names.index("text")

    def run(batches_):
        for batch in batches_:
            for lo in range(0, batch.num_rows, 256):
                part, texts = batch.slice(lo, 256), []
                for text, mark, starts in zip(part["text"].to_pylist(), part["cut mark"].to_pylist(), part["cut starts"].to_pylist(), strict=True):
                    if mark:
                        n, begin, end, raw = _kept(text, mark, starts, window)
                        all_begin = bounds(np.frombuffer(raw, np.uint8))[0]
                        nxt = np.append(all_begin[1:], len(raw))[np.searchsorted(all_begin, begin)]
                        text = b"".join(raw[b:e] for b, e in zip(begin.tolist(), nxt.tolist(), strict=True)).decode("utf-8", "surrogatepass").rstrip(" \t\r\n\x0b\x0c")
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(names))], names)

    out = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in kinds.fields])
    return with_cuts(docs, covered(docs, window, anchor, batches)).mapInArrow(run, out)


def digests(docs: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for text, mark, starts in zip(part["text"].to_pylist(), part["cut mark"].to_pylist(), part["cut starts"].to_pylist(), strict=True):
                    n, begin, end, raw = _kept(text, mark, starts, window)
                    kept = b" ".join(raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)) if mark else b" ".join(raw.split())
                    rows.append((n, n - len(begin), hashlib.sha256(kept).hexdigest()))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *cols], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_cuts(plain, found).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: words that an earlier document has in a shared window of 50 go; n_chars follows the text."""
    out = dedup(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(docs, covered(docs))
