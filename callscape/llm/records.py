"""Token-ID / binary output: length-delimited binary records with a separate offset index.

A shard is a Spark part file of frames, each

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload | LF

(little-endian). A payload is one serialized sequence: u8 item width in bytes
(2 or 4), u8 1 if the document has an id, i64 id, then the ids of its tokens.
The mask rotates a checksum and adds a constant, so that a checksum of data
that itself holds checksums stays strong. Frames are written as rows of
Spark's text writer, whose line separator is the closing LF: any file system
that Spark can write will do, and its commit protocol covers retried,
speculative and lost tasks. Shards follow one another in ascending document
order; the index holds the shard, offset and length of every frame for
shuffled reads.

Defined results: null and empty texts give the end token only; rows with a
null doc_id come first; repeated doc_ids each give a record, ordered by
text hash (rows that are equal in both are dealt out over shards like others);
an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BINARY, INT, LONG, STRING, materialize, schema, shared_dir, table, text_bytes
from .tokens import encoder

#: Fixed value: what masking adds to a rotated checksum.
MASK_DELTA = 0xA282EAD8
HEAD, TAIL, META = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<BBq")
#: Text bytes that a shard is made from; a shard is read as one value, so this bounds a reader's memory.
SHARD_BYTES = 16 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, TAIL.pack(masked(length)), payload, TAIL.pack(masked(payload))))


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each frame of a shard; raises ValueError on a damaged one."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError(f"record at {at}: cut off")
        length, crc = HEAD.unpack_from(data, at)
        if crc != masked(view[at : at + 8]):
            raise ValueError(f"record at {at}: damaged length")
        start, end = at + HEAD.size, at + HEAD.size + length
        if end + TAIL.size > len(data):
            raise ValueError(f"record at {at}: cut off")
        payload = view[start:end]
        if TAIL.unpack_from(data, end)[0] != masked(payload):
            raise ValueError(f"record at {at}: damaged payload")
        yield at, payload
        at = end + TAIL.size + 1


def serialize(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return META.pack(width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, known, doc_id = META.unpack_from(payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=META.size)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode (doc_id, text) and write the shards under `path`/shards, in ascending doc_id order.

    The one shuffle deals texts out by ranges of doc_id; encoding and framing follow in the same task.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n = max(1, -(-text_bytes(docs) // shard_bytes))
    order = ["doc_id", "tie", "row"]  # the last tells equal rows apart, so that any number of them can be cut into ranges
    docs = docs.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = docs.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches):
        enc = encoder(vocabulary)
        width = 2 if max(enc.vocab_size, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [frame(serialize(d, np.concatenate((np.frombuffer(enc(t), "<u4"), end)), width)) for d, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    dealt.mapInArrow(encode, schema(value=BINARY)).select(F.col("value").cast("string")).write.option("lineSep", "\n").text(f"{path}/shards")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/shards").select(
        F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "path", "content"
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record: shard, offset, frame length, doc_id, and ids as little-endian u32 bytes. Checks all checksums."""

    def parse(batches):
        for batch in batches:
            for shard, content in zip(batch["shard"].to_pylist(), batch["content"], strict=True):
                data, rows = content.as_buffer().to_pybytes() if content.is_valid else b"", []
                for at, payload in frames(data):
                    doc_id, ids = deserialize(payload)
                    rows.append((shard, at, len(payload), doc_id, ids.astype("<u4").tobytes()))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "offset", "length", "doc_id", "ids"])

    return _shards(spark, path).select("shard", "content").mapInArrow(parse, schema(shard=INT, offset=LONG, length=LONG, doc_id=LONG, ids=BINARY))


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Read the shards and write `path`/index: for each record its shard, offset, length, doc_id, tokens, tokens before it in its shard, and crc32 of its ids."""
    found = read(spark, path).select("shard", "offset", "length", "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    before = Window.partitionBy("shard").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    found.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def shard_starts(index: DataFrame, fan: int = 4096) -> DataFrame:
    """(shard, base): the tokens in all shards before. Two levels of prefix sums, so no task sees more than `fan` shards or blocks."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("shard") / fan))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("n").alias("bn")).select("block", F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("block_base"))
    within = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(blocks, "block").select("shard", (F.col("block_base") + F.col("inner")).alias("base"))


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records in an order drawn by `seed`: the index is permuted, shards give up the frames it asks for."""
    index = spark.read.parquet(f"{path}/index").select("shard", "offset", F.xxhash64(F.lit(seed), "shard", "offset").alias("key"))
    return read(spark, path).join(index, ["shard", "offset"]).orderBy("key", "shard", "offset").select("doc_id", "ids")


def op1_token_records(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "records")
    write(table(spark, sf_dir, "documents"), path, vocabulary or public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    index = build_index(spark, path)
    starts = shard_starts(index)
    return index.join(starts, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard", "offset")
