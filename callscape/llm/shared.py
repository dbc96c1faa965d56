"""Places and helpers that the corpus operators have in common."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the word contracts: space, tab, LF, VT, FF, CR.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and
    all tasks run in the driver's own process a temporary folder will do; it
    is taken and remembered.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="callscape-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: What holds while a step is stored: its shuffle files go with the statement that wrote them, since what it stores is all that later
#: steps read, and Python workers get their rows in batches of few bytes, which bounds buffers on both sides.
STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def storing(spark: SparkSession, **more: str) -> Iterator[None]:
    """The settings of `STORING`, and `more` of spark.sql, as long as it lasts."""
    wanted = STORING | {f"spark.sql.{k}": v for k, v in more.items()}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a frame to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with storing(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a whole text column, to size partitions by."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def dense_ids(blocks: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number block rows from 0. One row stands for thousands of input rows, so a single ordered pass is small."""
    from pyspark.sql import Window

    return blocks.withColumn(name, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))


LONG, INT, STRING, BINARY, DOUBLE = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType(), T.DoubleType()


def schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


#: The pre-filter below has this many bits for each row that it is made from, but no more than the greatest number, so that it
#: can always be broadcast: 64 bits are one row, 2^25 bits are 12 MB.
FILTER_SHARE, FILTER_LEAST, FILTER_MOST = 16, 1 << 12, 1 << 25


def split_by_filter(big: DataFrame, keys: list[str], small: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that surely have no partner in `small`, rows that may have one), without a shuffle of `big`.

    A one-hash Bloom filter, sized by the rows of `small`, which should be stored. It only saves shuffling, the join that follows
    decides; beyond FILTER_MOST / FILTER_SHARE rows it lets more and more through.
    """
    bits = FILTER_LEAST
    wanted = min(FILTER_MOST, FILTER_SHARE * small.count())
    while bits < wanted:
        bits *= 2
    slot = F.pmod(F.xxhash64(*keys), F.lit(bits))
    marked = small.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("filter word")).agg(F.bit_or(_shifted("slot")).alias("filter bits"))
    words = F.broadcast(marked)
    probed = big.withColumn("filter slot", slot).withColumn("filter word", F.floor(F.col("filter slot") / 64)).join(words, "filter word", "left")
    there = F.coalesce(F.col("filter bits").bitwiseAND(_shifted("filter slot")) != 0, F.lit(False))
    return probed.where(~there).select(*big.columns), probed.where(there).select(*big.columns)


def _shifted(column: str):
    return F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 64) as int))")
