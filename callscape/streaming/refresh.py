"""Change-driven refresh: a stream of file contents keeps a project's snapshot up to date.

The stream carries (path, content, deleted); each micro-batch is one refresh
of the store, so a batch that is replayed after a failure changes nothing the
second time (contents are compared by hash).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.etl import refresh
from ..sources import repo
from ..sources.store import Store


def apply_batch(store: Store, batch: DataFrame) -> dict:
    """Fold one batch of changes into the store; of several changes of a path the one with the greatest seq counts."""
    latest = batch.groupBy("path").agg(F.max_by(F.struct("content", "deleted"), "seq").alias("c")).select("path", "c.content", "c.deleted")
    current = latest.where("not deleted").select("path", "content")
    if store.exists():
        old = store.table("sources").join(latest.select("path"), "path", "left_anti")
        current = current.unionByName(old)
    return refresh(store, repo.from_frame(current))


def follow(store: Store, changes: DataFrame, checkpoint: str, trigger: str = "10 seconds") -> StreamingQuery:
    """Start following a stream of (path, content, deleted, seq)."""
    return changes.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch)).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
