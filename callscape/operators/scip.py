"""Edges from external reference indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fqn_tail, symbol_key
from ..model import edge_set
from .spans import enclosing


def line_offsets(texts: DataFrame) -> DataFrame:
    """(document, line, line_start): byte offset of each line of (document, text)."""
    lines = texts.select("document", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    before = Window.partitionBy("document").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("document", "line", F.coalesce(F.sum(F.octet_length("content") + 1).over(before), F.lit(0)).alias("line_start"))


def references(occurrences: DataFrame) -> DataFrame:
    """Occurrences that refer: not definitions, with a symbol."""
    return occurrences.where((F.col("symbol_roles").bitwiseAND(1) == 0) & (F.col("symbol") != ""))


def scip_edges(occurrences: DataFrame, texts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(SCIP edges, one row of references seen, edges emitted and references skipped).

    The caller is the smallest node around a reference, file nodes included; the callee is the first node whose name tail is
    the symbol's key. Columns of positions count bytes.
    """
    known = references(occurrences).join(texts.select("document").distinct(), "document", "left_semi")
    spot = known.select("document", F.col("range")[0].alias("line"), F.col("range")[1].alias("col"), "symbol")
    at = spot.join(line_offsets(texts), ["document", "line"]).select(F.col("document").alias("file"), (F.col("line_start") + F.col("col")).alias("at"), symbol_key(F.col("symbol")).alias("key"))
    order = F.struct("file", "byte_start", "id")
    first = nodes.groupBy(fqn_tail(F.col("fqn")).alias("key")).agg(F.min_by("id", order).alias("dst"))
    bound = at.join(first, "key")
    around = enclosing(bound, nodes).where("id_found is not null and id_found <> dst")
    edges = edge_set(around.select(F.col("id_found").alias("src"), "dst", F.lit("SCIP").alias("kind")))
    report = known.agg(F.count("*").alias("seen")).crossJoin(edges.agg(F.count("*").alias("emitted")))  # of one row and one row
    return edges, report.withColumn("skipped", F.greatest(F.col("seen") - F.col("emitted"), F.lit(0)))
