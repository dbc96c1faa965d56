"""Traversal and summaries of a graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import short_name
from ..model import Graph


def is_test(file: Column) -> Column:
    """Whether a path counts as test code."""
    return F.contains(file, F.lit("test")) | F.contains(file, F.lit("spec"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for what driver and executors share; a temporary one only where all tasks run in the driver's process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="callscape-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder, so lost executors cost no more than a step."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trace(graph: Graph, name: str, direction: str = "both", depth: int = 3, include_tests: bool = False, edge_types: tuple[str, ...] = ("CALLS",), by_start: DataFrame | None = None) -> DataFrame:
    """(id, depth) of the nodes within `depth` hops of the nodes called `name`, each at its least depth, starts left out.

    Breadth-first, one join of the frontier a step, at most five; nodes of test files are left out and block the way.
    Any direction but outbound and inbound means both.
    """
    depth = max(1, min(5, depth))
    nodes = graph.nodes if include_tests else graph.nodes.where(~is_test(F.col("file")))
    starts = by_start if by_start is not None else nodes.where((F.col("fqn") == name) | (short_name(F.col("fqn")) == name)).select("id")
    edges = graph.edges.where(F.col("kind").isin(*edge_types)).select("src", "dst")
    steps = {"outbound": [edges], "inbound": [edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))]}.get(direction)
    steps = steps or [edges, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))]
    links = cut(steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1]))  # every step reads them
    there = cut(nodes.select("id"))
    seen = cut(starts.select("id", F.lit(0).alias("depth")))
    frontier = seen.select("id")
    for d in range(1, depth + 1):
        reached = frontier.join(links, frontier.id == links.src).select(F.col("dst").alias("id")).distinct()
        fresh = cut(reached.join(there, "id", "left_semi").join(seen, "id", "left_anti").select("id", F.lit(d).alias("depth")))
        if d < depth and fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh.select("id")
    return seen.where("depth > 0")


def hops(graph: Graph, reached: DataFrame) -> DataFrame:
    """(name, label, file, depth) of a trace, by depth and then id order."""
    from ..model import unsigned_order

    rows = reached.join(graph.nodes, "id")
    return rows.orderBy("depth", unsigned_order(F.col("id"))).select(F.col("fqn").alias("name"), F.col("kind").alias("label"), "file", "depth")


def dead_code(graph: Graph, kinds: tuple[str, ...] = ("Function", "Method")) -> DataFrame:
    """Functions and methods that nothing calls or routes to."""
    used = graph.edges.where("kind in ('CALLS', 'ROUTES')").select(F.col("dst").alias("id")).distinct()
    return graph.nodes.where(F.col("kind").isin(*kinds)).join(used, "id", "left_anti")


def label_histogram(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy(F.col("kind").alias("label")).agg(F.count("*").alias("count"))


def edge_histogram(graph: Graph, compat: bool = False) -> DataFrame:
    """Edges by kind; `compat` counts everything but CALLS as ROUTES."""
    kind = F.when(F.col("kind") == "CALLS", "CALLS").otherwise("ROUTES") if compat else F.col("kind")
    return graph.edges.groupBy(kind.alias("type")).agg(F.count("*").alias("count"))


def architecture(graph: Graph) -> DataFrame:
    """One row: totals, functions with methods, routes, file extensions, files."""
    ext = F.nullif(F.regexp_extract("file", r"\.([^./]+)$", 1), F.lit(""))
    nodes = graph.nodes.agg(
        F.count("*").alias("total_nodes"),
        F.count_if(F.col("kind").isin("Function", "Method")).alias("functions"),
        F.count_if(F.col("kind") == "Route").alias("routes"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "File", ext))).alias("languages"),
        F.count_if(F.col("kind") == "File").alias("file_count"),
    )
    return nodes.crossJoin(graph.edges.agg(F.count("*").alias("total_edges")))  # of one row and one row
