"""The graph model: kinds, schemas, identity, and the frames that make a graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds by ordinal.
NODE_KINDS = ("File", "Module", "Function", "Class", "Struct", "Enum", "Trait", "Method", "Route")
EDGE_KINDS = ("CALLS", "ROUTES", "SCIP")

NODES = "id long, fqn string, kind string, file string, byte_start long, byte_end long"
EDGES = "src long, dst long, kind string"
FILES = "path string, content_hash binary, mtime_ns long, lang string"
DEFS = "file string, lang string, kind string, name string, byte_start long, byte_end long"
CALLS = "file string, lang string, name string, receiver string, byte_start long"
IMPORTS = "file string, name string, module string"
ROUTES = "file string, method string, pattern string, handler_name string, byte_start long, byte_end long, handler_line long"


@dataclass(frozen=True)
class Graph:
    """Node and edge frames of one project. Ids are 64-bit and count as unsigned."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession


def ordinal(kind: Column, kinds: tuple[str, ...]) -> Column:
    """Position of a kind; unknown kinds come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, kinds)), kind), F.lit(0)) - 1, F.lit(255)).cast("int")


def unsigned_order(node_id: Column) -> Column:
    """Sort key of an id taken as unsigned."""
    return node_id.bitwiseXOR(F.lit(-(2**63)))


def unsigned(node_id: Column) -> Column:
    """An id as the unsigned number it stands for."""
    wide = node_id.cast("decimal(20,0)")
    return F.when(node_id < 0, (wide + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)


def node_id(file: Column, fqn: Column, kind: Column, byte_start: Column) -> Column:
    """Identity of a node: a 64-bit hash of what makes it unique. Native, so ids cost no Python."""
    return F.xxhash64(file, fqn, ordinal(kind, NODE_KINDS), byte_start.cast("long"))


def edge_set(edges: DataFrame) -> DataFrame:
    """Edges are a set."""
    return edges.select("src", "dst", "kind").distinct()
