"""The store of a project: immutable parts of Parquet, and numbered manifests that name them.

A refresh adds parts that hold what it changed. The `files` table, one row a
file, says which part holds a file's facts and nodes (`version`) and which its
edges (`edge_version`); rows of older parts for it count no more. A manifest
names the parts of one state and is renamed into place under the next number
when all of them are written: readers take the greatest number, so they see
one whole state or the one before it, a failed run changes nothing, two
writers of one state cannot both succeed, and lost executors only cost
retries. Beyond `FAN` parts a refresh writes one part anew from all that
counts. All paths go through Spark's file systems.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.errors import StorageError

#: Parts of a table before they are written together.
FAN = 8
#: Tables in parts, and the column of `files` that says which part counts.
PARTED = {"facts": "version", "nodes": "version", "edges": "edge_version"}
#: Kinds of facts that are tables of their own to readers.
FACT_KINDS = ("defs", "calls", "imports", "routes")
MANIFEST = re.compile(r"manifest-(\d{10})\.json$")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self) -> list[str]:
        home = self._path(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(home)] if self._fs.exists(home) else []

    def manifests(self) -> list[int]:
        return sorted(int(m[1]) for name in self._list() if (m := MANIFEST.match(name)))

    def load(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/manifest-{number:010}.json"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self) -> dict | None:
        """The current manifest: version, parts by table, folders of whole tables, and the report of the refresh."""
        numbers = self.manifests()
        return self.load(numbers[-1]) if numbers else None

    def exists(self) -> bool:
        return bool(self.manifests())

    def put(self, table: str, df: DataFrame) -> str:
        """Write a part; its folder's name. Nothing reads it before a manifest names it."""
        folder = f"{table}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def part(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def commit(self, state: dict) -> None:
        """Make a state current; parts that neither it nor the one before it names are deleted."""
        numbers = self.manifests()
        number = state["version"]
        fresh, final = self._path(f"{self.path}/.next-{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest-{number:010}.json")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(fresh, final):
            raise StorageError("another refresh was faster")
        kept = [state, *(self.load(n) for n in numbers[-1:])]
        named = {folder for s in kept for folder in (*(f for parts in s["parts"].values() for _, f in parts), *s["tables"].values())}
        old = [f"manifest-{n:010}.json" for n in numbers[:-1]]
        for name in self._list():
            if name in old or re.match(r"(facts|nodes|edges|files|scip|occurrences)-", name) and name not in named:
                self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def whole(self, name: str, state: dict | None = None) -> DataFrame | None:
        state = state or self._known()
        return self.part(state["tables"][name]) if name in state["tables"] else None

    def live(self, name: str, state: dict | None = None, files: DataFrame | None = None) -> DataFrame:
        """The rows of a table in parts that count, of all files or of those among `files` (records with both versions)."""
        state = state or self._known()
        parts = state["parts"][name]
        if len(parts) == 1 and files is None:
            return self.part(parts[0][1])
        rows = None
        for version, folder in parts:
            own = self.part(folder).withColumn("version", F.lit(version).cast("long"))
            rows = own if rows is None else rows.unionByName(own)
        files = self.whole("files", state) if files is None else files
        return rows.join(files.select(F.col("path").alias("file"), F.col(PARTED[name]).alias("version")), ["file", "version"], "left_semi").select(*(c for c in rows.columns if c != "version"))

    def _known(self) -> dict:
        if (state := self.state()) is None:
            raise StorageError("there is no index here")
        return state

    def table(self, name: str) -> DataFrame:
        """A table as readers know it: files, nodes, edges, sources, or one kind of facts."""
        state = self._known()
        if name == "files":
            return self.whole("files", state).select("path", "content_hash", "mtime_ns", "lang")
        if name == "sources":
            return self.live("facts", state).where("content is not null").select(F.col("file").alias("path"), "content")
        if name in FACT_KINDS:
            return self.live("facts", state).select("file", "lang", F.explode(name).alias("x")).select("file", "lang", "x.*")
        if name == "edges":
            edges, more = self.live("edges", state).select("src", "dst", "kind"), self.whole("scip", state)
            return edges if more is None else edges.unionByName(more)
        return self.live(name, state)

    def graph(self) -> Graph:
        return Graph(self.table("nodes"), self.table("edges"))


def counts(graph: Graph) -> DataFrame:
    """One row of an index report."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    nodes = graph.nodes.agg(
        *(kind(k).alias(a) for k, a in zip(("File", "Module", "Function", "Class", "Struct", "Enum", "Trait", "Method", "Route"), ("files", "modules", "functions", "classes", "structs", "enums", "traits", "methods", "routes"), strict=True)),
        F.count("*").alias("total_nodes"),
    )
    edges = graph.edges.agg(kind("CALLS").alias("calls"), kind("SCIP").alias("scip_edges"))
    return nodes.crossJoin(edges)  # of one row and one row
