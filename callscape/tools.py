"""The structured tools: one method an entry, answers as plain dicts, errors as answers.

Fixed values, since clients know them by name: tools, their parameters, and the keys of answers.
"""

from __future__ import annotations

import json
import os
import re
import warnings
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.names import short_name
from .model import Graph, unsigned_order
from .operators import etl, traverse
from .plans.compiler import ROW_CAP, compile_query, execute
from .plans.errors import QueryError
from .sources import repo
from .sources import scip as wire
from .sources.store import Store

#: Properties of the schema answer.
PROPERTIES = {
    "Function": ["fqn", "file", "byte_start", "byte_end", "kind", "id"],
    "Class": ["fqn", "file", "byte_start", "byte_end", "kind", "id"],
    "Route": ["fqn", "file", "byte_start", "byte_end", "kind", "id"],
}


def failed(tool: str, what: str, advice: str) -> dict:
    return {"error": f"{tool}: {what} ({advice})".replace('"', "'")}


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether a pattern is one that the engine's regular expressions take: those of the JVM."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except (Py4JError, PySparkException):
        return False


def grep(sources: DataFrame, pattern: str, regex: bool = False, file_suffix: str | None = None, path_filter: str | None = None) -> DataFrame:
    """(file, line, content) of matching lines, lines from 1, of sources (path, content)."""
    rows = sources.select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    if file_suffix:
        rows = rows.where(F.endswith("file", F.lit(re.sub(r"^\*\.?", "", file_suffix) if file_suffix.startswith("*") else file_suffix)))
    if path_filter and compiles(rows.sparkSession, path_filter):
        rows = rows.where(F.col("file").rlike(path_filter))
    text = F.regexp_replace("text", r"\r?\n\z", "")  # a closing line end starts no line
    lines = rows.where(F.col("text") != "").select("file", F.posexplode(F.split(text, "\r?\n", -1)).alias("line", "content"))
    hit = F.col("content").rlike(pattern) if regex else F.contains("content", F.lit(pattern))
    return lines.where(hit).select("file", (F.col("line") + 1).alias("line"), "content")


def search_code_results(matches: DataFrame, mode: str, limit: int) -> DataFrame:
    """Answers in path order: compact (first match and count of a file), files (all files), full (all lines of files, taken
    while fewer than `limit` lines came before the file, so the last one may overshoot)."""
    if mode == "files":
        return matches.select("file").distinct().orderBy("file")
    if mode == "full":
        per_file = matches.groupBy("file").agg(F.count("*").alias("n"))
        # no file past the first `limit` ones can start below the limit, so a short sorted head is enough for the running sum
        head = per_file.orderBy("file").limit(limit)
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        taken = head.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < limit).select("file")
        return matches.join(taken, "file", "left_semi").orderBy("file", "line")
    first = F.min_by("content", "line").alias("content")
    return matches.groupBy("file").agg(F.min("line").alias("line"), first, F.count("*").alias("match_count")).orderBy("file").limit(limit)


def search_nodes(graph: Graph, label: str | None = None, name_pattern: str | None = None, file_pattern: str | None = None, query: str | None = None) -> DataFrame:
    """Nodes that pass all filters; a bad pattern filters nothing."""
    rows = graph.nodes
    if label is not None:
        rows = rows.where(F.lower("kind") == label.lower())
    if name_pattern is not None and compiles(rows.sparkSession, name_pattern):
        rows = rows.where(F.col("fqn").rlike(name_pattern))
    if file_pattern is not None and compiles(rows.sparkSession, file_pattern):
        rows = rows.where(F.col("file").rlike(file_pattern))
    if query is not None:
        rows = rows.where(F.contains(F.lower("fqn"), F.lit(query.lower())))
    return rows


def page_of(rows: DataFrame, offset: int, limit: int) -> tuple[DataFrame, int]:
    """Nodes of a page in id order, and the number of all. Ids fall into 4,096 ranges; only those that the page touches are sorted,
    so a page far behind costs no more than the first."""
    place = unsigned_order(F.col("id"))
    part = F.shiftright(place, 52)
    at, total, touched = 0, 0, []
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # 4,096 rows at most
        if total < offset + limit and total + r.n > offset:
            at, touched = (at if touched else total), [*touched, r.part]
        total += r.n
    if not touched:
        return rows.limit(0), total
    return rows.where(part.between(touched[0], touched[-1])).orderBy(place).offset(offset - at).limit(limit), total


class Tools:
    """Tools of one project: a source root and its store."""

    def __init__(self, spark: SparkSession, root: str, store: str | None = None):
        self.spark, self.root = spark, root
        self.store = Store(spark, store or os.path.join(root, ".callscape"))
        self.project = os.path.basename(os.path.abspath(root))

    def names(self) -> dict[str, Callable[..., dict]]:
        entries = (
            "index_repository search_graph query_graph trace_path trace_call_path get_code_snippet get_graph_schema get_architecture "
            "search_code list_projects delete_project index_status detect_changes manage_adr ingest_traces"
        ).split()
        return {n: getattr(self, n) for n in entries}

    def call(self, tool: str, **params: Any) -> dict:
        """Run a tool; whatever goes wrong becomes an error answer."""
        entry = self.names().get(tool)
        if entry is None:
            return failed(tool, "no such tool", f"there are {', '.join(self.names())}")
        try:
            return entry(**params)
        except Exception as e:  # noqa: BLE001  an answer, not a crash, is the tools' contract
            return failed(tool, str(e).splitlines()[0], "with the parameters " + ", ".join(sorted(params)))

    def call_json(self, tool: str, **params: Any) -> str:
        return json.dumps(self.call(tool, **params), default=str)

    def _ignored(self, tool: str, **params: Any) -> None:
        used = [k for k, v in params.items() if v is not None]
        if used:
            warnings.warn(f"{tool} does not use {', '.join(used)}", stacklevel=3)

    def _missing(self, tool: str) -> dict | None:
        return None if self.store.exists() else failed(tool, f"{self.project} has no index yet", "index_repository makes one")

    def index_repository(self, repo_path: str | None = None, mode: str | None = None, target_projects: list | None = None, persistence: bool | None = None, rebuild: bool = False, scip: str | None = None) -> dict:
        """`scip` is the path of a reference index, whose edges join the graph and follow it from then on."""
        self._ignored("index_repository", mode=mode, target_projects=target_projects, persistence=persistence)
        occurrences = wire.read(self.spark, scip) if scip else None
        report = etl.refresh(self.store, repo.read(self.spark, repo_path or self.root), rebuild, occurrences)
        return {"status": "indexed", "project": self.project, "root": self.root, **report}

    def search_graph(self, project: str | None = None, query: str | None = None, label: str | None = None, name_pattern: str | None = None, file_pattern: str | None = None, limit: int = 200, offset: int = 0, **ignored: Any) -> dict:
        self._ignored("search_graph", **ignored)
        if (missing := self._missing("search_graph")) is not None:
            return missing
        limit, offset = max(1, limit), max(0, offset)
        page, total = page_of(search_nodes(self.store.graph(), label, name_pattern, file_pattern, query), offset, limit)
        results = [r.asDict() for r in page.select(F.col("fqn").alias("name"), F.col("kind").alias("label"), "file", "byte_start", "byte_end").collect()]
        return {"results": results, "total": total, "has_more": total > offset + len(results), "offset": offset, "limit": limit, "semantic_results": []}

    def query_rows(self, query: str, max_rows: int | None = None) -> DataFrame:
        """The whole answer of a query, or its first rows, as a frame that stays with the executors; so no row cap is needed."""
        frame = compile_query(self.store.graph(), query)
        return frame if max_rows is None or max_rows < 0 else frame.limit(max_rows)

    def query_graph(self, query: str, project: str | None = None, max_rows: int | None = None) -> dict:
        """Rows as an answer of the driver's: the row cap holds, unless `max_rows` keeps the answer as small."""
        if (missing := self._missing("query_graph")) is not None:
            return missing
        few = max_rows is not None and max_rows >= 0
        try:
            frame = self.query_rows(query, max_rows) if few and max_rows <= ROW_CAP else execute(self.store.graph(), query)
        except QueryError as e:
            return {"error": str(e).replace('"', "'")}
        if few:
            frame = frame.limit(max_rows)
        rows = [r.asDict(recursive=True) for r in frame.collect()]
        return {"rows": rows, "total": len(rows)}

    def trace_path(self, function_name: str, project: str | None = None, direction: str = "both", depth: int = 3, include_tests: bool = False, **ignored: Any) -> dict:
        self._ignored("trace_path", **ignored)
        if (missing := self._missing("trace_path")) is not None:
            return missing
        graph, depth = self.store.graph(), max(1, min(5, depth))
        nodes = graph.nodes if include_tests else graph.nodes.where(~traverse.is_test(F.col("file")))
        starts = nodes.where((F.col("fqn") == function_name) | (short_name(F.col("fqn")) == function_name))
        first = starts.orderBy(unsigned_order(F.col("id"))).first()
        answer = {"function_name": function_name, "direction": direction, "depth": depth, "hops": []}
        if first is None:
            return answer | {"message": f"nothing is called '{function_name}'; search_graph lists what there is"}
        reached = traverse.trace(graph, function_name, direction, depth, include_tests, by_start=starts.select("id"))
        hops = [r.asDict() for r in traverse.hops(graph, reached).collect()]
        return answer | {"function_name": first.fqn, "hops": hops, "hop_count": len(hops)}

    def trace_call_path(self, **params: Any) -> dict:
        return self.trace_path(**params)

    def get_code_snippet(self, qualified_name: str, project: str | None = None, include_neighbors: bool | None = None) -> dict:
        self._ignored("get_code_snippet", include_neighbors=include_neighbors)
        if (missing := self._missing("get_code_snippet")) is not None:
            return missing
        graph = self.store.graph()
        hit = graph.nodes.where((F.col("fqn") == qualified_name) | (short_name(F.col("fqn")) == qualified_name))
        found = hit.orderBy(unsigned_order(F.col("id"))).limit(101).collect()
        if not found:
            return failed("get_code_snippet", f"nothing is called '{qualified_name}'", "search_graph lists what there is")
        if len(found) > 1 and found[0].fqn != qualified_name:
            return {"ambiguous": True, "suggestions": [r.fqn for r in found[:100]], "message": f"'{qualified_name}' names {len(found)} definitions; one of the suggestions names one"}
        r = found[0]
        text = self.store.table("sources").where(F.col("path") == r.file)
        cut = text.select(etl.byte_slice(F.col("content"), F.lit(r.byte_start), F.lit(r.byte_end)).alias("s")).first()
        return {"qualified_name": r.fqn, "label": r.kind, "file": r.file, "byte_start": r.byte_start, "byte_end": r.byte_end, "source": cut.s if cut else "<source not available>"}

    def get_graph_schema(self, project: str | None = None, compat: bool = False) -> dict:
        if (missing := self._missing("get_graph_schema")) is not None:
            return missing
        graph = self.store.graph()
        return {
            "project": project or self.project,
            "node_labels": [r.asDict() for r in traverse.label_histogram(graph).orderBy("label").collect()],
            "edge_types": [r.asDict() for r in traverse.edge_histogram(graph, compat).orderBy("type").collect()],
            "properties": PROPERTIES,
        }

    def get_architecture(self, project: str | None = None, aspects: list | None = None) -> dict:
        if (missing := self._missing("get_architecture")) is not None:
            return missing
        row = traverse.architecture(self.store.graph()).first().asDict()
        return {"project": self.project, "root": self.root, **row, "aspects": aspects or []}

    def search_code(self, pattern: str, project: str | None = None, file_pattern: str | None = None, path_filter: str | None = None, mode: str = "compact", context: int | None = None, regex: bool = False, limit: int = 10) -> dict:
        self._ignored("search_code", context=context)
        if (missing := self._missing("search_code")) is not None:
            return missing
        if regex and not compiles(self.spark, pattern):
            return failed("search_code", f"'{pattern}' is no regular expression", "without regex it is looked for as it stands")
        matches = grep(self.store.table("sources"), pattern, regex, file_pattern, path_filter).cache()
        total, limit = matches.count(), max(1, limit)
        results = [r.asDict() for r in search_code_results(matches, mode, limit).collect()]
        matches.unpersist()
        if mode == "files":
            return {"files": [r["file"] for r in results], "total_results": len(results), "total_grep_matches": total}
        return {"results": results, "total_results": len(results), "total_grep_matches": total, "truncated": total > len(results)}

    def list_projects(self) -> dict:
        if not self.store.exists():
            return {"projects": [{"name": self.project, "root": self.root, "indexed": False, "message": "no index yet"}]}
        return {"projects": [{"name": self.project, "root": self.root, "node_count": self.store.graph().nodes.count(), "indexed": True}]}

    def index_status(self, project: str | None = None) -> dict:
        if not self.store.exists():
            return {"project": project or self.project, "status": "not_indexed", "message": "no index yet; index_repository makes one"}
        graph = self.store.graph()
        return {"project": project or self.project, "status": "indexed", "node_count": graph.nodes.count(), "edge_count": graph.edges.count(), "store_path": self.store.path}

    def _stub(self, tool: str) -> dict:
        return failed(tool, "does nothing here", "its name is kept for clients that list it")

    def delete_project(self, **params: Any) -> dict:
        return self._stub("delete_project")

    def detect_changes(self, **params: Any) -> dict:
        return self._stub("detect_changes")

    def manage_adr(self, **params: Any) -> dict:
        return self._stub("manage_adr")

    def ingest_traces(self, **params: Any) -> dict:
        return self._stub("ingest_traces")


def to_dot(report: dict, root: str) -> str:
    """A Graphviz sketch of an index report: the project, its graph, and what the second holds."""
    name = root.replace('"', "'")
    inner = "\\n".join(f"{k}: {v}" for k, v in report.items() if isinstance(v, int))
    return f'digraph index {{\n  root [label="{name}"];\n  graph_ [label="{inner}"];\n  root -> graph_ [label="{report.get("calls", 0)} calls"];\n}}\n'
