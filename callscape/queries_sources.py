"""Registered queries from source text to graph, store and tools, with equivalent SQL.

Source files are written from rows: every part becomes a file in one of twelve
languages with a function, a type and a method, whose calls go to the next
part's file and to their own; suppliers become files with web routes. One
template in SQL gives both sides the contents; what is in them the engine has
to find by reading, the SQL knows from the template.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .model import Graph
from .operators import etl, evaluate, scip, spans, traverse
from .plans.compiler import compile_query, execute
from .plans.errors import ExecuteError
from .sources import repo
from .sources import scip as wire
from .sources.store import Store
from .tools import Tools

#: For each language: extension, separator and prefix of its names, and the texts of a function, a type and a method, with what
#: is before and between them. {k} is the file's number, {n} the next one's.
LANGUAGES = (
    ("rs", "src::p{k}::", "", "fn f{k}() { f{n}(); }", "\n", "struct S{k} { x: u32 }", "\nimpl S{k} { ", "fn m{k}() { f{k}(); }", " }\n", "Function", "Struct", ("Function", "Method")),
    ("py", "src.p{k}.", "", "def f{k}():\n    return f{n}()", "\n\n", "class S{k}:\n    x = 1\n    {m}", "", "def m{k}(self):\n        return f{k}()", "\n", "Function", "Class", ("Function", "Method")),
    ("js", "src/p{k}/", "", "function f{k}() { return f{n}(); }", "\n", "class S{k} { {m} }", "", "m{k}() { return f{k}(); }", "\n", "Function", "Class", ("Method",)),
    ("ts", "src/p{k}/", "", "function f{k}(): number { return f{n}(); }", "\n", "class S{k} { {m} }", "", "m{k}(): number { return f{k}(); }", "\n", "Function", "Class", ("Method",)),
    ("tsx", "src/p{k}/", "", "function f{k}(): number { return f{n}(); }", "\n", "class S{k} { {m} }", "", "m{k}(): number { return f{k}(); }", "\n", "Function", "Class", ("Method",)),
    ("go", "src/", "package p\n", "func f{k}() int { return f{n}() }", "\n", "type S{k} struct { x int }", "\n", "func (s *S{k}) m{k}() int { return f{k}() }", "\n", "Function", "Function", ("Method",)),
    ("java", "src.p{k}.", "", "int f{k}() { return f{n}(); }", "", "class S{k} { {f} {m} }", "", "int m{k}() { return f{k}(); }", "\n", "Method", "Class", ("Method",)),
    ("cpp", "src::p{k}::", "", "int f{k}() { return f{n}(); }", "\n", "class S{k} { {m} }", "", "int m{k}() { return f{k}(); }", ";\n", "Function", "Class", ("Method",)),
    ("cs", "src.p{k}.", "", "int f{k}() { return f{n}(); }", "", "class S{k} { {f} {m} }", "", "int m{k}() { return f{k}(); }", "\n", "Method", "Class", ("Method",)),
    ("php", "src\\p{k}\\", "<?php\n", "function f{k}() { return f{n}(); }", "\n", "class S{k} { {m} }", "", "function m{k}() { return f{k}(); }", "\n", "Function", "Class", ("Method",)),
    ("scala", "src.p{k}.", "", "def f{k}() = { f{n}() }", "\n", "class S{k} { {m} }", "", "def m{k}() = { f{k}() }", "\n", "Function", "Class", ("Function", "Method")),
    ("lua", "src.p{k}.", "", "function f{k}() return f{n}() end", "\n", None, "", "local function m{k}() return f{k}() end", "\n", "Function", None, ("Function",)),
)


def _text(template: str) -> str:
    """A template as an SQL expression over k; both engines read it the same way."""
    parts, at = [], 0
    for i, c in enumerate(template):
        if c == "{" and template[i : i + 3] in ("{k}", "{n}"):
            parts += [repr_sql(template[at:i]), "k" if template[i + 1] == "k" else "(k + 1)"]
            at = i + 3
    parts.append(repr_sql(template[at:]))
    return f"concat({', '.join(p for p in parts if p != repr_sql(''))})" if len(parts) > 1 else parts[0]


def repr_sql(text: str) -> str:
    """A string literal without any escapes: line ends, backslashes and quotes by number."""
    out, plain = [], ""
    for c in text:
        if c in "\n\t\\'":
            out += [f"'{plain}'"] if plain else []
            out.append(f"chr({ord(c)})")
            plain = ""
        else:
            plain += c
    out += [f"'{plain}'"] if plain or not out else []
    return out[0] if len(out) == 1 else f"concat({', '.join(out)})"


def _file(lang: tuple) -> tuple[str, str, str | None, str]:
    """Whole content of a language's file, and the texts of its function, type and method."""
    _, _, start, f, between, t, before, m, end, *_ = lang
    if t is None:
        return start + f + between + m + end, f, None, m
    whole = t.replace("{f}", f).replace("{m}", m)
    body = start + (f + between if "{f}" not in t else "") + whole + before + ("" if "{m}" in t else m) + end
    return body, f, whole, m


def _cases(of) -> str:
    return "CASE k % 12 " + " ".join(f"WHEN {i} THEN {of(lang)}" for i, lang in enumerate(LANGUAGES)) + " END"


CONTENT = _cases(lambda lang: _text(_file(lang)[0]))
PATH = _cases(lambda lang: _text("src/p{k}." + lang[0]))
FILES_SQL = f"SELECT k, {PATH} AS path, {CONTENT} AS content FROM (SELECT p_partkey AS k FROM $table)"


def _declared() -> str:
    """(k, path, content, fqn, kind, decl, what) of every definition, as the templates have them."""
    rows = []
    for i, lang in enumerate(LANGUAGES):
        _, f, t, m = _file(lang)
        own = [("f", lang[9], f), *([("S", lang[10], t)] if t else []), *(("m", kind, m) for kind in lang[11])]
        for letter, kind, decl in own:
            rows.append(f"SELECT k, path, content, {_text(lang[1] + letter + '{k}')} AS fqn, '{kind}' AS kind, {_text(decl)} AS decl, '{letter}' AS what FROM files WHERE k % 12 = {i}")
    return " UNION ALL ".join(rows)


WITH = f"WITH files AS ({FILES_SQL.replace('$table', 'part')}), decls AS ({_declared()}), defs AS (SELECT *, strpos(content, decl) - 1 AS byte_start, strpos(content, decl) - 1 + strlen(decl) AS byte_end FROM decls) "
#: A call is made by the first kind of its definition; the next part's function is what `f{n}` resolves to.
CALLS = ", fs AS (SELECT * FROM defs WHERE what = 'f'), ms AS (SELECT * FROM defs WHERE what = 'm' QUALIFY row_number() OVER (PARTITION BY k ORDER BY kind) = 1) "
CALL_EDGES = CALLS + ", edges AS (SELECT a.fqn AS src, a.kind AS src_kind, b.fqn AS dst, b.kind AS dst_kind FROM fs a JOIN fs b ON b.k = a.k + 1 UNION ALL SELECT m.fqn, m.kind, b.fqn, b.kind FROM ms m JOIN fs b ON b.k = m.k) "

ROUTE_FILES = (
    ("CASE k % 4 WHEN 0 THEN concat('api/s', k, '.py') WHEN 1 THEN concat('api/s', k, '.go') WHEN 2 THEN concat('api/s', k, '.js') ELSE concat('api/t', k, '.js') END"),
    "CASE k % 4 WHEN 0 THEN " + _text('from fastapi import FastAPI\napp = FastAPI()\n\n@app.get("/s/{k}")\ndef h{k}(x):\n    return x\n')
    + " WHEN 1 THEN " + _text('package p\nimport "github.com/gin-gonic/gin"\nfunc h{k}(c *gin.Context) {}\nfunc setup{k}() {\n\tr := gin.Default()\n\tr.GET("/s/{k}", h{k})\n}\n')
    + " WHEN 2 THEN " + _text("const express = require('express');\nfunction h{k}(req, res) { res.json({k}); }\napp.post('/s/{k}', h{k});\n")
    + " ELSE " + _text("function h{k}(req, res) { res.json({k}); }\napp.post('/s/{k}', h{k});\n") + " END",
)
ROUTE_FILES_SQL = f"SELECT k, {ROUTE_FILES[0]} AS path, {ROUTE_FILES[1]} AS content FROM (SELECT s_suppkey AS k FROM $table)"
ROUTE_WITH = f"WITH files AS ({ROUTE_FILES_SQL.replace('$table', 'supplier')}) "

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def _table(sf_dir: str, name: str) -> str:
    return f"parquet.`{sf_dir}/{name}.parquet`"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.from_frame(spark.sql(FILES_SQL.replace("$table", _table(sf_dir, "part"))).select("path", "content"))


def route_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.from_frame(spark.sql(ROUTE_FILES_SQL.replace("$table", _table(sf_dir, "supplier"))).select("path", "content"))


def _graph(make):
    """The graph of some sources, its facts stored once: they come from Python."""

    def of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Graph]:
        facts = traverse.cut(etl.facts_of(make(spark, sf_dir)))
        return facts, etl.graph_of(facts)

    return of


source_graph, route_graph = _graph(sources), _graph(route_sources)


def _ends(graph: Graph) -> DataFrame:
    end = lambda side: graph.nodes.select(F.col("id").alias(side), F.col("fqn").alias(f"{side}_fqn"), F.col("kind").alias(f"{side}_kind"))
    rows = graph.edges.join(end("src"), "src").join(end("dst"), "dst")
    return rows.select(F.col("src_fqn").alias("src"), "src_kind", F.col("dst_fqn").alias("dst"), "dst_kind")


# definitions, calls and edges of twelve languages

_register("a4_extracted_definitions", lambda s, d: etl.exploded(etl.facts_of(sources(s, d)), "defs").select("file", "kind", "name", "byte_start", "byte_end"), WITH + "SELECT path AS file, kind, concat(what, k) AS name, byte_start, byte_end FROM defs")
_register("h5_definition_nodes", lambda s, d: source_graph(s, d)[1].nodes.where("kind <> 'File'").select("fqn", "kind", "file", "byte_start", "byte_end"), WITH + "SELECT fqn, kind, path AS file, byte_start, byte_end FROM defs")
_register("h5_file_nodes", lambda s, d: source_graph(s, d)[1].nodes.where("kind = 'File'").select("fqn", "file", "byte_start", "byte_end"), WITH + "SELECT path AS fqn, path AS file, CAST(0 AS BIGINT) AS byte_start, strlen(content) AS byte_end FROM files")
_register("h10_call_sites", lambda s, d: etl.exploded(etl.facts_of(sources(s, d)), "calls").select("file", "name", "byte_start"), WITH + CALLS + "SELECT path AS file, concat('f', k + 1) AS name, byte_start + strpos(decl, concat('f', k + 1, '(')) - 1 AS byte_start FROM fs UNION ALL SELECT path, concat('f', k), byte_start + strpos(decl, concat('f', k, '(')) - 1 FROM ms")
_register("h18_call_edges", lambda s, d: _ends(source_graph(s, d)[1]), WITH + CALL_EDGES + "SELECT src, src_kind, dst, dst_kind FROM edges")
_register("l11_dead_code_of_sources", lambda s, d: traverse.dead_code(source_graph(s, d)[1]).select("fqn", "kind"), WITH + CALL_EDGES + "SELECT fqn, kind FROM defs WHERE kind IN ('Function', 'Method') AND (fqn, kind) NOT IN (SELECT dst, dst_kind FROM edges)")
_register("e11_languages_seen", lambda s, d: etl.languages_seen(sources(s, d)).select(F.explode("languages").alias("lang")), "SELECT unnest(['rust', 'python', 'javascript', 'typescript', 'tsx', 'go', 'java', 'cpp', 'csharp', 'php', 'scala', 'lua']) AS lang")

# routes

_ROUTES = ", r AS (SELECT k, path, concat(CASE k % 4 WHEN 2 THEN 'POST' ELSE 'GET' END, ' /s/', k) AS fqn, concat(CASE k % 4 WHEN 0 THEN concat('api.s', k, '.') WHEN 1 THEN 'api/' ELSE concat('api/s', k, '/') END, 'h', k) AS handler FROM files WHERE k % 4 < 3) "
_register("h20_frameworks_of_sources", lambda s, d: route_sources(s, d).select("path", names.framework(F.col("lang"), F.col("content").cast("string")).alias("framework")), ROUTE_WITH + "SELECT path, CASE k % 4 WHEN 0 THEN 'fastapi' WHEN 1 THEN 'gin' WHEN 2 THEN 'express' END AS framework FROM files")
_register("h21_extracted_routes", lambda s, d: etl.exploded(etl.facts_of(route_sources(s, d)), "routes").select("file", "method", "pattern", "handler_name"), ROUTE_WITH + "SELECT path AS file, CASE k % 4 WHEN 2 THEN 'POST' ELSE 'GET' END AS method, concat('/s/', k) AS pattern, concat('h', k) AS handler_name FROM files WHERE k % 4 < 3")
_register("h22_route_nodes", lambda s, d: route_graph(s, d)[1].nodes.where("kind = 'Route'").select("fqn", "file"), ROUTE_WITH + _ROUTES + "SELECT fqn, path AS file FROM r")


def _route_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = route_graph(spark, sf_dir)[1]
    return _ends(Graph(graph.nodes, graph.edges.where("kind = 'ROUTES'")))


_register("h23_route_edges", _route_edges, ROUTE_WITH + _ROUTES + "SELECT fqn AS src, 'Route' AS src_kind, handler AS dst, 'Function' AS dst_kind FROM r")
_register("h11_extracted_imports", lambda s, d: etl.exploded(etl.facts_of(route_sources(s, d)), "imports").select("file", "name", "module"), ROUTE_WITH + "SELECT path AS file, CASE k % 4 WHEN 0 THEN 'FastAPI' WHEN 1 THEN 'gin' ELSE 'express' END AS name, CASE k % 4 WHEN 0 THEN 'fastapi' WHEN 1 THEN 'github.com/gin-gonic/gin' ELSE 'express' END AS module FROM files WHERE k % 4 < 3")


def _only_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of files with a definition and, at the end, of none: a flag leaves the latter out."""
    bare = spark.sql(f"SELECT concat('bare/n', n_nationkey, '.py') AS path, concat('f', n_nationkey, '()') AS content FROM {_table(sf_dir, 'nation')} UNION ALL SELECT concat('full/n', n_nationkey, '.py'), concat('def g(): pass', chr(10), 'f', n_nationkey, '()') FROM {_table(sf_dir, 'nation')}")
    calls = lambda flag: etl.exploded(etl.facts_of(repo.from_frame(bare), flag), "calls").select("file", "name", F.lit(flag).alias("only_defined"))
    return calls(False).unionByName(calls(True))


_register("h32_only_defined_files", _only_defined, "SELECT concat(p, '/n', n_nationkey, '.py') AS file, concat('f', n_nationkey) AS name, o AS only_defined FROM nation, (VALUES ('bare', false), ('full', false), ('full', true)) t(p, o)")


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT concat('n', n_nationkey, '.py') AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'def (' ELSE 'def ok(): pass' END AS content FROM {_table(sf_dir, 'nation')}")
    return etl.facts_of(repo.from_frame(rows)).select("file", F.col("error").isNotNull().alias("failed"), F.size("defs").alias("definitions"))


_register("h34_skip_on_error", _broken, "SELECT concat('n', n_nationkey, '.py') AS file, n_nationkey % 2 = 0 AS failed, CAST(n_nationkey % 2 AS INTEGER) AS definitions FROM nation")

# snippets: bytes of definitions, cut from the texts


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, graph = source_graph(spark, sf_dir)
    rows = graph.nodes.where("kind <> 'File'").join(facts.select("file", "content"), "file")
    return rows.select("fqn", "kind", etl.byte_slice(F.col("content"), F.col("byte_start"), F.col("byte_end")).alias("source"))


_register("a16_definition_texts", _snippets, WITH + "SELECT fqn, kind, decl AS source FROM defs")


# store and refresh: the tree of parts, then with some files edited and some gone

_EDITED = "SELECT path, CASE WHEN k % 7 = 0 THEN concat(content, chr(10)) ELSE content END AS content FROM files WHERE k % 10 <> 3"
_stores: dict[tuple[str, str, bool], tuple[Store, dict]] = {}


def store_of(spark: SparkSession, sf_dir: str, edited: bool) -> tuple[Store, dict]:
    """A store of the sources, and the report of its last refresh: built once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, edited)
    if key not in _stores:
        store = Store(spark, f"{traverse.shared_folder(spark)}/store-{uuid.uuid4().hex[:12]}")
        report = etl.refresh(store, sources(spark, sf_dir))
        if edited:
            rows = spark.sql(f"WITH files AS ({FILES_SQL.replace('$table', _table(sf_dir, 'part'))}) {_EDITED}")
            report = etl.refresh(store, repo.from_frame(rows))
        _stores[key] = store, report
    return _stores[key]


def tools_of(spark: SparkSession, sf_dir: str) -> Tools:
    store, _ = store_of(spark, sf_dir, False)
    tools = Tools(spark, "/project/parts", store.path)
    return tools


_NUMBERS = ("new", "unchanged", "modified", "deleted", "files", "modules", "functions", "classes", "structs", "enums", "traits", "methods", "routes", "total_nodes", "calls", "scip_edges")


def _report(report: dict, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, int(report[k])) for k in _NUMBERS], "name string, n long")


def _report_sql(prefix: str, changes: str) -> str:
    kinds = {"modules": "Module", "functions": "Function", "classes": "Class", "structs": "Struct", "enums": "Enum", "traits": "Trait", "methods": "Method", "routes": "Route"}
    rows = [f"SELECT '{k}' AS name, count(*) AS n FROM defs WHERE kind = '{v}'" for k, v in kinds.items()]
    rows += ["SELECT 'files', count(*) FROM files", "SELECT 'total_nodes', (SELECT count(*) FROM files) + (SELECT count(*) FROM defs)", "SELECT 'calls', count(*) FROM edges", "SELECT 'scip_edges', 0"]
    return prefix + " UNION ALL ".join([*rows, changes])


_PLAIN = "SELECT 'new', count(*) FROM files UNION ALL SELECT 'unchanged', 0 UNION ALL SELECT 'modified', 0 UNION ALL SELECT 'deleted', 0"
_register("j1_index_report", lambda s, d: _report(store_of(s, d, False)[1], s), _report_sql(WITH + CALL_EDGES, _PLAIN))


def _again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unchanged tree: the fast path writes nothing."""
    store = store_of(spark, sf_dir, False)[0]
    before = store.manifests()
    report = etl.refresh(store, sources(spark, sf_dir))
    return _report(report | {"scip_edges": len(store.manifests()) - len(before)}, spark)


_register("h30_fast_path", _again, _report_sql(WITH + CALL_EDGES, _PLAIN.replace("'new', count(*)", "'unchanged', count(*)").replace("'unchanged', 0", "'new', 0")))

_AFTER = WITH.replace("WITH files AS (", "WITH whole AS (").replace("), decls AS", f"), files AS (SELECT k, path, CASE WHEN k % 7 = 0 THEN concat(content, chr(10)) ELSE content END AS content FROM whole WHERE k % 10 <> 3), decls AS", 1)
_register("h24_refreshed_nodes", lambda s, d: store_of(s, d, True)[0].graph().nodes.select("fqn", "kind", "file", "byte_start", "byte_end"), _AFTER + "SELECT fqn, kind, path AS file, byte_start, byte_end FROM defs UNION ALL SELECT path, 'File', path, 0, strlen(content) FROM files")
_register("h33_refreshed_edges", lambda s, d: _ends(store_of(s, d, True)[0].graph()), _AFTER + CALL_EDGES + "SELECT src, src_kind, dst, dst_kind FROM edges")
_register("e10_refresh_report", lambda s, d: _report(store_of(s, d, True)[1], s), _report_sql(_AFTER + CALL_EDGES, "SELECT 'new', 0 UNION ALL SELECT 'unchanged', count(*) FROM whole WHERE k % 10 <> 3 AND k % 7 <> 0 UNION ALL SELECT 'modified', count(*) FROM whole WHERE k % 10 <> 3 AND k % 7 = 0 UNION ALL SELECT 'deleted', count(*) FROM whole WHERE k % 10 = 3"))
_register("a8_file_records", lambda s, d: store_of(s, d, True)[0].table("files").select("path", F.lower(F.hex("content_hash")).alias("content_hash"), "lang"), _AFTER + "SELECT path, sha256(content) AS content_hash, " + _cases(lambda lang: "'" + {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "cs": "csharp"}.get(lang[0], lang[0]) + "'") + " AS lang FROM files")
_register("a12_stored_sources", lambda s, d: store_of(s, d, True)[0].table("sources").select("path", F.col("content").cast("string").alias("content")), _AFTER + "SELECT path, content FROM files")


# the structured tools, over the store of parts


def _rows(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    columns = [c.split()[0] for c in kind.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], kind)


_register("j3_query_graph", lambda s, d: tools_of(s, d).query_rows("MATCH (a:Method)-[:CALLS]->(b:Function) RETURN a.fqn AS src, b.fqn AS dst"), WITH + CALL_EDGES + "SELECT src, dst FROM edges WHERE src_kind = 'Method' AND dst_kind = 'Function'")
_register("f10_max_rows", lambda s, d: _rows(s, [tools_of(s, d).call("query_graph", query="MATCH (n:Class) RETURN n.fqn", max_rows=n) for n in (0, 7)], "total long"), "SELECT unnest([0, 7]) AS total")
_register("b5_property_of_a_projected_node", lambda s, d: compile_query(store_of(s, d, False)[0].graph(), "MATCH (n:Struct) RETURN n ORDER BY n.byte_start, n.file LIMIT 20").select("n.fqn", "n.file"), WITH + "SELECT fqn, path AS file FROM defs WHERE kind = 'Struct' ORDER BY byte_start, path LIMIT 20")


def _row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether caps of one row less than a pattern has, and of just as many, stop a query."""
    graph = store_of(spark, sf_dir, False)[0].graph()
    n = graph.nodes.count()

    def stopped(cap: int) -> bool:
        try:
            execute(graph, "MATCH (n) RETURN n.fqn LIMIT 1", row_cap=cap)
            return False
        except ExecuteError:
            return True

    return spark.createDataFrame([(n - 1, stopped(n - 1)), (n, stopped(n))], "row_cap long, stopped boolean")


_register("f9_row_cap", _row_cap, WITH + ", n AS (SELECT (SELECT count(*) FROM files) + (SELECT count(*) FROM defs) AS n) SELECT n - 1 AS row_cap, true AS stopped FROM n UNION ALL SELECT n, false FROM n")


def _traced(tool: str):
    return lambda s, d: _rows(s, tools_of(s, d).call(tool, function_name="src.p1.m1", direction="outbound", depth=4)["hops"], "name string, label string, file string, depth int")


_TRACE = WITH + CALL_EDGES + ", walk AS (SELECT k + 1 AS depth, fqn AS name, kind AS label, path AS file FROM (SELECT * REPLACE (k - 1 AS k) FROM fs WHERE k BETWEEN 1 AND 4)) SELECT name, label, file, CAST(depth AS INTEGER) AS depth FROM walk"
_register("j4_trace_path", _traced("trace_path"), _TRACE)
_register("j5_trace_call_path", _traced("trace_call_path"), _TRACE)
_register("j6_get_code_snippet", lambda s, d: _rows(s, [tools_of(s, d).call("get_code_snippet", qualified_name=n) for n in ("src::p12::S12", "src.p25.f25", "src/p2/f2")], "qualified_name string, label string, file string, byte_start long, byte_end long, source string"), WITH + "SELECT fqn AS qualified_name, kind AS label, path AS file, byte_start, byte_end, decl AS source FROM defs WHERE fqn IN ('src::p12::S12', 'src.p25.f25', 'src/p2/f2')")
_register("j7_get_graph_schema", lambda s, d: _rows(s, (lambda a: [{"what": "node", "name": r["label"], "n": r["count"]} for r in a["node_labels"]] + [{"what": "edge", "name": r["type"], "n": r["count"]} for r in a["edge_types"]])(tools_of(s, d).call("get_graph_schema")), "what string, name string, n long"), WITH + CALL_EDGES + "SELECT 'node' AS what, kind AS name, count(*) AS n FROM defs GROUP BY kind UNION ALL SELECT 'node', 'File', count(*) FROM files UNION ALL SELECT 'edge', 'CALLS', count(*) FROM edges")


def _architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = tools_of(spark, sf_dir).call("get_architecture")
    return spark.createDataFrame([(answer["total_nodes"], answer["total_edges"], answer["functions"], answer["routes"], answer["file_count"], ",".join(answer["languages"]))], "total_nodes long, total_edges long, functions long, routes long, file_count long, languages string")


_register("j8_get_architecture", _architecture, WITH + CALL_EDGES + "SELECT (SELECT count(*) FROM files) + (SELECT count(*) FROM defs) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM defs WHERE kind IN ('Function', 'Method')) AS functions, CAST(0 AS BIGINT) AS routes, (SELECT count(*) FROM files) AS file_count, 'cpp,cs,go,java,js,lua,php,py,rs,scala,ts,tsx' AS languages")
_register("j10_list_projects", lambda s, d: _rows(s, tools_of(s, d).call("list_projects")["projects"], "name string, root string, node_count long, indexed boolean"), WITH + "SELECT 'parts' AS name, '/project/parts' AS root, (SELECT count(*) FROM files) + (SELECT count(*) FROM defs) AS node_count, true AS indexed")
_register("j12_index_status", lambda s, d: _rows(s, [tools_of(s, d).call("index_status")], "project string, status string, node_count long, edge_count long"), WITH + CALL_EDGES + "SELECT 'parts' AS project, 'indexed' AS status, (SELECT count(*) FROM files) + (SELECT count(*) FROM defs) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
_register("f11_search_page", lambda s, d: _rows(s, [tools_of(s, d).call("search_graph", label="class", limit=5, offset=n) | {"first": n} for n in (0, 10**6)], "first long, total long, has_more boolean"), WITH + "SELECT t.i AS first, n.total, n.total > t.i + 5 AS has_more FROM (SELECT count(*) AS total FROM defs WHERE kind = 'Class') n, (VALUES (0), (1000000)) t(i)")
_register("j11_j15_kept_names", lambda s, d: _rows(s, [{"tool": t, "error": "error" in tools_of(s, d).call(t)} for t in ("delete_project", "detect_changes", "manage_adr", "ingest_traces")], "tool string, error boolean"), "SELECT unnest(['delete_project', 'detect_changes', 'manage_adr', 'ingest_traces']) AS tool, true AS error")
_register("a14_tool_json", lambda s, d: s.createDataFrame([(json.loads(tools_of(s, d).call_json("index_status"))["status"],)], "status string"), "SELECT 'indexed' AS status")


# external reference indexes, over Python files written from customers: a definition, and a second one that refers to the next file's

PY = "concat('def g', k, '():', chr(10), '    pass', chr(10), 'def u', k, '():', chr(10), '    g', k + 1, '()', chr(10))"
PY_FILES = f"SELECT k, concat('c', k, '.py') AS path, {PY} AS content FROM (SELECT c_custkey AS k FROM $table)"
#: (document, ordinal, symbol, roles, position): two definitions, a reference, a local one and one to nothing.
OCCURRENCES = """
SELECT concat('c', k, '.py') AS document, 0 AS ordinal, concat('s m p v `c', k, '`/g', k, '().') AS symbol, 1 AS symbol_roles, 0 AS line, 4 AS col, 1 AS end_line, 8 AS end_col FROM c
UNION ALL SELECT concat('c', k, '.py'), 1, concat('s m p v `c', k, '`/u', k, '().'), 1, 2, 4, 3, 12 FROM c
UNION ALL SELECT concat('c', k, '.py'), 2, concat('s m p v `c', k + 1, '`/g', k + 1, '().'), 0, 3, 4, 3, 6 FROM c
UNION ALL SELECT concat('c', k, '.py'), 3, 'local 1', 0, 3, 4, 3, 6 FROM c
UNION ALL SELECT concat('c', k, '.py'), 4, '', 0, 3, 4, 3, 6 FROM c
"""
PY_WITH = f"WITH c AS (SELECT c_custkey AS k FROM customer), o AS ({OCCURRENCES}) "


def _py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PY_FILES.replace("$table", _table(sf_dir, "customer")))


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"WITH c AS (SELECT c_custkey AS k FROM {_table(sf_dir, 'customer')}) {OCCURRENCES}")
    extent = F.when(F.col("symbol_roles") == 1, F.array("line", F.lit(0), "end_line", "end_col")).otherwise(F.array().cast("array<int>"))
    return rows.select("document", "ordinal", "symbol", "symbol_roles", F.array("line", "col", F.col("col") + 2).alias("range"), extent.alias("enclosing_range"))


def _scip(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = _py(spark, sf_dir)
    facts = traverse.cut(etl.facts_of(repo.from_frame(files)))
    nodes = etl.nodes_of(facts)
    return nodes, *scip.scip_edges(_occurrences(spark, sf_dir), files.select(F.col("path").alias("document"), F.col("content").alias("text")), nodes)


def _scip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = _scip(spark, sf_dir)
    return _ends(Graph(nodes, edges))


_register("h28_scip_edges", _scip_edges, PY_WITH + "SELECT concat('c', k, '.u', k) AS src, 'Function' AS src_kind, concat('c', k + 1, '.g', k + 1) AS dst, 'Function' AS dst_kind FROM c WHERE k + 1 IN (SELECT k FROM c)")
_register("h28_scip_report", lambda s, d: _scip(s, d)[2], PY_WITH + ", n AS (SELECT count(*) AS emitted FROM c WHERE k + 1 IN (SELECT k FROM c)) SELECT 2 * (SELECT count(*) FROM c) AS seen, emitted, 2 * (SELECT count(*) FROM c) - emitted AS skipped FROM n")
_register("h25_references", lambda s, d: scip.references(_occurrences(s, d)).select("document", "ordinal", "symbol"), PY_WITH + "SELECT document, ordinal, symbol FROM o WHERE symbol_roles = 0 AND symbol <> ''")
_register("h27_symbol_keys", lambda s, d: _occurrences(s, d).select("document", "ordinal", names.symbol_key(F.col("symbol")).alias("name_key")), PY_WITH + "SELECT document, ordinal, regexp_extract(symbol, '/([a-z0-9]+)', 1) AS name_key FROM o WHERE symbol LIKE 's %' UNION ALL SELECT document, ordinal, NULL FROM o WHERE symbol NOT LIKE 's %'")
_register("i2_extracted_references", lambda s, d: evaluate.extract_refs(_occurrences(s, d)).select("path", "line", "col", "symbol"), PY_WITH + "SELECT document AS path, line, col, CASE WHEN symbol LIKE 'local %' THEN symbol ELSE concat('. . . . ', string_split(symbol, ' ')[5]) END AS symbol FROM o WHERE symbol_roles = 0 AND symbol <> ''")
_register("i4_index_edge_pairs", lambda s, d: evaluate.scip_edge_pairs(_occurrences(s, d)), PY_WITH + "SELECT concat('u', k) AS caller, concat('g', k + 1) AS callee FROM c")
_register("g7_references_to_definitions", lambda s, d: evaluate.rewrite_to_definitions(_occurrences(s, d)).select("path", "line", "col", "symbol", "def_path", "def_line", "def_col"), PY_WITH + "SELECT a.document AS path, a.line, a.col, a.symbol, b.document AS def_path, b.line AS def_line, b.col AS def_col FROM o a JOIN o b ON b.symbol = a.symbol AND b.symbol_roles = 1 WHERE a.symbol_roles = 0")


def _enclosing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position of a grid over the lines of a file, and the symbol whose extent holds it."""
    occ = _occurrences(spark, sf_dir)
    own = occ.where("symbol_roles = 1").select("document", "ordinal", "symbol", *(F.get("enclosing_range", F.lit(i)).alias(c) for i, c in enumerate(("start_line", "start_col", "end_line", "end_col"))))
    grid = occ.select("document").distinct().select("document", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("line"), F.lit(3).alias("col"))
    return spans.enclosing_lines(grid, own)


_register("d10_enclosing_lines", _enclosing_lines, PY_WITH + "SELECT concat('c', k, '.py') AS document, CAST(line AS INTEGER) AS line, 3 AS col, concat('s m p v `c', k, '`/', CASE WHEN line < 2 THEN 'g' ELSE 'u' END, k, '().') AS enclosing_symbol FROM c, range(0, 4) l(line)")


def _message(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of nations in its protobuf form, written to the shared folder and read back."""
    documents = []
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect():  # 25 rows
        one = _message(1, _varint(r.n_nationkey * 40) + _varint(3) + _varint(9)) + _message(2, f"s m p v {r.n_name}.".encode()) + _varint(3 << 3) + _varint(r.n_nationkey % 2)
        documents.append(_message(2, _message(1, f"n{r.n_nationkey}.py".encode()) + _message(2, one)))
    store = Store(spark, traverse.shared_folder(spark))
    path = f"{store.path}/index-{uuid.uuid4().hex[:12]}.scip"
    stream = store._fs.create(store._path(path), True)
    stream.write(bytearray(b"".join(documents)))
    stream.close()
    return wire.read(spark, path).select("document", "ordinal", "symbol", "symbol_roles", F.col("range")[0].alias("line"), F.size("enclosing_range").alias("extent"))


_register("a9_reference_index", _index_file, "SELECT concat('n', n_nationkey, '.py') AS document, 0 AS ordinal, concat('s m p v ', n_name, '.') AS symbol, CAST(n_nationkey % 2 AS INTEGER) AS symbol_roles, CAST(n_nationkey * 40 AS INTEGER) AS line, 0 AS extent FROM nation")
