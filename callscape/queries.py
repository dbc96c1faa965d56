"""Registered queries over the driver's tables, and equivalent SQL.

The tables stand in for a project: a fixture graph is projected from the star
schema, documents stand for source files, and reference indexes are derived
from orders and line items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_sources
from .functions import names
from .model import Graph, edge_set
from .operators import etl, evaluate, scip, spans, traverse
from .plans.compiler import compile_query, json_lines
from .tools import grep, search_code_results, search_nodes

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

NODES_SQL = """
SELECT 1000000000000 + r_regionkey AS id, r_name AS fqn, 'File' AS kind, r_name AS file, 0 AS byte_start, 100 AS byte_end FROM {region}
UNION ALL SELECT 2000000000000 + n_nationkey, concat(r_name, '.', n_name), 'Module', r_name, 0, n_nationkey + 1 FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 3000000000000 + c_custkey, concat(n_name, '.', c_name), 'Class', c_mktsegment, 0, n_nationkey + 1 FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT 4000000000000 + o_orderkey, concat('order.', CAST(o_orderkey AS STRING)), 'Function', o_orderpriority, CAST(o_orderkey % 1000 AS INT), CAST(o_orderkey % 1000 + 50 AS INT) FROM {orders}
UNION ALL SELECT 5000000000000 + p_partkey, concat(p_brand, '.', p_name, '.', CAST(p_partkey AS STRING)), 'Method', p_type, p_size, p_size + 10 FROM {part}
UNION ALL SELECT 6000000000000 + s_suppkey, concat(n_name, '.', s_name), 'Struct', n_name, 0, 10 FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 7000000000000 + user_id * 10 + CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END, concat(upper(event_type), ' /users/', CAST(user_id AS STRING)), 'Route', 'events', 0, 1 FROM {events}
"""

EDGES_SQL = """
SELECT 3000000000000 + o_custkey AS src, 4000000000000 + o_orderkey AS dst, 'CALLS' AS kind FROM {orders}
UNION SELECT 4000000000000 + l_orderkey, 5000000000000 + l_partkey, 'CALLS' FROM {lineitem}
UNION SELECT 5000000000000 + l_partkey, 6000000000000 + l_suppkey, 'CALLS' FROM {lineitem}
UNION SELECT 7000000000000 + user_id * 10 + CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END, 3000000000000 + user_id, 'ROUTES' FROM {events}
UNION SELECT 3000000000000 + c_custkey, 2000000000000 + c_nationkey, 'SCIP' FROM {customer}
UNION SELECT 6000000000000 + s_suppkey, 2000000000000 + s_nationkey, 'SCIP' FROM {supplier}
UNION SELECT 2000000000000 + n_nationkey, 1000000000000 + n_regionkey, 'SCIP' FROM {nation}
"""

#: Paths that documents get, so that every language and prefix rule occurs.
PATHS_SQL = """
SELECT doc_id, text, CASE doc_id % 14
  WHEN 0 THEN concat('src/m', doc_id, '/mod.rs') WHEN 1 THEN concat('pkg/m', doc_id, '/__init__.py') WHEN 2 THEN concat('web/m', doc_id, '/index.js')
  WHEN 3 THEN concat('web/m', doc_id, '.ts') WHEN 4 THEN concat('web/v', doc_id, '.tsx') WHEN 5 THEN concat('srv/g', doc_id, '/main.go')
  WHEN 6 THEN concat('app/src/main/java/com/x/C', doc_id, '.java') WHEN 7 THEN concat('lib/c', doc_id, '.hpp') WHEN 8 THEN concat('net/N', doc_id, '.cs')
  WHEN 9 THEN concat('php/p', doc_id, '.php') WHEN 10 THEN concat('s/src/main/java/y/S', doc_id, '.scala') WHEN 11 THEN concat('l/m', doc_id, '.lua')
  WHEN 12 THEN concat('pkg/t', doc_id, '.py') ELSE concat('docs/readme', doc_id, '.md') END AS path
FROM {documents}
"""


def _sql(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


WITH = f"WITH nodes AS MATERIALIZED ({_sql(NODES_SQL)}), edges AS MATERIALIZED ({_sql(EDGES_SQL)}) "
FILES = f"WITH f AS ({_sql(PATHS_SQL)}) "


def _spark(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def fixture(spark: SparkSession, sf_dir: str) -> Graph:
    nodes = _spark(spark, sf_dir, NODES_SQL)
    nodes = nodes.select("id", "fqn", "kind", "file", F.col("byte_start").cast("long").alias("byte_start"), F.col("byte_end").cast("long").alias("byte_end"))
    return Graph(nodes, _spark(spark, sf_dir, EDGES_SQL))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, PATHS_SQL)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def _query(name: str, text: str, sql: str, **flags) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = compile_query(fixture(spark, sf_dir), text, **flags)
        return out.toDF(*(c.replace(".", "_") for c in out.columns))

    _register(name, run, WITH + sql)


# 2.A, 2.B, 2.C: scans, projection, predicates

_query("a5_label_scan", "MATCH (n:Module) RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'Module'")
_query("b1_project_properties", "MATCH (n:Struct) RETURN n.fqn, n.file, n.byte_start, n.byte_end, n.kind, n.id", "SELECT fqn AS n_fqn, file AS n_file, byte_start AS n_byte_start, byte_end AS n_byte_end, kind AS n_kind, id AS n_id FROM nodes WHERE kind = 'Struct'")
_query("b3_alias", "MATCH (n:File) RETURN n.fqn AS name", "SELECT fqn AS name FROM nodes WHERE kind = 'File'")
_query("b4_missing_property", "MATCH (n:File) WHERE n.colour IS NULL RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'File'")
_query("b6_duplicate_names", "MATCH (n:File) RETURN n.fqn AS x, n.byte_end AS x", "SELECT byte_end AS x FROM nodes WHERE kind = 'File'")
_query("c1_equal", "MATCH (n) WHERE n.file = 'BUILDING' AND n.byte_end = 5.0 RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE file = 'BUILDING' AND byte_end = 5")
_query("c1_null_equals_null", "MATCH (n:Module) WHERE n.nope = null RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'Module'")
_query("c2_not_equal", "MATCH (n:Module) WHERE n.file <> 'ASIA' AND n.nope != 'x' RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'Module' AND file <> 'ASIA'")
_query("c3_less_greater", "MATCH (n:Function) WHERE n.byte_start < 20 AND n.byte_end > 60.5 RETURN n.id", "SELECT id AS n_id FROM nodes WHERE kind = 'Function' AND byte_start < 20 AND byte_end > 60.5")
_query("c4_mixed_types_hold", "MATCH (n:File) WHERE n.fqn <= 3 AND n.nope >= 'a' RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'File'")
_query("c5_contains", "MATCH (n) WHERE n.fqn CONTAINS 'order.1' RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE contains(fqn, 'order.1')")
_query("c6_starts_with", "MATCH (n:Class) WHERE n.fqn STARTS WITH 'NATION_1' RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'Class' AND starts_with(fqn, 'NATION_1')")
_query("c7_ends_with", "MATCH (n) WHERE n.fqn ENDS WITH '99' RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE ends_with(fqn, '99')")
_query("c8_regex_is_false", "MATCH (n:File) WHERE NOT n.fqn =~ '.*' RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'File'")
_query("c8_real_regex", "MATCH (n:Class) WHERE n.fqn =~ '.*[02]7' RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'Class' AND regexp_full_match(fqn, '.*[02]7')", real_regex=True)
_query("c9_and_or", "MATCH (n) WHERE n.kind = 'File' OR n.kind = 'Module' AND n.byte_end > 20 RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'File' OR (kind = 'Module' AND byte_end > 20)")
_query("c10_not", "MATCH (n:Module) WHERE NOT n.byte_end > 3 AND NOT null RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'Module' AND NOT byte_end > 3")
_query("c11_truthiness", "MATCH (n:File) WHERE n.byte_start AND '' AND 0 RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'File'")
_query("c12_is_null", "MATCH (n:Module) WHERE n.fqn IS NOT NULL AND n.zip IS NULL RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'Module'")
_query("c13_head_properties", "MATCH (n:Method {byte_start: 7}) RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'Method' AND byte_start = 7")
_query("c15_hop_label_and_properties", "MATCH (a:Class)-[:SCIP]->(b:Module {byte_end: 4}) RETURN a.fqn, b.fqn", "SELECT a.fqn AS a_fqn, b.fqn AS b_fqn FROM nodes a JOIN edges e ON e.src = a.id JOIN nodes b ON b.id = e.dst WHERE a.kind = 'Class' AND e.kind = 'SCIP' AND b.kind = 'Module' AND b.byte_end = 4")
_query("c16_edge_types", "MATCH (a)-[r:routes|:Scip]->(b) RETURN a.id, r.kind, b.id", "SELECT a.id AS a_id, e.kind AS r_kind, b.id AS b_id FROM nodes a JOIN edges e ON e.src = a.id JOIN nodes b ON b.id = e.dst WHERE e.kind IN ('ROUTES', 'SCIP')")
_query("c17_edge_properties_ignored", "MATCH (a:Module)-[r:SCIP {kind: 'x'}]->(b) RETURN a.fqn, b.fqn", "SELECT a.fqn AS a_fqn, b.fqn AS b_fqn FROM nodes a JOIN edges e ON e.src = a.id JOIN nodes b ON b.id = e.dst WHERE a.kind = 'Module' AND e.kind = 'SCIP'")
_query("c18_number_promotion", "MATCH (n:Method) WHERE n.byte_start = 10.0 RETURN n.id", "SELECT id AS n_id FROM nodes WHERE kind = 'Method' AND CAST(byte_start AS DOUBLE) = 10.0")
_query("c19_string_order", "MATCH (n:Class) WHERE n.fqn > 'NATION_20' RETURN n.fqn", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'Class' AND fqn > 'NATION_20'")

# 2.D: patterns

HOP = "nodes a JOIN edges e ON e.src = a.id JOIN nodes b ON b.id = e.dst"
_query("d1_expand_out", "MATCH (a:Class)-[r:CALLS]->(b:Function) RETURN a.id, r.from, r.to, b.fqn", f"SELECT a.id AS a_id, e.src AS r_from, e.dst AS r_to, b.fqn AS b_fqn FROM {HOP} WHERE a.kind = 'Class' AND b.kind = 'Function' AND e.kind = 'CALLS'")
_query("d2_expand_in", "MATCH (b:Function)<-[r:CALLS]-(a) RETURN a.id, b.id", f"SELECT a.id AS a_id, b.id AS b_id FROM {HOP} WHERE b.kind = 'Function' AND e.kind = 'CALLS'")
_query("d3_undirected_forward", "MATCH (a:Module)-[r]-(b) RETURN a.id, b.id", f"SELECT a.id AS a_id, b.id AS b_id FROM {HOP} WHERE a.kind = 'Module'")
_query("d3_undirected_strict", "MATCH (a:Module)--(b) RETURN a.id, b.id", f"SELECT a.id AS a_id, b.id AS b_id FROM {HOP} WHERE a.kind = 'Module' UNION ALL SELECT b.id, a.id FROM {HOP} WHERE b.kind = 'Module' AND a.id <> b.id", strict_undirected=True)
_query("d4_two_hops", "MATCH (a:Route)-[:ROUTES]->(b)-[:SCIP]->(c) RETURN a.id, c.fqn", "SELECT a.id AS a_id, c.fqn AS c_fqn FROM nodes a JOIN edges e ON e.src = a.id AND e.kind = 'ROUTES' JOIN nodes b ON b.id = e.dst JOIN edges g ON g.src = b.id AND g.kind = 'SCIP' JOIN nodes c ON c.id = g.dst WHERE a.kind = 'Route'")
_query("d4_three_hops", "MATCH (r:Route)-[:ROUTES]->(c:Class)-[:CALLS]->(f:Function)-[:CALLS]->(m:Method) WHERE m.byte_start < 3 RETURN r.id, m.id", "SELECT r.id AS r_id, m.id AS m_id FROM nodes r JOIN edges e ON e.src = r.id AND e.kind = 'ROUTES' JOIN nodes c ON c.id = e.dst AND c.kind = 'Class' JOIN edges g ON g.src = c.id AND g.kind = 'CALLS' JOIN nodes f ON f.id = g.dst AND f.kind = 'Function' JOIN edges h ON h.src = f.id AND h.kind = 'CALLS' JOIN nodes m ON m.id = h.dst AND m.kind = 'Method' WHERE r.kind = 'Route' AND m.byte_start < 3")
_query("d5_no_uniqueness", "MATCH (a:Struct)-[:SCIP]->(b)<-[:SCIP]-(c:Struct) RETURN a.id, c.id", "SELECT a.id AS a_id, c.id AS c_id FROM nodes a JOIN edges e ON e.src = a.id AND e.kind = 'SCIP' JOIN nodes b ON b.id = e.dst JOIN edges g ON g.dst = b.id AND g.kind = 'SCIP' JOIN nodes c ON c.id = g.src AND c.kind = 'Struct' WHERE a.kind = 'Struct'")
_query("d6_rebinding", "MATCH (a:Module)-[:SCIP]->(a) RETURN a.fqn", f"SELECT b.fqn AS a_fqn FROM {HOP} WHERE a.kind = 'Module' AND e.kind = 'SCIP'")


# 2.F: order, slices, distinct

_query("f1_order_limit", "MATCH (n:Function) RETURN n.fqn, n.byte_start ORDER BY n.byte_start DESC, n.fqn LIMIT 50", "SELECT fqn AS n_fqn, byte_start AS n_byte_start FROM nodes WHERE kind = 'Function' ORDER BY byte_start DESC, fqn LIMIT 50")
_query("f2_unprojected_key", "MATCH (n:Function) RETURN n.id AS x ORDER BY n.fqn LIMIT 7", "SELECT id AS x FROM nodes WHERE kind = 'Function' ORDER BY id LIMIT 7")
_query("f3_alias_key", "MATCH (n:Class) RETURN n.fqn AS name ORDER BY name DESC LIMIT 9", "SELECT fqn AS name FROM nodes WHERE kind = 'Class' ORDER BY fqn DESC LIMIT 9")
_query("f5_skip_limit", "MATCH (n:Method) RETURN n.fqn SKIP 11 LIMIT 13", "SELECT fqn AS n_fqn FROM nodes WHERE kind = 'Method' ORDER BY id LIMIT 13 OFFSET 11")
_query("f7_distinct", "MATCH (a:Class)-[:CALLS]->(b) RETURN DISTINCT b.file", f"SELECT DISTINCT b.file AS b_file FROM {HOP} WHERE a.kind = 'Class' AND e.kind = 'CALLS'")
_query("f8_implicit_order", "MATCH (a:Function)-[:CALLS]->(b) RETURN a.id, b.id SKIP 100 LIMIT 40", f"SELECT a.id AS a_id, b.id AS b_id FROM {HOP} WHERE a.kind = 'Function' AND e.kind = 'CALLS' ORDER BY a.id, b.id LIMIT 40 OFFSET 100")


def _whole_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compile_query(fixture(spark, sf_dir), "MATCH (n:Module) RETURN n ORDER BY n.fqn LIMIT 5").select("n.*")
    return out.withColumn("id", F.col("id").cast("long"))


_register("b2_whole_node", _whole_node, WITH + "SELECT id, fqn, kind, file, CAST(byte_start AS BIGINT) AS byte_start, CAST(byte_end AS BIGINT) AS byte_end FROM nodes WHERE kind = 'Module' ORDER BY fqn LIMIT 5")


def _distinct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge counts by its ends: a second kind between the same ends is no new row."""
    g = fixture(spark, sf_dir)
    twice = Graph(g.nodes, g.edges.unionByName(g.edges.where("kind = 'SCIP'").withColumn("kind", F.lit("ROUTES"))))
    return compile_query(twice, "MATCH (a)-[r]->(b) RETURN DISTINCT r").select(F.col("r.from").cast("long").alias("src"), F.col("r.to").cast("long").alias("dst"), F.col("r.kind").alias("kind"))


_register("f7_distinct_edges", _distinct_edges, WITH + "SELECT src, dst, CASE WHEN kind = 'SCIP' THEN 'ROUTES' ELSE kind END AS kind FROM edges")


def _json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_lines(compile_query(fixture(spark, sf_dir), "MATCH (n:File) RETURN n.fqn AS a, n.nope AS b, n.byte_end AS c"))


_register("a13_json_lines", _json_rows, WITH + """SELECT concat('{"a":"', fqn, '","b":null,"c":', byte_end, '}') AS value FROM nodes WHERE kind = 'File'""")


# 2.E, 2.J: traversal, summaries, tools

_REACH = """, walk AS (
  WITH RECURSIVE steps AS (SELECT src, dst FROM edges WHERE kind = 'CALLS'), links AS ({links}),
  w AS (SELECT id, 0 AS d FROM nodes WHERE {start} UNION SELECT l.dst, w.d + 1 FROM w JOIN links l ON l.src = w.id WHERE w.d < {depth})
  SELECT id, min(d) AS depth FROM w GROUP BY id
) SELECT n.fqn AS name, n.kind AS label, n.file, CAST(w.depth AS INTEGER) AS depth FROM walk w JOIN nodes n ON n.id = w.id WHERE w.depth > 0"""
_OUT, _IN = "SELECT src, dst FROM steps", "SELECT dst AS src, src AS dst FROM steps"


def _trace(name: str, start: str, direction: str, depth: int, links: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = fixture(spark, sf_dir)
        starts = g.nodes.where(start).select("id")
        return traverse.trace(g, "", direction, depth, include_tests=True, by_start=starts).join(g.nodes, "id").select(F.col("fqn").alias("name"), F.col("kind").alias("label"), "file", "depth")

    _register(name, run, WITH + _REACH.format(links=links, start=start, depth=depth))


_trace("e9_trace_outbound", "id = 3000000000007", "outbound", 3, _OUT)
_trace("e9_trace_inbound", "id = 6000000000003", "inbound", 2, _IN)
_trace("d14_trace_both", "id = 5000000000011", "both", 2, f"{_OUT} UNION ALL {_IN}")

_register("e1_count_by_kind", lambda s, d: fixture(s, d).nodes.groupBy("kind").agg(F.count("*").alias("n")), WITH + "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
_register("e2_edge_counts", lambda s, d: fixture(s, d).edges.agg(F.count_if(F.col("kind") == "CALLS").alias("calls"), F.count_if(F.col("kind") == "SCIP").alias("scip")), WITH + "SELECT count(*) FILTER (kind = 'CALLS') AS calls, count(*) FILTER (kind = 'SCIP') AS scip FROM edges")
_register("e3_total_nodes", lambda s, d: fixture(s, d).nodes.agg(F.count("*").alias("total_nodes")), WITH + "SELECT count(*) AS total_nodes FROM nodes")
_register("e4_label_histogram", lambda s, d: traverse.label_histogram(fixture(s, d)), WITH + "SELECT kind AS label, count(*) AS count FROM nodes GROUP BY kind")
_register("e5_edge_histogram", lambda s, d: traverse.edge_histogram(fixture(s, d)), WITH + "SELECT kind AS type, count(*) AS count FROM edges GROUP BY kind")
_register("e5_edge_histogram_compat", lambda s, d: traverse.edge_histogram(fixture(s, d), compat=True), WITH + "SELECT CASE WHEN kind = 'CALLS' THEN 'CALLS' ELSE 'ROUTES' END AS type, count(*) AS count FROM edges GROUP BY 1")


def _architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.architecture(fixture(spark, sf_dir)).select("total_nodes", "total_edges", "functions", "routes", "file_count", F.array_join("languages", ",").alias("languages"))


_register("e6_architecture", _architecture, WITH + "SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM nodes WHERE kind IN ('Function', 'Method')) AS functions, (SELECT count(*) FROM nodes WHERE kind = 'Route') AS routes, (SELECT count(*) FROM nodes WHERE kind = 'File') AS file_count, '' AS languages")
_register("l11_dead_code", lambda s, d: traverse.dead_code(fixture(s, d), ("Class", "Struct", "Method")).select("fqn"), WITH + "SELECT fqn FROM nodes WHERE kind IN ('Class', 'Struct', 'Method') AND id NOT IN (SELECT dst FROM edges WHERE kind IN ('CALLS', 'ROUTES'))")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search_nodes(fixture(spark, sf_dir), label="class", name_pattern="_1[0-9]\\.", file_pattern="^B", query="nation")
    return rows.orderBy("id").offset(3).limit(200).select(F.col("fqn").alias("name"), F.col("kind").alias("label"), "file", "byte_start", "byte_end")


_register("j2_search_graph", _search, WITH + r"SELECT fqn AS name, kind AS label, file, byte_start, byte_end FROM nodes WHERE kind = 'Class' AND regexp_matches(fqn, '_1[0-9]\.') AND regexp_matches(file, '^B') AND contains(lower(fqn), 'nation') ORDER BY id LIMIT 200 OFFSET 3")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", F.col("text").cast("binary").alias("content"))


_LINES = FILES + ", l AS (SELECT path AS file, generate_subscripts(s, 1) AS line, unnest(s) AS content FROM (SELECT path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS s FROM f WHERE text IS NOT NULL AND regexp_replace(text, '\\n$', '') <> '')), m AS (SELECT * FROM l WHERE contains(content, 'License')) "
_register("j9_search_code_full", lambda s, d: grep(_sources(s, d), "License").select("file", F.col("line").cast("long").alias("line"), "content"), _LINES + "SELECT file, CAST(line AS BIGINT) AS line, content FROM m")
_register("j9_search_code_compact", lambda s, d: search_code_results(grep(_sources(s, d), "License"), "compact", 25).select("file", F.col("line").cast("long").alias("line"), "content", "match_count"), _LINES + "SELECT file, CAST(min(line) AS BIGINT) AS line, arg_min(content, line) AS content, count(*) AS match_count FROM m GROUP BY file ORDER BY file LIMIT 25")
_register("j9_search_code_files", lambda s, d: search_code_results(grep(_sources(s, d), "[0-9]{3}-[0-9]{4}", regex=True, file_suffix="*.py"), "files", 5), _LINES.replace("contains(content, 'License')", "regexp_matches(content, '[0-9]{3}-[0-9]{4}') AND ends_with(file, 'py')") + "SELECT DISTINCT file FROM m")


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 3 to 9 of the paths, which are plain ASCII, and the whole where the range is out of bounds."""
    end = F.when(F.col("doc_id") % 3 == 0, 10_000).otherwise(9)
    return files(spark, sf_dir).select("path", etl.byte_slice(F.col("path"), F.lit(3), end).alias("snippet"))


_register("a16_snippets", _snippets, FILES + "SELECT path, CASE WHEN doc_id % 3 = 0 THEN path ELSE substring(path, 4, 6) END AS snippet FROM f")


# 2.G, 2.H: sets, changes, names

_register("g1_edge_set", lambda s, d: edge_set(fixture(s, d).edges.unionByName(fixture(s, d).edges)), WITH + "SELECT DISTINCT src, dst, kind FROM edges")
_register("g3_union_kinds", lambda s, d: edge_set(fixture(s, d).edges.where("kind <> 'SCIP'").unionByName(fixture(s, d).edges.where("kind = 'SCIP'"))), WITH + "SELECT src, dst, kind FROM edges")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    h = lambda c: F.unhex(F.sha2(c, 256)).alias("content_hash")
    previous = f.where("doc_id % 5 <> 0").select("path", h(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return etl.classify(previous, f.where("doc_id % 11 <> 0").select("path", h(F.col("text"))))


_CHANGES = FILES + ", p AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END AS t FROM f WHERE doc_id % 5 <> 0), c AS (SELECT path, text AS t FROM f WHERE doc_id % 11 <> 0), s AS (SELECT coalesce(p.path, c.path) AS path, CASE WHEN p.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted' WHEN p.t = c.t THEN 'unchanged' ELSE 'modified' END AS status FROM p FULL OUTER JOIN c ON p.path = c.path) "
_register("h1_classify_changes", _changes, _CHANGES + "SELECT path, status FROM s")
_register("e10_change_counts", lambda s, d: etl.change_counts(_changes(s, d)), _CHANGES + "SELECT count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'deleted') AS deleted FROM s")
_register("d12_deleted_files", lambda s, d: _changes(s, d).where("status = 'deleted'").select("path"), _CHANGES + "SELECT path FROM s WHERE status = 'deleted'")
_register("h2_content_hash", lambda s, d: files(s, d).select("path", F.sha2("text", 256).alias("content_hash")), FILES + "SELECT path, sha256(text) AS content_hash FROM f")


def _sweep(part: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        gone = spark.createDataFrame([("BUILDING",), ("ASIA",)], "path string")
        return getattr(etl.sweep(fixture(spark, sf_dir), gone), part)

    return run


_DEAD = ", dead AS (SELECT id FROM nodes WHERE file IN ('BUILDING', 'ASIA')) "
_register("h24_sweep_nodes", _sweep("nodes"), WITH + _DEAD + "SELECT id, fqn, kind, file, CAST(byte_start AS BIGINT) AS byte_start, CAST(byte_end AS BIGINT) AS byte_end FROM nodes WHERE id NOT IN (SELECT id FROM dead)")
_register("d13_sweep_edges", _sweep("edges"), WITH + _DEAD + "SELECT src, dst, kind FROM edges WHERE src NOT IN (SELECT id FROM dead) AND dst NOT IN (SELECT id FROM dead)")

_LANG_SQL = "CASE WHEN ends_with(path, '.rs') THEN 'rust' WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.js') THEN 'javascript' WHEN ends_with(path, '.ts') THEN 'typescript' WHEN ends_with(path, '.tsx') THEN 'tsx' WHEN ends_with(path, '.go') THEN 'go' WHEN ends_with(path, '.java') THEN 'java' WHEN ends_with(path, '.hpp') THEN 'cpp' WHEN ends_with(path, '.cs') THEN 'csharp' WHEN ends_with(path, '.php') THEN 'php' WHEN ends_with(path, '.scala') THEN 'scala' WHEN ends_with(path, '.lua') THEN 'lua' END"
_register("a2_language", lambda s, d: files(s, d).select("path", names.language(F.col("path")).alias("lang")), FILES + f"SELECT path, {_LANG_SQL} AS lang FROM f")
_register("h13_family", lambda s, d: files(s, d).select("path", names.family(names.language(F.col("path"))).alias("family")), FILES + f"SELECT path, CASE WHEN ({_LANG_SQL}) IN ('python', 'typescript', 'javascript', 'tsx', 'php', 'lua') THEN 'A' WHEN ({_LANG_SQL}) IS NOT NULL THEN 'B' END AS family FROM f")
_register("fq_prefixes", lambda s, d: files(s, d).select("path", names.prefix(F.col("path"), names.language(F.col("path"))).alias("prefix")), FILES + r"""SELECT path, CASE doc_id % 14
  WHEN 0 THEN concat('src::m', doc_id) WHEN 1 THEN concat('pkg.m', doc_id) WHEN 2 THEN concat('web/m', doc_id) WHEN 3 THEN concat('web/m', doc_id) WHEN 4 THEN concat('web/v', doc_id)
  WHEN 5 THEN concat('srv/g', doc_id) WHEN 6 THEN concat('com.x.C', doc_id) WHEN 7 THEN concat('lib::c', doc_id) WHEN 8 THEN concat('net.N', doc_id) WHEN 9 THEN concat('php\p', doc_id)
  WHEN 10 THEN concat('y.S', doc_id) WHEN 11 THEN concat('l.m', doc_id) WHEN 12 THEN concat('pkg.t', doc_id) END AS prefix FROM f""")
_register("h7_last_segment", lambda s, d: fixture(s, d).nodes.select("id", names.last_segment(F.col("fqn")).alias("short")), WITH + r"SELECT id, regexp_extract(fqn, '([^:./\\]*)$', 1) AS short FROM nodes")
_register("h8_fqn_tail", lambda s, d: fixture(s, d).nodes.select("id", names.fqn_tail(F.col("fqn")).alias("tail")), WITH + "SELECT id, regexp_extract(fqn, '([^.]*)$', 1) AS tail FROM nodes")
_register("h9_short_name", lambda s, d: fixture(s, d).nodes.select("id", names.short_name(F.regexp_replace("fqn", r"\.", "::")).alias("short")), WITH + "SELECT id, regexp_extract(fqn, '([^.]*)$', 1) AS short FROM nodes")
_register("h12_strip_quotes", lambda s, d: files(s, d).select("path", names.strip_quotes(F.concat(F.lit(" '"), "path", F.lit("' "))).alias("bare")), FILES + "SELECT path, path AS bare FROM f")


def _frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file shows some framework."""
    f = files(spark, sf_dir)
    sign = F.element_at(F.array(*map(F.lit, ("import fastapi", "gin.Default()", 'from "express"'))), (F.col("doc_id") % 3 + 1).cast("int"))
    return f.select("path", names.framework(names.language(F.col("path")), F.concat("text", sign)).alias("framework"))


_register("h19_frameworks", _frameworks, FILES + f"SELECT path, CASE WHEN ({_LANG_SQL}) = 'python' AND doc_id % 3 = 0 THEN 'fastapi' WHEN ({_LANG_SQL}) = 'go' AND doc_id % 3 = 1 THEN 'gin' WHEN ({_LANG_SQL}) IN ('javascript', 'typescript', 'tsx') AND doc_id % 3 = 2 THEN 'express' END AS framework FROM f")


# 2.D, 2.H: enclosing spans and resolution

_SPANS = "SELECT path AS file, 1 AS id, 'Function' AS kind, 0 AS byte_start, n AS byte_end FROM {t} UNION ALL SELECT path, 2, 'Class', n // 4, n - n // 4 FROM {t} UNION ALL SELECT path, 3, 'Method', n // 3, n // 2 FROM {t}"


def _span_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = files(spark, sf_dir).where("text is not null").select(F.col("path").alias("file"), F.octet_length("text").cast("long").alias("n"))
    row = lambda i, k, a, b: f.select("file", F.lit(i).cast("long").alias("id"), F.lit(k).alias("kind"), F.expr(a).cast("long").alias("byte_start"), F.expr(b).cast("long").alias("byte_end"))
    own = row(1, "Function", "0", "n").unionByName(row(2, "Class", "n div 4", "n - n div 4")).unionByName(row(3, "Method", "n div 3", "n div 2"))
    probes = f.select("file", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k"), "n").select("file", "k", F.expr("n * k div 10").alias("at"))
    return probes, own


def _enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.enclosing(*_span_frames(spark, sf_dir)).select("file", F.col("k").cast("long").alias("k"), "id_found")


_register("d8_enclosing_definition", _enclosing, FILES + ", t AS (SELECT path, octet_length(encode(text)) AS n FROM f WHERE text IS NOT NULL), s AS (" + _SPANS.replace("{t}", "t") + "), p AS (SELECT path AS file, k, n * k // 10 AS at FROM t, range(0, 11) r(k)) SELECT p.file, p.k, (SELECT arg_min(CAST(s.id AS BIGINT), (s.byte_end - s.byte_start) * 1000000 + s.byte_start + CASE s.kind WHEN 'Function' THEN 0.1 WHEN 'Class' THEN 0.2 ELSE 0.3 END) FROM s WHERE s.file = p.file AND s.byte_start <= p.at AND p.at < s.byte_end) AS id_found FROM p")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, as called from their own type and from elsewhere."""
    g = fixture(spark, sf_dir)
    methods = g.nodes.where("kind = 'Method'")
    refs = methods.select("file", names.last_segment(F.col("fqn")).alias("short")).unionByName(methods.select(F.lit("elsewhere").alias("file"), names.last_segment(F.col("fqn")).alias("short")))
    return etl.resolve(refs, methods).select("file", "short", "target_id")


_register("d11_resolve_names", _resolved, WITH + ", m AS (SELECT *, regexp_extract(fqn, '([^:./\\\\]*)$', 1) AS short FROM nodes WHERE kind = 'Method'), r AS (SELECT file, short FROM m UNION ALL SELECT 'elsewhere', short FROM m), o AS (SELECT *, row_number() OVER (PARTITION BY file, short ORDER BY byte_start, id) AS a, row_number() OVER (PARTITION BY short ORDER BY file, byte_start, id) AS b FROM m) SELECT r.file, r.short, coalesce(x.id, y.id) AS target_id FROM r LEFT JOIN o x ON x.file = r.file AND x.short = r.short AND x.a = 1 LEFT JOIN o y ON y.short = r.short AND y.b = 1")


# 2.I: evaluation

_OCC = "SELECT concat('d', l_orderkey % 97) AS document, CAST(l_orderkey % 500 AS INT) AS line, CAST(l_linenumber * 3 AS INT) AS col, concat('s m p v `x`/F', l_partkey % 50, '().') AS symbol, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ordinal FROM {lineitem}"


def _refs(spark: SparkSession, sf_dir: str, shift: bool) -> DataFrame:
    """Reference rows; the tool's miss some positions and name some others wrongly."""
    rows = _spark(spark, sf_dir, _OCC).select(F.col("document").alias("path"), "line", "col", names.normalize_symbol(F.col("symbol")).alias("symbol"), "ordinal")
    if not shift:
        return rows
    wrong = F.when(F.col("ordinal") % 7 == 0, F.concat("symbol", F.lit("x"))).otherwise(F.col("symbol"))
    return rows.where("ordinal % 5 <> 0").withColumn("symbol", wrong)


_F1 = "WITH o AS (" + _sql(_OCC) + "), t AS (SELECT document, line, col, arg_min(symbol, ordinal) AS s FROM o GROUP BY ALL), g AS (SELECT document, line, col, arg_min(CASE WHEN ordinal % 7 = 0 THEN concat(symbol, 'x') ELSE symbol END, ordinal) AS s FROM o WHERE ordinal % 5 <> 0 GROUP BY ALL), c AS (SELECT count(t.s) AS ground_truth_refs, count(g.s) AS tool_refs, count(*) FILTER (t.s = g.s) AS true_pos, count(*) FILTER (g.s IS NOT NULL AND t.s IS DISTINCT FROM g.s) AS false_pos, count(*) FILTER (g.s IS NULL) AS false_neg FROM t FULL OUTER JOIN g USING (document, line, col)), p AS (SELECT *, true_pos / (true_pos + false_pos) AS precision, true_pos / (true_pos + false_neg) AS recall FROM c) SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM p"
_register("i3_positional_f1", lambda s, d: evaluate.positional_f1(_refs(s, d, False), _refs(s, d, True)), _F1)
_register("g8_unique_positions", lambda s, d: evaluate.unique_positions(_refs(s, d, False)), "WITH o AS (" + _sql(_OCC) + ") SELECT document AS path, line, col, concat('. . . . ', string_split(arg_min(symbol, ordinal), ' ')[5]) AS symbol FROM o GROUP BY document, line, col")
_register("i1_normalize_symbol", lambda s, d: _refs(s, d, False).select("symbol").distinct(), "WITH o AS (" + _sql(_OCC) + ") SELECT DISTINCT concat('. . . . ', string_split(symbol, ' ')[5]) AS symbol FROM o")
_register("i5_symbol_tail", lambda s, d: _spark(s, d, _OCC).select(names.symbol_tail(F.col("symbol")).alias("tail")).distinct(), "SELECT DISTINCT concat('F', l_partkey % 50) AS tail FROM lineitem")
_register("a18_edge_pairs", lambda s, d: evaluate.graph_edge_pairs(fixture(s, d), ("ROUTES", "SCIP")), WITH + "SELECT DISTINCT regexp_extract(a.fqn, '([^.]*)$', 1) AS caller, regexp_extract(b.fqn, '([^.]*)$', 1) AS callee FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.kind IN ('ROUTES', 'SCIP')")


def _pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = evaluate.graph_edge_pairs(fixture(spark, sf_dir), ("SCIP",))
    truth = pairs.where("length(callee) % 3 <> 0 or caller > 'C'")
    tool = pairs.where("caller < 'S'")
    return evaluate.edge_pair_f1(truth, tool).withColumn("missing_sample", F.array_join("missing_sample", ";")).withColumn("extra_sample", F.array_join("extra_sample", ";"))


_register("i6_edge_pair_f1", _pair_scores, WITH + ", p AS (SELECT DISTINCT regexp_extract(a.fqn, '([^.]*)$', 1) AS caller, regexp_extract(b.fqn, '([^.]*)$', 1) AS callee FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.kind = 'SCIP'), t AS (SELECT * FROM p WHERE length(callee) % 3 <> 0 OR caller > 'C'), g AS (SELECT * FROM p WHERE caller < 'S'), c AS (SELECT (SELECT count(*) FROM t) AS ground_truth_pairs, (SELECT count(*) FROM g) AS tool_pairs, (SELECT count(*) FROM (SELECT * FROM t INTERSECT SELECT * FROM g)) AS true_pos, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM t)) AS false_pos, (SELECT count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM g)) AS false_neg), r AS (SELECT *, true_pos / (true_pos + false_pos) AS precision, true_pos / (true_pos + false_neg) AS recall FROM c) SELECT *, 2 * precision * recall / (precision + recall) AS f1, coalesce((SELECT string_agg(concat(caller, ' -> ', callee), ';' ORDER BY caller, callee) FROM (SELECT * FROM (SELECT * FROM t EXCEPT SELECT * FROM g) ORDER BY caller, callee LIMIT 10)), '') AS missing_sample, coalesce((SELECT string_agg(concat(caller, ' -> ', callee), ';' ORDER BY caller, callee) FROM (SELECT * FROM (SELECT * FROM g EXCEPT SELECT * FROM t) ORDER BY caller, callee LIMIT 10)), '') AS extra_sample FROM r")


def _line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = files(spark, sf_dir).where("text is not null").select(F.col("path").alias("document"), "text")
    return scip.line_offsets(texts).groupBy("document").agg(F.max("line").cast("long").alias("lines"), F.max("line_start").alias("last"), F.sum("line_start").alias("total"))


_register("h26_line_offsets", _line_offsets, FILES + ", l AS (SELECT path, generate_subscripts(s, 1) - 1 AS line, unnest(s) AS content FROM (SELECT path, string_split(text, chr(10)) AS s FROM f WHERE text IS NOT NULL)), o AS (SELECT path, line, coalesce(sum(octet_length(encode(content)) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start FROM l) SELECT path AS document, max(line) AS lines, CAST(max(line_start) AS BIGINT) AS last, CAST(sum(line_start) AS BIGINT) AS total FROM o GROUP BY path")


QUERIES |= queries_sources.QUERIES
ORACLE_SQL |= queries_sources.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["d4_three_hops"](spark, sf_dir)
