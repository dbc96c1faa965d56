from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from callscape.model import EDGES, NODES, Graph
from callscape.plans.compiler import compile_query, execute, json_lines
from callscape.plans.errors import ExecuteError, ParseError, UnsupportedError
from callscape.plans.syntax import parse


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [
        (1, "src/main.rs", "File", "src/main.rs", 0, 100),
        (2, "src/lib.rs", "File", "src/lib.rs", 0, 200),
        (3, "crate::main", "Function", "src/main.rs", 10, 50),
        (4, "crate::helper", "Function", "src/lib.rs", 5, 30),
        (5, "crate::util", "Function", "src/lib.rs", 35, 80),
        (-6, "crate", "Module", "src/lib.rs", 0, 500),  # as unsigned the greatest id
    ]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(3, 4, "CALLS"), (4, 5, "CALLS"), (4, 5, "SCIP")], EDGES))


def rows(graph, text, **flags):
    return [tuple(r) for r in compile_query(graph, text, **flags).collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("MATCH (n:Function) RETURN n.fqn ORDER BY n.fqn", ["crate::helper", "crate::main", "crate::util"]),
        ("MATCH (n:Module) RETURN n.fqn", ["crate"]),
        ('MATCH (n) WHERE n.fqn CONTAINS "helper" RETURN n.fqn', ["crate::helper"]),
        ("MATCH (n:Function) RETURN n.fqn ORDER BY n.fqn SKIP 1 LIMIT 1", ["crate::main"]),
        ("MATCH (a)-[:CALLS]->(b) RETURN b.fqn ORDER BY b.fqn", ["crate::helper", "crate::util"]),
        ("MATCH (b)<-[r]-(a {fqn: 'crate::helper',}) RETURN DISTINCT b.fqn", ["crate::util"]),
        ("MATCH (a)-[r](b {fqn: 'crate::helper'}) RETURN a.fqn", ["crate::main"]),
        ("match (n) where not n.nope and n.byte_end = 500.0 return n.fqn;", ["crate"]),
        ("MATCH (n) RETURN n.fqn LIMIT 2 // implicit order is by unsigned id", ["src/main.rs", "src/lib.rs"]),
        ("MATCH (n) RETURN n.fqn ORDER BY n.id SKIP 5", ["crate"]),
        ("MATCH (n:File) WHERE n.fqn =~ '.*' RETURN n.fqn", []),
        ("MATCH (a)-[:calls]->(a) RETURN a.fqn ORDER BY a.fqn", ["crate::helper", "crate::util"]),
    ],
)
def test_rows(graph, text, expected):
    assert [r[0] for r in rows(graph, text)] == expected


def test_distinct_edges_have_stored_ids_as_keys(graph):
    plan = compile_query(graph, "MATCH (a)-[r]->(b) RETURN DISTINCT r")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[k0#\d+L, k1#\d+L\]", plan)  # not a struct of unsigned numbers


def test_distinct_edges_ignore_their_kind(graph):
    found = rows(graph, "MATCH (a)-[r]->(b) RETURN DISTINCT r")
    assert sorted((int(r[0]["from"]), r[0]["kind"]) for r in found) == [(3, "CALLS"), (4, "CALLS")]


def test_strict_undirected(graph):
    assert len(rows(graph, "MATCH (a:Function)--(b) RETURN a.fqn")) == 3
    assert len(rows(graph, "MATCH (a:Function)--(b) RETURN a.fqn", strict_undirected=True)) == 6


def test_whole_node_shows_unsigned_id(graph):
    assert int(rows(graph, "MATCH (n:Module) RETURN n")[0][0]["id"]) == 2**64 - 6


def test_json_lines_show_nulls(graph):
    assert [r.value for r in json_lines(compile_query(graph, "MATCH (n:Module) RETURN n.fqn AS a, n.x AS b")).collect()] == ['{"a":"crate","b":null}']


@pytest.mark.parametrize("text", ["MATCH (a)-[*1..3]->(b) RETURN a", "MATCH (n) RETURN count(n)", "MATCH (n) WITH n RETURN n", "MATCH (n) WHERE n.set = 1 RETURN n", "MATCH p = (a)->(b) RETURN p", "MATCH (n) WHERE n.x IN n RETURN n", "OPTIONAL MATCH (n) RETURN n", "MATCH (a) MATCH (b) RETURN a"])
def test_unsupported(text):
    with pytest.raises(UnsupportedError, match="not in this query language"):
        parse(text)


@pytest.mark.parametrize("text", ["RETURN n", "MATCH (n)", "MATCH (a)-->(b) RETURN a", "MATCH (n) WHERE n.x > -1 RETURN n", "MATCH (n) RETURN n LIMIT 1 SKIP 1", "MATCH (n) RETURN 'x", "MATCH (n) RETURN n /* x", "MATCH (n) RETURN #"])
def test_parse_errors(text):
    with pytest.raises(ParseError):
        parse(text)


def test_execute_errors(graph):
    with pytest.raises(ExecuteError, match="label"):
        compile_query(graph, "MATCH (n:function) RETURN n")
    with pytest.raises(ExecuteError, match="hops"):
        compile_query(graph, "MATCH (a)->(b)->(c)->(d)->(e) RETURN a")
    with pytest.raises(ExecuteError, match="row cap"):
        execute(graph, "MATCH (n) RETURN n.fqn LIMIT 1", row_cap=5)
    assert execute(graph, "MATCH (n) RETURN n.fqn", row_cap=6).count() == 6


def test_filters_reach_the_scan(spark, tmp_path, graph):
    graph.nodes.write.parquet(str(tmp_path / "n"))
    graph.edges.write.parquet(str(tmp_path / "e"))
    stored = Graph(spark.read.parquet(str(tmp_path / "n")), spark.read.parquet(str(tmp_path / "e")))
    plan = compile_query(stored, "MATCH (n:Function) WHERE n.byte_start > 7 RETURN n.fqn")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,Function)" in plan and "GreaterThan(byte_start,7)" in plan
    assert "byte_end" not in plan and "file" not in plan.split("ReadSchema")[1]


def test_a_node_with_many_edges_is_no_single_task(spark, monkeypatch):
    """Rows that meet at one node leave it in many partitions, each once."""
    monkeypatch.setattr("callscape.plans.compiler.WIDE", 20)
    nodes = spark.range(301).select("id", F.concat(F.lit("n"), "id").alias("fqn"), F.when(F.col("id") == 0, "Module").otherwise("Struct").alias("kind"), F.lit("f").alias("file"), F.lit(0).cast("long").alias("byte_start"), F.lit(1).cast("long").alias("byte_end"))
    edges = spark.range(1, 301).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit("SCIP").alias("kind"))
    out = compile_query(Graph(nodes, edges), "MATCH (a:Struct)-[:SCIP]->(b)<-[:SCIP]-(c:Struct) RETURN a.id, c.id")
    assert out.count() == out.distinct().count() == 300 * 300
    sizes = out.toDF("a", "c").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 90_000 and max(sizes) < 45_000
