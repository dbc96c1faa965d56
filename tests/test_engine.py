from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from callscape.functions import names
from callscape.model import NODES, Graph
from callscape.operators import etl, evaluate, scip, traverse
from callscape.sources import repo
from callscape.sources import scip as wire
from callscape.sources.extract import extract
from callscape.sources.store import Store
from callscape.tools import Tools, to_dot

TREE = {
    "a.rs": "pub fn foo() {}\n",
    "b.rs": "use crate::a::foo;\nfn bar() { foo() }\n",
    "lib/__init__.py": "from lib.notify import send as alert\n",
    "lib/notify.py": "def send(x):\n    return x\n",
    "app/main.py": "from lib import alert\n\ndef run():\n    helper()\n\ndef helper():\n    alert(1)\n",
    "web/app.js": "const express = require('express');\nfunction getUser(req, res) { res.json(1); }\napp.get('/users/:id', getUser);\napp.post('/users', (req, res) => { res.reply(2); });\n",
    "api/main.py": 'from fastapi import FastAPI\napp = FastAPI()\n\n@app.get("/users/{id}")\ndef get_user(id):\n    return id\n',
    "srv/main.go": 'package main\nimport "github.com/gin-gonic/gin"\nfunc list(c *gin.Context) {}\nfunc main() {\n\tr := gin.Default()\n\tr.GET("/users", list)\n}\n',
    "broken.py": "def (\n",
    ".hidden.py": "def hidden(): pass\n",
    "skip/out.py": "def skipped(): pass\n",
    "readme.md": "no code\n",
    ".gitignore": "skip/\n",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "project"
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


def edges_of(graph: Graph) -> set[tuple[str, str, str]]:
    n = lambda side: graph.nodes.select(F.col("id").alias(side), F.col("fqn").alias(side + "_fqn"))
    return {tuple(r) for r in graph.edges.join(n("src"), "src").join(n("dst"), "dst").select("src_fqn", "dst_fqn", "kind").collect()}


def test_name_resolution_shuffles_definitions_once(spark, tmp_path):
    spark.createDataFrame([(1, "a.f", "Function", "a", 0, 9), (2, "b.f", "Function", "b", 0, 9)], NODES).write.parquet(f"{tmp_path}/nodes")
    spark.createDataFrame([("b", "f", 3), ("c", "f", 4), ("c", "g", 5)], "file string, short string, at long").write.parquet(f"{tmp_path}/uses")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = etl.resolve(spark.read.parquet(f"{tmp_path}/uses"), spark.read.parquet(f"{tmp_path}/nodes"))
        assert {(r.at, r.target_id) for r in found.collect()} == {(3, 2), (4, 1), (5, None)}
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("ReusedExchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_walk_keeps_underscores_and_skips_ignored(tree):
    found = [p for p, _, _ in repo.walk(tree)]
    assert "lib/__init__.py" in found and "skip/out.py" not in found and ".hidden.py" not in found and "readme.md" not in found


def test_graph_of_a_tree(spark, tree):
    graph = etl.graph_of(etl.facts_of(repo.read(spark, tree)))
    edges = edges_of(graph)
    assert ("b::bar", "a::foo", "CALLS") in edges
    assert ("app.main.run", "app.main.helper", "CALLS") in edges
    assert not any(dst == "lib.notify.send" for _, dst, _ in edges)  # an alias is not followed
    assert {e for e in edges if e[2] == "ROUTES"} == {("GET /users/:id", "web/app/getUser", "ROUTES"), ("GET /users/{id}", "api.main.get_user", "ROUTES"), ("GET /users", "srv/list", "ROUTES")}
    routes = {r.fqn for r in graph.nodes.where("kind = 'Route'").collect()}
    assert "POST /users" in routes
    assert "broken.py" in {r.fqn for r in graph.nodes.where("kind = 'File'").collect()}


def test_refresh_equals_rebuild(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = etl.refresh(store, repo.read(spark, tree))
    assert (first["new"], first["files"]) == (9, 9)
    again = etl.refresh(store, repo.read(spark, tree))
    assert (again["unchanged"], again["new"], again["modified"]) == (9, 0, 0)
    with open(os.path.join(tree, "a.rs"), "w") as f:
        f.write("// moved\npub fn foo() {}\npub fn more() { foo() }\n")
    os.remove(os.path.join(tree, "lib/notify.py"))
    with open(os.path.join(tree, "c.rs"), "w") as f:
        f.write("fn c() { more() }\n")
    third = etl.refresh(store, repo.read(spark, tree))
    assert (third["new"], third["modified"], third["deleted"], third["unchanged"]) == (1, 1, 1, 7)
    fresh = Store(spark, str(tmp_path / "fresh"))
    etl.refresh(fresh, repo.read(spark, tree), rebuild=True)
    assert edges_of(store.graph()) == edges_of(fresh.graph())
    assert ("b::bar", "a::foo", "CALLS") in edges_of(store.graph())
    assert set(map(tuple, store.graph().nodes.collect())) == set(map(tuple, fresh.graph().nodes.collect()))


def test_names_are_resolved_again_where_they_changed(spark, tmp_path, monkeypatch):
    """What a change leaves out must not matter: after every step the store equals a rebuild, parts written together or not."""
    monkeypatch.setattr(etl, "FAN", 2)
    root, rng = tmp_path / "p", random.Random(4)
    root.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    for step in range(5):
        for i in range(6) if step == 0 else rng.sample(range(6), 2):
            path = root / f"m{i}.rs"
            if step and rng.random() < 0.25 and path.exists():
                path.unlink()
            else:
                path.write_text("\n".join(f"fn f{rng.randrange(8)}() {{ f{rng.randrange(8)}(); f{rng.randrange(8)}() }}" for _ in range(3)))
        report = etl.refresh(store, repo.read(spark, str(root)))
        fresh = etl.graph_of(etl.facts_of(repo.read(spark, str(root))))
        assert set(map(tuple, store.graph().nodes.collect())) == set(map(tuple, fresh.nodes.collect()))
        assert set(map(tuple, store.graph().edges.collect())) == set(map(tuple, fresh.edges.collect()))
        assert report["calls"] == fresh.edges.count() and len(store.state()["parts"]["facts"]) <= 2
    assert len(store.manifests()) == 2


def test_a_long_text_is_stopped(monkeypatch):
    from callscape.sources import extract as module

    monkeypatch.setattr(module, "lexical", lambda lang, data: re.match("(a+)+$", "a" * 40 + "b"))
    assert extract("go", b"", seconds=0.2).error == "timeout"


def test_tools(spark, tree):
    tools = Tools(spark, tree)
    assert tools.call("index_status")["status"] == "not_indexed"
    assert "error" in tools.call("search_graph")
    report = tools.call("index_repository")
    assert report["status"] == "indexed" and report["routes"] == 4
    assert "digraph" in to_dot(report, tree)
    found = tools.call("search_graph", label="function", query="BAR")
    assert [r["name"] for r in found["results"]] == ["b::bar"] and not found["has_more"]
    assert tools.call("search_graph", name_pattern="(", limit=1)["has_more"]
    assert tools.call("query_graph", query="MATCH (n:Route) RETURN n.fqn", max_rows=2)["total"] == 2
    assert "not in this query language" in tools.call("query_graph", query="MATCH (n) RETURN count(n)")["error"]
    traced = tools.call("trace_call_path", function_name="bar", direction="outbound")
    assert [(h["name"], h["depth"]) for h in traced["hops"]] == [("a::foo", 1)]
    assert tools.call("trace_path", function_name="nothing")["hops"] == []
    assert tools.call("get_code_snippet", qualified_name="b::bar")["source"] == "fn bar() { foo() }"
    assert "error" in tools.call("get_code_snippet", qualified_name="nope")
    assert {r["type"] for r in tools.call("get_graph_schema")["edge_types"]} == {"CALLS", "ROUTES"}
    assert tools.call("get_architecture")["file_count"] == 9
    code = tools.call("search_code", pattern="users", limit=1)
    assert code["total_results"] == 1 and code["truncated"]
    assert tools.call("search_code", pattern="users", mode="files", file_pattern="*.py")["files"] == ["api/main.py"]
    assert tools.call("search_code", pattern="us.rs", regex=True, mode="full", limit=1)["total_grep_matches"] == 4
    assert tools.call("list_projects")["projects"][0]["indexed"]
    for stub in ("delete_project", "detect_changes", "manage_adr", "ingest_traces", "unknown"):
        assert "error" in tools.call(stub)


@pytest.mark.parametrize("lang", ["rust", "javascript", "typescript", "tsx", "go", "java", "cpp", "csharp", "php", "lua", "scala", "python"])
@pytest.mark.parametrize("data", [b"", b"\xff\xfe{", b"((((", b'"unterminated', b"/* open"])
def test_extraction_never_raises(lang, data):
    extract(lang, data)


def test_definitions_by_language():
    defs = lambda lang, text: [(k, n) for k, n, _, _ in extract(lang, text.encode()).defs]
    assert ("Method", "new") in defs("rust", "impl S { fn new() {} }") and ("Function", "new") in defs("rust", "impl S { fn new() {} }")
    assert defs("java", "class A { A(int x) { } int go() { return f(); } }") == [("Class", "A"), ("Method", "A"), ("Method", "go")]
    assert defs("typescript", "interface I { m(a: string): void; }") == [("Class", "I"), ("Function", "m")]
    assert defs("python", "class A:\n  def m(self): pass\n") == [("Class", "A"), ("Function", "m"), ("Method", "m")]
    assert defs("go", "func (s *S) M() {}\ntype S struct {}\n") == [("Method", "M"), ("Function", "S")]
    assert defs("cpp", "class A { int m(int a) { return 1; } };\nint f() { return 2; }\n") == [("Class", "A"), ("Method", "m"), ("Function", "f")]


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    pre = lambda path, lang: one(names.prefix(F.lit(path), F.lit(lang)))
    assert pre("foo/bar/mod.rs", "rust") == "foo::bar" and pre("main.rs", "rust") == "" and pre("a/__init__.py", "python") == "a"
    assert pre("x/src/main/java/a/B.java", "java") == "a.B" and pre("src/main/java.java", "java") == "src.main.java" and pre("a/b/c.go", "go") == "a/b"
    assert one(names.qualified(F.lit("main.rs"), F.lit("rust"), F.lit("f"))) == "f"
    assert one(names.symbol_tail(F.lit("s p f 1 `src/app`/Flask#run()."))) == "run" and one(names.symbol_tail(F.lit("local 42"))) == ""
    assert one(names.symbol_key(F.lit("s p f 1 `a`/C#m()."))) == "C#m" and one(names.symbol_key(F.lit("local 1"))) is None
    assert one(names.strip_quotes(F.lit(' "a" '))) == "a" and one(names.strip_quotes(F.lit("\"a'"))) == "\"a'"
    assert one(names.language(F.lit("a/b.h++"))) == "cpp" and one(names.language(F.lit("a/.py"))) is None and one(names.language(F.lit("A.PY"))) is None


def _field(number: int, payload: bytes) -> bytes:
    return bytes([number << 3 | 2, len(payload)]) + payload


def test_reference_index_to_edges(spark, tmp_path):
    occ = lambda symbol, roles, *at: _field(2, _field(1, bytes(at)) + _field(2, symbol.encode()) + bytes([3 << 3, roles]))
    doc = _field(1, b"a.py") + occ("s m p v `a`/foo.", 1, 0, 4, 7) + occ("s m p v `a`/foo.", 0, 3, 4, 7) + occ("local 1", 0, 3, 4, 7)
    (tmp_path / "i.scip").write_bytes(_field(2, doc))
    found = wire.read(spark, str(tmp_path / "i.scip"))
    assert found.count() == 3
    text = "def foo():\n    pass\ndef bar():\n    foo()\n"
    nodes = etl.graph_of(etl.facts_of(repo.from_frame(spark.createDataFrame([("a.py", bytearray(text.encode()))], "path string, content binary")))).nodes
    edges, report = scip.scip_edges(found, spark.createDataFrame([("a.py", text)], "document string, text string"), nodes)
    assert edges_of(Graph(nodes, edges)) == {("a.bar", "a.foo", "SCIP")}
    assert report.first().asDict() == {"seen": 2, "emitted": 1, "skipped": 1}
    root = tmp_path / "p"
    root.mkdir()
    (root / "a.py").write_text(text)
    tools = Tools(spark, str(root))
    assert tools.call("index_repository", scip=str(tmp_path / "i.scip"))["scip_edges"] == 1
    assert ("a.bar", "a.foo", "SCIP") in edges_of(tools.store.graph())
    (root / "b.py").write_text("x = 1\n")
    assert tools.call("index_repository")["scip_edges"] == 1 and ("a.bar", "a.foo", "SCIP") in edges_of(tools.store.graph())
    assert tools.call("index_repository", rebuild=True)["scip_edges"] == 0


def test_scores(spark):
    occ = spark.createDataFrame([("a", 0, "s m p v foo().", 1, [0, 0, 10, 0], []), ("a", 1, "s m p v foo().", 0, [3, 4, 10], []), ("a", 2, "s m p v bar.", 0, [4, 4, 10], [])], "document string, ordinal int, symbol string, symbol_roles int, range array<int>, enclosing_range array<int>")
    assert [tuple(r) for r in evaluate.scip_edge_pairs(occ).collect()] == [("foo", "bar")]
    pairs = lambda *p: spark.createDataFrame(list(p), "caller string, callee string")
    row = evaluate.edge_pair_f1(pairs(("a", "b"), ("a", "c")), pairs(("a", "b"), ("x", "y"))).first()
    assert (row.true_pos, row.false_pos, row.false_neg, row.f1) == (1, 1, 1, 0.5) and row.missing_sample == ["a -> c"] and row.extra_sample == ["x -> y"]
    none = evaluate.edge_pair_f1(pairs(("a", "b")).limit(0), pairs(("a", "b")).limit(0)).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)
    assert evaluate.rewrite_to_definitions(occ).count() == 1


def test_dead_code(spark):
    nodes = spark.createDataFrame([(1, "a", "Function", "f", 0, 1), (2, "b", "Function", "f", 1, 2)], "id long, fqn string, kind string, file string, byte_start long, byte_end long")
    assert [r.fqn for r in traverse.dead_code(Graph(nodes, spark.createDataFrame([(1, 2, "CALLS")], "src long, dst long, kind string"))).collect()] == ["a"]


def test_streaming_refresh(spark, tmp_path):
    from callscape.streaming.refresh import follow

    src = tmp_path / "in"
    kind = "path string, content binary, deleted boolean, seq long"
    spark.createDataFrame([("a.rs", bytearray(b"fn a() { b() }"), False, 1), ("b.rs", bytearray(b"fn b() {}"), False, 2)], kind).write.parquet(str(src))
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(kind).parquet(str(src))
    q = follow(store, stream, str(tmp_path / "cp"), "0 seconds")
    q.processAllAvailable()
    assert edges_of(store.graph()) == {("a::a", "b::b", "CALLS")}
    spark.createDataFrame([("b.rs", None, True, 3)], kind).write.mode("append").parquet(str(src))
    q.processAllAvailable()
    q.stop()
    assert edges_of(store.graph()) == set()


def test_a_table_in_one_piece_is_dealt_out(spark):
    files = spark.range(64, numPartitions=1).select(F.concat(F.lit("m"), "id", F.lit(".py")).alias("path"), F.lit("def f(): pass\n").alias("content"))
    facts = etl.facts_of(repo.from_frame(files))
    assert facts.select("file", F.spark_partition_id().alias("p")).where("p > 0").count() > 0 and facts.count() == 64


def test_no_pattern_is_compiled_for_a_name(monkeypatch):
    text = lambda k: f"int f{k}() {{ return f{k}(); }} class S{k} {{ int m{k}() {{ return new f{k}(); }} }}\n".encode()
    extract("java", text(0))
    made = []
    kept = re._compiler.compile
    monkeypatch.setattr(re._compiler, "compile", lambda p, flags=0: made.append(p) or kept(p, flags))
    facts = extract("java", text(12345))
    assert [d[1] for d in facts.defs] == ["S12345", "f12345", "m12345"] and made == []


class Held:
    """Stands for the store of a graph that is there."""

    def __init__(self, graph):
        self.graph = lambda: graph

    def exists(self):
        return True


@pytest.fixture(scope="module")
def wide(spark):
    """Tools over more nodes and edges than the row cap."""
    nodes = spark.range(100_050).select(F.xxhash64("id").alias("id"), F.concat(F.lit("n"), "id").alias("fqn"), F.lit("Class").alias("kind"), F.lit("f").alias("file"), F.lit(0).cast("long").alias("byte_start"), F.lit(1).cast("long").alias("byte_end")).cache()
    tools = Tools(spark, "/p", "/tmp/none")
    tools.store = Held(Graph(nodes, nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("CALLS").alias("kind"))))
    return tools


def test_whole_answers_beyond_the_row_cap(wide):
    assert wide.query_rows("MATCH (a)-[:CALLS]->(b) RETURN a.fqn AS src, b.fqn AS dst").count() == 100_050
    assert "row cap" in wide.call("query_graph", query="MATCH (n) RETURN n.fqn")["error"]


def test_max_rows_beyond_the_row_cap(wide):
    for n in (0, 7):
        assert wide.call("query_graph", query="MATCH (n:Class) RETURN n.fqn", max_rows=n)["total"] == n
    assert "row cap" in wide.call("query_graph", query="MATCH (n) RETURN n.fqn", max_rows=-1)["error"]


def test_pages_sort_only_what_they_touch(wide):
    from callscape.model import unsigned_order
    from callscape.tools import page_of

    rows = wide.store.graph().nodes
    ids = [r.id for r in rows.orderBy(unsigned_order(F.col("id"))).select("id").collect()]
    for offset, limit in ((0, 5), (24, 2), (49_990, 60), (100_045, 9), (100_050, 5), (10**6, 5)):
        page, total = page_of(rows, offset, limit)
        assert total == 100_050 and [r.id for r in page.select("id").collect()] == ids[offset : offset + limit]
    sorted_rows = page_of(rows, 90_000, 5)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright" in sorted_rows
