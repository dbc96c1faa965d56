"""Syntax trees to DataFrame plans.

A pattern becomes a chain of equi-joins on flat columns, so filters and column
pruning reach the scans; what a query binds is resolved by name and static
type while compiling, and comparisons whose outcome the types decide become
constants. Logic is two-valued: a predicate is true or false, never null.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EDGE_KINDS, NODE_KINDS, Graph, ordinal, unsigned, unsigned_order
from .errors import ExecuteError
from .syntax import Lit, Op, Query, Ref, parse

#: Properties and their types.
NODE_PROPS = {"fqn": "str", "file": "str", "byte_start": "num", "byte_end": "num", "kind": "str", "id": "num"}
EDGE_PROPS = {"kind": "str", "from": "num", "to": "num"}
TEXT_TESTS = {"CONTAINS": F.contains, "STARTS": F.startswith, "ENDS": F.endswith}
MAX_HOPS = 3
#: Rows that API mode lets a scan or a hop produce.
ROW_CAP = 100_000
#: Edges of a node that one group of a later hop's join holds.
WIDE = 1000


@dataclass(frozen=True)
class Typed:
    kind: str  # null bool num float str node edge
    col: Column


@dataclass
class Compiled:
    """A plan; `stages` are the frames after the scan and each hop, for the row cap of API mode."""

    frame: DataFrame
    columns: list[str]
    stages: list[DataFrame] = field(default_factory=list)


class Compiler:
    """strict_undirected matches undirected hops both ways; real_regex makes `=~` a full match instead of false."""

    def __init__(self, graph: Graph, strict_undirected: bool = False, real_regex: bool = False):
        self.graph, self.strict, self.real_regex = graph, strict_undirected, real_regex
        self.bound: dict[str, tuple[str, int]] = {}

    # bindings

    def nodes(self, i: int) -> DataFrame:
        return self.graph.nodes.select(*(F.col(p).alias(f"n{i}_{p}") for p in NODE_PROPS))

    def edges(self, i: int, flip: bool) -> DataFrame:
        e = self.graph.edges
        cols = [F.col("src").alias(f"e{i}_from"), F.col("dst").alias(f"e{i}_to"), F.col("kind").alias(f"e{i}_kind")]
        ends = ("dst", "src") if flip else ("src", "dst")
        return e.select(*cols, F.col(ends[0]).alias(f"e{i}_here"), F.col(ends[1]).alias(f"e{i}_there"))

    def value(self, var: str, prop: str | None) -> Typed:
        kind, i = self.bound.get(var, ("null", 0))
        if kind == "node":
            if prop is None:
                fields = [unsigned(F.col(f"n{i}_id")).alias("id"), *(F.col(f"n{i}_{p}").alias(p) for p in ("fqn", "kind", "file", "byte_start", "byte_end"))]
                return Typed("node", F.struct(*fields))
            if prop in NODE_PROPS:
                return Typed(NODE_PROPS[prop], F.col(f"n{i}_{prop}"))
        if kind == "edge":
            if prop is None:
                return Typed("edge", F.struct(unsigned(F.col(f"e{i}_from")).alias("from"), unsigned(F.col(f"e{i}_to")).alias("to"), F.col(f"e{i}_kind").alias("kind")))
            if prop in EDGE_PROPS:
                return Typed(EDGE_PROPS[prop], F.col(f"e{i}_{prop}"))
        return Typed("null", F.lit(None).cast("string"))

    # expressions

    def expr(self, x) -> Typed:
        if isinstance(x, Lit):
            v = x.value
            kind = "null" if v is None else "bool" if isinstance(v, bool) else "str" if isinstance(v, str) else "float" if isinstance(v, float) else "num"
            return Typed(kind, F.lit(v) if v is not None else F.lit(None).cast("string"))
        if isinstance(x, Ref):
            return self.value(x.var, x.prop)
        args = [self.expr(a) for a in x.args]
        return Typed("bool", self.apply(x, args))

    def truth(self, v: Typed) -> Column:
        """Null is false, a boolean is itself, anything else is true."""
        if v.kind == "bool":
            return F.coalesce(v.col, F.lit(False))
        return F.lit(False) if v.kind == "null" else v.col.isNotNull()

    def holds(self, x) -> Column:
        """Form of a predicate for a filter: true where it holds, false or null elsewhere, so that scans can take it over."""
        if isinstance(x, Op) and x.name in ("AND", "OR"):
            a, b = map(self.holds, x.args)
            return a & b if x.name == "AND" else a | b
        if isinstance(x, Op) and x.name in ("<", ">", "<=", ">=", "CONTAINS", "STARTS", "ENDS"):
            a, b = map(self.expr, x.args)
            if x.name in ("CONTAINS", "STARTS", "ENDS"):
                return TEXT_TESTS[x.name](a.col, b.col) if a.kind == b.kind == "str" else F.lit(False)
            if self.comparable(a, b):
                test = self.raw(x.name, a, b)
                return test if x.name in ("<", ">") else test | a.col.isNull() | b.col.isNull()
        return self.truth(self.expr(x))

    def raw(self, op: str, a: Typed, b: Typed) -> Column:
        left, right = self.promote(a, b)
        return {"<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]

    def apply(self, x: Op, args: list[Typed]) -> Column:
        if x.name in ("AND", "OR"):
            a, b = map(self.truth, args)
            return a & b if x.name == "AND" else a | b
        if x.name == "NOT":
            return ~self.truth(args[0])
        if x.name == "ISNULL":
            return args[0].col.isNull() if args[0].kind != "null" else F.lit(True)
        a, b = args
        if x.name in ("=", "!="):
            same = self.equal(a, b)
            return same if x.name == "=" else ~same
        if x.name in ("<", ">", "<=", ">="):
            return self.compare(x.name, a, b)
        if x.name == "=~":
            if not self.real_regex:
                warnings.warn("`=~` is always false; pass real_regex=True to match", stacklevel=2)
                return F.lit(False)
            return F.coalesce(F.rlike(a.col, F.concat(F.lit("^(?:"), b.col, F.lit(")$"))), F.lit(False)) if a.kind == b.kind == "str" else F.lit(False)
        return F.coalesce(TEXT_TESTS[x.name](a.col, b.col), F.lit(False)) if a.kind == b.kind == "str" else F.lit(False)

    @staticmethod
    def promote(a: Typed, b: Typed) -> tuple[Column, Column]:
        return (a.col, b.col) if a.kind == b.kind else (a.col.cast("double"), b.col.cast("double"))

    @staticmethod
    def comparable(a: Typed, b: Typed) -> bool:
        return a.kind == b.kind == "str" or {a.kind, b.kind} <= {"num", "float"}

    def equal(self, a: Typed, b: Typed) -> Column:
        if a.kind == "null" or b.kind == "null":
            other = b if a.kind == "null" else a
            return F.lit(True) if other.kind == "null" else other.col.isNull()
        if self.comparable(a, b) or a.kind == b.kind == "bool":
            left, right = self.promote(a, b)
            return left.eqNullSafe(right)
        return F.lit(False)

    def compare(self, op: str, a: Typed, b: Typed) -> Column:
        """What cannot be compared counts as equal, so only <= and >= hold."""
        equal = F.lit(op in ("<=", ">="))
        if not self.comparable(a, b):
            return equal
        return F.coalesce(self.raw(op, a, b), equal)

    # pattern

    def label(self, name: str) -> str:
        if name not in NODE_KINDS:
            raise ExecuteError(f"unknown node label `{name}`; known labels: {', '.join(NODE_KINDS)}")
        return name

    def only(self, rows: DataFrame, i: int, node) -> DataFrame:
        if node.label is not None:
            rows = rows.where(F.col(f"n{i}_kind") == self.label(node.label))
        for key, value in node.props:
            have = Typed(NODE_PROPS[key], F.col(f"n{i}_{key}")) if key in NODE_PROPS else Typed("null", F.lit(None))
            rows = rows.where(self.equal(have, self.expr(Lit(value))))
        return rows

    def hop(self, rows: DataFrame, i: int, rel) -> DataFrame:
        flips = {"out": [False], "in": [True], "any": [False, True] if self.strict else [False]}[rel.direction]
        edges = None
        for flip in flips:
            one = self.edges(i, flip)
            if flip and len(flips) > 1:
                one = one.where(F.col(f"e{i}_here") != F.col(f"e{i}_there"))
            edges = one if edges is None else edges.unionByName(one)
        if rel.types:
            edges = edges.where(F.upper(f"e{i}_kind").isin([t.upper() for t in rel.types]))
        if rel.props:
            warnings.warn("property maps of relationships are ignored", stacklevel=2)
        if i == 0:  # the rows are nodes, each once
            rows = rows.join(edges, F.col(f"n{i}_id") == F.col(f"e{i}_here"))
            return rows.join(self.nodes(i + 1), F.col(f"e{i}_there") == F.col(f"n{i + 1}_id"))
        return self.fan_out(rows, i, edges)

    def fan_out(self, rows: DataFrame, i: int, edges: DataFrame) -> DataFrame:
        """A later hop, where many rows may be at one node that has many edges.

        Edges meet their far nodes first, so that what the hop makes is not joined again. The edges of a node are dealt into shares
        of about `WIDE`, and its rows go to each; a row is copied at most once for that many results.
        """
        spark = rows.sparkSession
        n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        here, there, node = F.col(f"e{i}_here"), F.col(f"e{i}_there"), F.col(f"n{i}_id")
        far = edges.join(self.nodes(i + 1), there == F.col(f"n{i + 1}_id"))
        wide = edges.groupBy(here.alias("wide_id")).agg(F.ceil(F.count("*") / WIDE).alias("shares")).where("shares > 1")
        shares = F.coalesce("shares", F.lit(1))
        far = far.join(F.broadcast(wide), here == F.col("wide_id"), "left").withColumn("edge_share", F.pmod(F.xxhash64(there, f"e{i}_kind"), shares)).drop("wide_id", "shares")
        rows = rows.join(F.broadcast(wide), node == F.col("wide_id"), "left").withColumn("row_share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("wide_id", "shares")
        # both sides in a fixed number of parts, whichever streams: small groups with large results stay apart
        rows, far = rows.repartition(n, node, F.col("row_share")), far.repartition(n, here, F.col("edge_share"))
        return rows.join(far, (node == here) & (F.col("row_share") == F.col("edge_share"))).drop("row_share", "edge_share")

    def compile(self, query: str | Query) -> Compiled:
        q = parse(query) if isinstance(query, str) else query
        if len(q.hops) > MAX_HOPS:
            raise ExecuteError(f"pattern has {len(q.hops)} hops; at most {MAX_HOPS} are supported")
        rows = self.only(self.nodes(0), 0, q.head)
        stages = [rows]
        self.bound = {q.head.var or "_n0": ("node", 0)}
        for i, (rel, node) in enumerate(q.hops):
            rows = self.hop(rows, i, rel)
            stages.append(rows)
            rows = self.only(rows, i + 1, node)
            if rel.var:
                self.bound[rel.var] = ("edge", i)
            self.bound[node.var or f"_n{i + 1}"] = ("node", i + 1)
        if q.where is not None:
            rows = rows.where(self.holds(q.where))
        return Compiled(*self.project(q, rows), stages)

    # projection, distinct, order, slices

    def project(self, q: Query, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        outputs: dict[str, Typed] = {}
        for ref, name in q.returns:
            outputs.pop(name, None)  # of equal names the last counts
            outputs[name] = self.value(ref.var, ref.prop)
        names = list(outputs)
        columns = [v.col.alias(f"o{k}") for k, v in enumerate(outputs.values())]
        sliced = q.skip is not None or q.limit is not None
        place = [unsigned_order(F.col("n0_id"))]
        for i in range(len(q.hops)):
            place += [unsigned_order(F.col(f"n{i + 1}_id")), ordinal(F.col(f"e{i}_kind"), EDGE_KINDS)]
        ordered = sliced or bool(q.order)
        if ordered or q.distinct:
            columns.append(F.struct(*(p.alias(f"p{k}") for k, p in enumerate(place))).alias("place"))
        if q.distinct:
            same = {name: self.same(ref, outputs[name]) for ref, name in q.returns}
            columns += [key.alias(f"k{k}") for k, key in enumerate(key for name in names for key in same[name])]
        rows = rows.select(*columns)
        if q.distinct:
            rows = self.distinct(rows, len(outputs))
        if ordered:
            keys = [k for k in (self.order_key(outputs, names, ref, down) for ref, down in q.order) if k is not None]
            rows = rows.orderBy(*keys, "place")
        if q.skip is not None:
            rows = rows.offset(q.skip)
        if q.limit is not None:
            rows = rows.limit(q.limit)
        return rows.select(*(F.col(f"o{k}").alias(n) for k, n in enumerate(names))), names

    def same(self, ref: Ref, v: Typed) -> list[Column]:
        """What makes two values of DISTINCT one: nodes count by id, edges by ends without their kind, null like the text "null".
        Ids are keys as they are stored; unsigned numbers are slow to sort."""
        i = self.bound.get(ref.var, ("null", 0))[1]
        if v.kind == "node":
            return [F.col(f"n{i}_id")]
        if v.kind == "edge":
            return [F.col(f"e{i}_from"), F.col(f"e{i}_to")]
        return {"str": [F.coalesce(v.col, F.lit("null"))], "null": []}.get(v.kind, [v.col])

    @staticmethod
    def distinct(rows: DataFrame, n: int) -> DataFrame:
        """First row of each key."""
        keys = [c for c in rows.columns if c.startswith("k")]
        whole = F.struct(*(F.col(f"o{k}") for k in range(n)))
        first = rows.groupBy(*keys).agg(F.min_by(whole, "place").alias("row"), F.min("place").alias("place"))
        return first.select("row.*", "place")

    def order_key(self, outputs: dict[str, Typed], names: list[str], ref: Ref, down: bool) -> Column | None:
        """Keys see projected rows only; a key that is not there, or a whole node or edge, ties all rows."""
        if ref.prop is not None and ref.var in outputs and outputs[ref.var].kind in ("node", "edge"):
            props = NODE_PROPS if outputs[ref.var].kind == "node" else EDGE_PROPS
            if ref.prop not in props:
                return None
            c, kind = F.col(f"o{names.index(ref.var)}")[ref.prop], props[ref.prop]
            if kind == "num" and ref.prop in ("id", "from", "to"):  # ids compare as signed numbers
                c = F.when(c > 2**63 - 1, c - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(c)
        elif ref.name in outputs and outputs[ref.name].kind in ("str", "num"):
            c = F.col(f"o{names.index(ref.name)}")
        else:
            return None
        return c.desc() if down else c.asc()


def compile_query(graph: Graph, query: str, **flags) -> DataFrame:
    """The plan of a query, without the row cap."""
    return Compiler(graph, **flags).compile(query).frame


def execute(graph: Graph, query: str, row_cap: int | None = ROW_CAP, **flags) -> DataFrame:
    """API mode: fails where a scan or a hop makes more rows than the cap, which LIMIT and WHERE do not lower."""
    made = Compiler(graph, **flags).compile(query)
    if row_cap is not None:
        for stage in made.stages:
            if stage.limit(row_cap + 1).count() > row_cap:
                raise ExecuteError(f"row cap of {row_cap} exceeded; narrow the pattern with labels or property maps")
    return made.frame


def json_lines(frame: DataFrame) -> DataFrame:
    """Sink form: one JSON object a row, nulls shown."""
    return frame.select(F.to_json(F.struct("*") if frame.columns else F.struct(), {"ignoreNullFields": "false"}).alias("value"))
