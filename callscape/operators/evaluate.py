"""Precision, recall and F1 of references and of call edges against a ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import fqn_tail, normalize_symbol, symbol_tail
from ..model import Graph
from .scip import references
from .spans import enclosing_lines


def ratio(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to true_pos, false_pos and false_neg; zero denominators give 0."""
    p, r = ratio(F.col("true_pos"), F.col("true_pos") + F.col("false_pos")), ratio(F.col("true_pos"), F.col("true_pos") + F.col("false_neg"))
    scored = counts.withColumn("precision", p).withColumn("recall", r)
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def extract_refs(occurrences: DataFrame) -> DataFrame:
    """(path, line, col, symbol) of all references, symbols normalised; ordinal tells which came first."""
    rows = references(occurrences)
    return rows.select(F.col("document").alias("path"), F.col("range")[0].alias("line"), F.col("range")[1].alias("col"), normalize_symbol(F.col("symbol")).alias("symbol"), "ordinal")


def unique_positions(refs: DataFrame) -> DataFrame:
    """First symbol of each position."""
    return refs.groupBy("path", "line", "col").agg(F.min_by("symbol", "ordinal").alias("symbol"))


def rewrite_to_definitions(occurrences: DataFrame) -> DataFrame:
    """References joined to the first definition of their symbol; those without one in the corpus are dropped."""
    order = F.struct("document", "ordinal")
    defs = occurrences.where((F.col("symbol_roles").bitwiseAND(1) == 1) & (F.col("symbol") != "")).groupBy("symbol").agg(F.min_by(F.struct("document", "range"), order).alias("d"))
    refs = references(occurrences).join(defs, "symbol")
    return refs.select(F.col("document").alias("path"), F.col("range")[0].alias("line"), F.col("range")[1].alias("col"), "symbol", F.col("d.document").alias("def_path"), F.col("d.range")[0].alias("def_line"), F.col("d.range")[1].alias("def_col"))


def positional_f1(truth: DataFrame, tool: DataFrame) -> DataFrame:
    """A wrong symbol at a known position is a false positive and no false negative; a missing position is a false negative."""
    a = unique_positions(truth).withColumnRenamed("symbol", "truth")
    b = unique_positions(tool).withColumnRenamed("symbol", "tool")
    rows = a.join(b, ["path", "line", "col"], "full_outer")
    same = F.coalesce(F.col("truth") == F.col("tool"), F.lit(False))
    counts = rows.agg(
        F.count("truth").alias("ground_truth_refs"),
        F.count("tool").alias("tool_refs"),
        F.count_if(same).alias("true_pos"),
        F.count_if(F.col("tool").isNotNull() & ~same).alias("false_pos"),
        F.count_if(F.col("tool").isNull()).alias("false_neg"),
    )
    return with_scores(counts)


def scip_edge_pairs(occurrences: DataFrame) -> DataFrame:
    """(caller, callee) name pairs of an index: callers by the smallest definition around a reference; no empty or self pairs."""
    extent = F.when(F.size("enclosing_range") > 0, F.col("enclosing_range")).otherwise(F.col("range"))
    defs = occurrences.where((F.col("symbol_roles").bitwiseAND(1) == 1) & (F.col("symbol") != "")).select("document", "ordinal", "symbol", extent.alias("r"))
    four = F.size("r") >= 4
    spans = defs.select("document", "ordinal", "symbol", F.col("r")[0].alias("start_line"), F.col("r")[1].alias("start_col"), F.when(four, F.col("r")[2]).otherwise(F.col("r")[0]).alias("end_line"), F.when(four, F.try_element_at("r", F.lit(4))).otherwise(F.col("r")[2]).alias("end_col"))
    refs = references(occurrences).select("document", F.col("range")[0].alias("line"), F.col("range")[1].alias("col"), "symbol")
    pairs = enclosing_lines(refs, spans).select(symbol_tail(F.col("enclosing_symbol")).alias("caller"), symbol_tail(F.col("symbol")).alias("callee"))
    return pairs.where("caller <> '' and callee <> '' and caller <> callee").distinct()


def graph_edge_pairs(graph: Graph, kinds: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """(caller, callee) name pairs of a graph's edges of the given kinds; edges without both ends are dropped."""
    name = lambda side: graph.nodes.select(F.col("id").alias(side), fqn_tail(F.col("fqn")).alias("caller" if side == "src" else "callee"))
    edges = graph.edges.where(F.col("kind").isin(*kinds))
    return edges.join(name("src"), "src").join(name("dst"), "dst").select("caller", "callee").distinct()


def edge_pair_f1(truth: DataFrame, tool: DataFrame, samples: int = 10) -> DataFrame:
    """Set scores of name pairs, with at most `samples` missing and extra ones, in order."""
    keys = ["caller", "callee"]
    both = truth.distinct().withColumn("t", F.lit(1)).join(tool.distinct().withColumn("g", F.lit(1)), keys, "full_outer")
    counts = both.agg(
        F.count("t").alias("ground_truth_pairs"),
        F.count("g").alias("tool_pairs"),
        F.count_if(F.col("t").isNotNull() & F.col("g").isNotNull()).alias("true_pos"),
        F.count_if(F.col("t").isNull()).alias("false_pos"),
        F.count_if(F.col("g").isNull()).alias("false_neg"),
    )
    some = lambda missing: [f"{r.caller} -> {r.callee}" for r in both.where(f"{missing} is null").orderBy(*keys).limit(samples).collect()]
    scored = with_scores(counts)
    listed = lambda rows: F.array(*map(F.lit, rows)) if rows else F.array().cast("array<string>")
    return scored.withColumn("missing_sample", listed(some("g"))).withColumn("extra_sample", listed(some("t")))
