"""From facts to graph: nodes, name resolution, call and route edges, and incremental refresh.

Every step is a join or an aggregation over frames. A refresh costs what has
changed: it parses new and modified files, resolves names again where that can
make a difference, and adds parts to the store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import ROUTE_LANGUAGES, framework, last_segment, qualified
from ..model import NODE_KINDS, Graph, edge_set, node_id, ordinal
from ..sources import repo
from ..sources.store import FAN, PARTED, Store, counts
from .scip import scip_edges
from .spans import enclosing


def file_nodes(sizes: DataFrame) -> DataFrame:
    """File nodes from (file, size)."""
    return _with_id(sizes.select(F.col("file").alias("fqn"), F.lit("File").alias("kind"), "file", F.lit(0).cast("long").alias("byte_start"), F.col("size").cast("long").alias("byte_end")))


def definition_nodes(defs: DataFrame) -> DataFrame:
    """Nodes of definitions (file, lang, kind, name, byte_start, byte_end)."""
    fqn = qualified(F.col("file"), F.col("lang"), F.col("name"))
    return _with_id(defs.select(fqn.alias("fqn"), "kind", "file", "byte_start", "byte_end"))


def route_nodes(routes: DataFrame) -> DataFrame:
    fqn = F.concat_ws(" ", "method", "pattern")
    return _with_id(routes.select(fqn.alias("fqn"), F.lit("Route").alias("kind"), "file", "byte_start", "byte_end"))


def _with_id(rows: DataFrame) -> DataFrame:
    made = rows.select(node_id(F.col("file"), F.col("fqn"), F.col("kind"), F.col("byte_start")).alias("id"), "fqn", "kind", "file", "byte_start", "byte_end")
    # equal identity means equal node; of several extents the widest
    return made.groupBy("id", "fqn", "kind", "file", "byte_start").agg(F.max("byte_end").alias("byte_end")).select("id", "fqn", "kind", "file", "byte_start", "byte_end")


def short_index(defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First definition of each short name, by file and in the whole project.

    "First" is least (file, start, kind); it does not depend on the order in which files were read.
    Keys are never null; that is said here, since joins would say it to one side only and the two could not share a shuffle.
    """
    order = F.struct("file", "byte_start", ordinal(F.col("kind"), NODE_KINDS).alias("rank"), "id")
    named = defs.where(F.col("kind") != "File").select("file", last_segment(F.col("fqn")).alias("short"), order.alias("order")).where("file is not null and short is not null")
    in_file = named.groupBy("file", "short").agg(F.min("order").alias("order"))
    anywhere = in_file.groupBy("short").agg(F.min("order").alias("order"))
    return in_file.select("file", "short", F.col("order.id").alias("file_id")), anywhere.select("short", F.col("order.id").alias("any_id"))


def resolve(references: DataFrame, defs: DataFrame) -> DataFrame:
    """Adds target_id to (file, short, …): the same file's first definition of the name, else the project's; null if there is none."""
    in_file, anywhere = short_index(defs)
    found = references.join(in_file, ["file", "short"], "left").join(anywhere, "short", "left")
    return found.withColumn("target_id", F.coalesce("file_id", "any_id")).drop("file_id", "any_id")


def facts_of(sources: DataFrame, only_defined: bool = False) -> DataFrame:
    """Parsed sources, a row a file with arrays of defs, calls, imports and routes.

    Only files whose language can have routes and whose text shows a framework have routes. `only_defined` leaves out calls
    and routes of files without any definition.
    """
    parsed = repo.parse(sources)
    none = lambda c: F.slice(c, 1, 0)
    eligible = F.col("lang").isin(*ROUTE_LANGUAGES) & framework(F.col("lang"), F.col("content").cast("string")).isNotNull()
    parsed = parsed.withColumn("routes", F.when((F.size("routes") > 0) & eligible, F.col("routes")).otherwise(none("routes")))
    if only_defined:
        for c in ("calls", "routes"):
            parsed = parsed.withColumn(c, F.when(F.size("defs") > 0, F.col(c)).otherwise(none(c)))
    return parsed


def exploded(facts: DataFrame, kind: str) -> DataFrame:
    """Flat rows of one kind of fact: defs, calls, imports or routes."""
    return facts.select("file", "lang", F.explode(kind).alias("x")).select("file", "lang", "x.*")


def nodes_of(facts: DataFrame) -> DataFrame:
    files = file_nodes(facts.where("content is not null").select("file", "size"))
    return files.unionByName(definition_nodes(exploded(facts, "defs"))).unionByName(route_nodes(exploded(facts, "routes")))


def edges_of(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """CALLS and ROUTES edges (file, src, dst, kind) of the given facts, resolved over all nodes.

    A call is made by the smallest definition around it, else by its file, and goes to what its name resolves to; a route goes to
    its named handler. Both kinds of reference are resolved together. No call goes to its own source.
    """
    defs = nodes.where("kind not in ('File', 'Route')")
    fqn = F.concat_ws(" ", "method", "pattern")
    calls = exploded(facts, "calls").select("file", F.col("name").alias("short"), F.col("byte_start").alias("at"), F.lit(None).cast("long").alias("route"))
    routes = exploded(facts, "routes").where("handler_name is not null").select("file", F.col("handler_name").alias("short"), F.lit(None).cast("long").alias("at"), node_id(F.col("file"), fqn, F.lit("Route"), F.col("byte_start")).alias("route"))
    bound = resolve(calls.unionByName(routes), defs).where("target_id is not null")
    whole = node_id(F.col("file"), F.col("file"), F.lit("File"), F.lit(0))
    around = enclosing(bound, defs).select("file", F.coalesce("route", "id_found", whole).alias("src"), F.col("target_id").alias("dst"), F.when(F.col("route").isNull(), "CALLS").otherwise("ROUTES").alias("kind"))
    return around.where("kind = 'ROUTES' or src <> dst").distinct()


def graph_of(facts: DataFrame, more_edges: DataFrame | None = None) -> Graph:
    nodes = nodes_of(facts)
    edges = edges_of(facts, nodes).select("src", "dst", "kind")
    return Graph(nodes, edge_set(edges if more_edges is None else edges.unionByName(more_edges)))


# change detection


def classify(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status) of every file: new, unchanged, modified or deleted, by content hash and never by time.

    A current file without a hash could not be read and counts as modified.
    """
    return compared(previous, current).select("path", "status")


def compared(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Every file of then or now with its status, and all other columns of both."""
    before = previous.withColumnRenamed("content_hash", "old_hash").withColumn("was", F.lit(True))
    now = current.withColumn("is", F.lit(True))
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("modified")
    return before.join(now, "path", "full_outer").withColumn("status", status).drop("was", "is", "old_hash")


def change_counts(status: DataFrame) -> DataFrame:
    return status.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("new", "unchanged", "modified", "deleted")))


def sweep(graph: Graph, gone: DataFrame) -> Graph:
    """The graph without the nodes of the given files (path) and without edges that touch them, at either end."""
    paths = gone.select(F.col("path").alias("file"))
    dead = graph.nodes.join(paths, "file", "left_semi").select("id")
    edges = graph.edges.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Graph(graph.nodes.join(paths, "file", "left_anti"), edges.select("src", "dst", "kind"))


def languages_seen(sources: DataFrame) -> DataFrame:
    return sources.agg(F.sort_array(F.collect_set("lang")).alias("languages"))


def _status(current: DataFrame, store: Store, state: dict | None) -> DataFrame:
    """Every file of now or before: path, status, and its record of now with the parts that hold its rows so far."""
    now = current.select("path", F.unhex(F.sha2("content", 256)).alias("content_hash"), "mtime_ns", "lang")
    if state is None:
        return now.select("*", F.lit("new").alias("status"), F.lit(None).cast("long").alias("version"), F.lit(None).cast("long").alias("edge_version"))
    return compared(store.whole("files", state).select("path", "content_hash", "version", "edge_version"), now)


def _touched(facts: DataFrame, changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Files whose edges may change: those that did, and those that call, or route to, a name of the nodes that changed files have or had."""
    names = nodes.where("kind not in ('File', 'Route')").select(last_segment(F.col("fqn")).alias("name")).distinct()
    uses = exploded(facts, "calls").select("file", "name").unionByName(exploded(facts, "routes").select("file", F.col("handler_name").alias("name")))
    return uses.join(names, "name", "left_semi").select("file").unionByName(changed.select(F.col("path").alias("file"))).distinct()


def refresh(store: Store, sources: DataFrame, rebuild: bool = False, occurrences: DataFrame | None = None) -> dict:
    """Bring a project's store up to date with its sources; the counters of what changed, and of the graph.

    Nothing is written where nothing changed. Only new and modified files are parsed. Names are resolved again in the files that
    changed and in those that use a name which a changed file has or had, so the result equals a rebuild. `occurrences` are those
    of an external reference index; its edges are kept up to date with the rest from then on.
    """
    before = store.state()
    state = None if rebuild else before
    number = (before or {"version": 0})["version"] + 1
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    try:
        current = hold(sources)
        status = hold(_status(current, store, state))
        tally = (F.count_if(F.col("status") == s).alias(s) for s in ("new", "unchanged", "modified", "deleted"))
        report = status.agg(*tally, F.sort_array(F.collect_set("lang")).alias("languages_seen")).first().asDict()
        if state and occurrences is None and not (report["new"] or report["modified"] or report["deleted"]):
            return report | state["counts"]
        changed = status.where("status <> 'unchanged'").select("path")
        compact = state is None or len(state["parts"]["facts"]) >= FAN
        parts = {name: [] if compact else list(state["parts"][name]) for name in PARTED}
        stay = status.where("status = 'unchanged'")
        kept = lambda name: store.live(name, state, stay)

        def add(name: str, fresh: DataFrame, rest: DataFrame | None = None) -> DataFrame:
            """Store a part: the fresh rows, and where parts are written together the rest."""
            folder = store.put(name, fresh if rest is None or not compact else fresh.unionByName(rest.select(*fresh.columns)))
            parts[name].append([number, folder])
            return store.part(folder)

        if state is None:
            facts = add("facts", facts_of(current))
            nodes = add("nodes", nodes_of(facts))
            add("edges", edges_of(facts, nodes))
            touched = stay.select(F.col("path").alias("file"))
        else:
            old_facts, old_nodes = kept("facts"), kept("nodes")
            fresh = facts_of(current.join(changed, "path", "left_semi"))
            part = add("facts", fresh, old_facts)
            fresh = part.join(changed.withColumnRenamed("path", "file"), "file", "left_semi")
            facts = fresh.unionByName(old_facts.select(*fresh.columns))
            part = add("nodes", nodes_of(fresh), old_nodes)
            own = part.join(changed.withColumnRenamed("path", "file"), "file", "left_semi")
            nodes = hold(own.unionByName(old_nodes.select(*own.columns)))
            gone = store.live("nodes", state, status.where("status <> 'unchanged' and version is not null"))
            touched = hold(_touched(facts, changed, gone.unionByName(own)))
            some = hold(facts.join(touched, "file", "left_semi").select("file", "lang", "calls", "routes"))
            add("edges", edges_of(some, nodes), kept("edges").join(touched, "file", "left_anti"))
        again = touched.select(F.col("file").alias("path"), F.lit(True).alias("again"))
        version = F.lit(number).cast("long")
        fresh_edges = F.lit(compact) | (F.col("status") != "unchanged") | F.col("again").isNotNull()
        records = status.where("status <> 'deleted' and content_hash is not null").join(again, "path", "left").select(
            "path", "content_hash", "mtime_ns", "lang",
            F.when(F.lit(compact) | (F.col("status") != "unchanged"), version).otherwise(F.col("version")).alias("version"),
            F.when(fresh_edges, version).otherwise(F.col("edge_version")).alias("edge_version"),
        )
        made = {"version": number, "parts": parts, "tables": {"files": store.put("files", records)}}
        index = occurrences if occurrences is not None else store.whole("occurrences", state) if state else None
        if index is not None:
            kept_index = store.put("occurrences", index) if occurrences is not None else state["tables"]["occurrences"]
            texts = facts.where("content is not null").select(F.col("file").alias("document"), F.col("content").cast("string").alias("text"))
            edges, _ = scip_edges(store.part(kept_index), texts, nodes)
            made["tables"] |= {"occurrences": kept_index, "scip": store.put("scip", edges)}
        edges = store.live("edges", made).select("src", "dst", "kind")
        if "scip" in made["tables"]:
            edges = edges.unionByName(store.whole("scip", made))
        made["counts"] = counts(Graph(nodes, edges)).first().asDict()
        store.commit(made)
        return report | made["counts"]
    finally:
        for df in held:
            df.unpersist()


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a text; the whole where the range is out of bounds, a note where there is no text."""
    data = content.cast("binary")
    whole = (start < 0) | (end > F.octet_length(data)) | (start > end)
    part = F.substring(data, (start + 1).cast("int"), (end - start).cast("int"))
    return F.when(content.isNull(), F.lit("<source not available>")).otherwise(F.when(whole, data).otherwise(part).cast("string"))
