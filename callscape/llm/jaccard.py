"""N-gram Jaccard join by prefix trees: which documents share at least 80 % of their five-word shingles.

1. Every document becomes a set of 64-bit shingle hashes in one global order,
   rare before frequent; documents of equal sets become one node. Two sets of
   Jaccard similarity 0.8 must share an n-gram within the first
   |x| - ceil(0.8 |x|) + 1 of each, so only those are shuffled, and those that
   no two different sets share fall away in an aggregation.
2. Each n-gram has a leader, one of its nodes. Nodes are compared with the
   leaders of their n-grams, unless the sizes, or the number of n-grams that
   they have with the leader, show that this is no use. What is linked is one
   component from here on. The leader that a node shares most with also names
   its block: nodes that lie near each other, linked or not.
3. Where n-grams still join different components, each node there is a probe
   of the other blocks that have the n-gram, and of its own block if its
   component is not that of the block's leader. A block's sets are taken by
   classes of like size; sizes and the least number of prefix n-grams that
   links need rule classes out. So a group of near copies is one block, not a
   list of its pairs, and what already is one component is not compared again.

Comparing means: the sets of a block, or of one of its parts where it is
large, are stored in a trie in the global order, most frequent n-gram first,
with single-child paths contracted. All probes go down it together, each with
the overlap counted on the common path; a probe leaves a subtree as soon as
the n-grams that remain cannot reach the required overlap, or nothing is below
but components that it is linked with. Parts and probes are dealt out by size,
so a group of copies of any size becomes many tasks of bounded memory.

The order goes by a fixed-size table of counts: n-grams that recur within
single batches of a scan over all documents add to the slot of their hash. It
only orders n-grams: any order gives the same links. A node is a set's 64-bit
hash; a second one is compared with it, and sets that differ only there get
keys of their own.

Defined results: null and empty texts have no shingles, link with nothing and
are their own component; a null doc_id links with nothing and has a null
component; rows that repeat a doc_id each give a row and, if their texts
differ, are nodes of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, release, split_by_filter, table
from .words import hashed_batch, sequences, windows_of

SHINGLE = 5
#: The threshold as a ratio of whole numbers: PER * intersection >= LEAST * union.
LEAST, PER = 80, 100
#: Slots of the table of counts, and n-grams of a batch within which recurrence is counted.
SLOTS, BATCH = 1 << 18, 2_000_000
#: Sizes of a class differ by this factor at most.
CLASS = 1.05
#: N-grams of the sets that one part of a block, or one share of its probes, may hold, and entries of a table of probes by n-grams.
PART, TABLE = 400_000, 1 << 23
#: Rows that are hashed together, and set keys that a task remembers, so as to give a set's n-grams once.
ROWS, KEYS = 64, 100_000


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's `size`-word shingles (of all its words, if there are fewer), and where each text's begin."""
    words, cuts = hashed_batch(texts, lower=True)
    own, at = windows_of(words, cuts, size)
    counts = np.diff(cuts)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = np.insert(own, at[short], [sequences(words[cuts[i] : cuts[i + 1]], int(counts[i]))[0] for i in short])
        at = at + np.concatenate(([0], np.cumsum(np.isin(np.arange(len(counts)), short))))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own[lo:hi].sort()
    keep = np.ones(len(own), np.bool_)
    keep[1:] = own[1:] != own[:-1]
    keep[at[:-1][at[:-1] < at[1:]]] = True
    return own[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of one text."""
    return shingle_sets(pa.array([text], pa.string()), size)[0]


def set_keys(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    data = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:], "little", signed=True)


def prefix_length(n: int) -> int:
    return n - -(-LEAST * n // PER) + 1


def required(n: int, m: int) -> int:
    """Least intersection of sets of n and m elements that link."""
    return -(-LEAST * (n + m) // (PER + LEAST))


def slots(own: np.ndarray) -> np.ndarray:
    return (own & np.uint64(SLOTS - 1)).astype(np.int64)


def prefix(own: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first n-grams of a sorted set in the global order: by the level of their count, then by hash."""
    return own[np.argsort(level, kind="stable")[: prefix_length(len(own))]]


class Trie:
    """Contracted trie of sets, most frequent n-gram first. `links` finds the stored sets that probes link with."""

    def __init__(self, sets: list[np.ndarray], levels: np.ndarray, labels: list[int] | None = None):
        self.labels = list(range(len(sets))) if labels is None else labels
        self.universe = np.unique(np.concatenate(sets))
        turned = np.lexsort((self.universe, levels[slots(self.universe)]))[::-1]
        self.place = np.empty(len(turned), np.int64)  # of each n-gram in the order
        self.place[turned] = np.arange(len(turned))
        rows = [(np.sort(self.place[np.searchsorted(self.universe, s)]), i) for i, s in enumerate(sets)]
        rows.sort(key=lambda r: r[0].astype(">u4").tobytes())
        self.root = self._grow(rows)

    def _grow(self, rows: list[tuple[np.ndarray, int]]) -> tuple:
        """(label, least and greatest size below, depth after the label, sets that end here, children, the one component below or None)."""
        todo, made = [(rows, 0, None)], []
        while todo:
            own, at, parent = todo.pop()
            first, last = own[0][0], own[-1][0]
            n = min(len(first), len(last))
            differ = np.flatnonzero(first[at:n] != last[at:n])
            end = at + int(differ[0]) if len(differ) else n
            sizes, below = [len(r) for r, _ in own], {self.labels[i] for _, i in own}
            node = (first[at:end], min(sizes), max(sizes), end, [i for r, i in own if len(r) == end], [], below.pop() if len(below) == 1 else None)
            made.append(node)
            if parent is not None:
                parent[5].append(node)
            rest = [r for r in own if len(r[0]) > end]
            lo = 0
            for hi in range(1, len(rest) + 1):
                if hi == len(rest) or rest[hi][0][end] != rest[lo][0][end]:
                    todo.append((rest[lo:hi], end, node))
                    lo = hi
        return made[0]

    def links(self, probes: list[np.ndarray], labels: list[int] | None = None) -> list[tuple[int, int]]:
        """(probe, stored set) pairs that link; with labels, one for each other component that a probe links with."""
        out, step = [], max(1, TABLE // len(self.universe))
        for at in range(0, len(probes), step):
            out += self._links(probes[at : at + step], labels and labels[at : at + step], at)
        return out

    def _links(self, probes: list[np.ndarray], labels: list[int] | None, base: int) -> list[tuple[int, int]]:
        there = np.zeros((len(self.universe), len(probes)), np.bool_)  # by n-gram in the order
        for i, x in enumerate(probes):
            at = np.minimum(np.searchsorted(self.universe, x), len(self.universe) - 1)
            there[self.place[at[self.universe[at] == x]], i] = True
        n = np.array([len(x) for x in probes])
        done = [set() if labels is None else {label} for label in labels or probes]
        out, todo = [], [(self.root, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while todo:
            (label, low, high, depth, ends, children, one), who, overlap = todo.pop()
            if labels is not None and one is not None:
                open_ = np.array([one not in done[i] for i in who], np.bool_)
                who, overlap = who[open_], overlap[open_]
                if not len(who):
                    continue
            overlap = overlap + np.count_nonzero(there[label][:, who], axis=0)
            if ends:
                for i in who[PER * overlap >= LEAST * (n[who] + depth - overlap)].tolist():
                    for stored in ends:
                        own = self.labels[stored]
                        if labels is None or own not in done[i]:
                            done[i].add(own)
                            out.append((base + i, stored))
            if children:
                stay = overlap + np.minimum(n[who] - overlap, high - depth) >= -(-LEAST * (n[who] + low) // (PER + LEAST))
                if stay.any():
                    who, overlap = who[stay], overlap[stay]
                    todo += [(c, who, overlap) for c in children]
        return out


def frequent(docs: DataFrame) -> np.ndarray:
    """Levels of the slots of the table of counts: how often their n-grams recur within batches, on a logarithmic scale."""

    def run(batches):
        waiting, size = {}, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own, cuts = shingle_sets(batch["text"].slice(at, ROWS))
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if hi > lo:
                        one = own[lo:hi]
                        if waiting.setdefault(hashlib.blake2b(one.tobytes(), digest_size=16).digest(), one) is one:  # copies count once
                            size += hi - lo
                if size >= BATCH:
                    yield count(waiting)
                    waiting, size = {}, 0
        if waiting:
            yield count(waiting)

    def count(sets):
        h, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        keep = n >= 2
        total = np.bincount(slots(h[keep]), n[keep], SLOTS).astype(np.int64)
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    found = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    rows = found.select("slot", F.least(F.floor(2 * F.log2("n")) + 1, F.lit(127)).cast("byte").alias("level")).toArrow()  # at most SLOTS of 5 bytes
    levels = np.zeros(SLOTS, np.uint8)
    levels[rows["slot"].to_numpy()] = rows["level"].to_numpy()
    return levels


def sets(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(doc_id, tkey, n, skey, check, prefix) of every row.

    The text key tells rows that repeat a doc_id apart; skey and check are hashes of the set. Of equal sets in one task the
    first that has a doc_id has the prefix; the others' are empty.
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, keys, prefixes = batch.slice(at, ROWS), [], []
                own, cuts = shingle_sets(part["text"])
                level = levels[slots(own)]
                for lo, hi, known in zip(cuts[:-1].tolist(), cuts[1:].tolist(), part["doc_id"].is_valid().to_pylist(), strict=True):
                    keys.append(key := set_keys(own[lo:hi]))
                    fresh = known and hi > lo and key not in seen
                    if fresh:
                        if len(seen) >= KEYS:
                            seen.clear()
                        seen.add(key)
                    prefixes.append(prefix(own[lo:hi], level[lo:hi]).view(np.int64) if fresh else np.empty(0, np.int64))
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes)))
                skey, check = (pa.array(k, pa.int64()) for k in zip(*keys, strict=True))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["tkey"], pa.array(np.diff(cuts)), skey, check, lists], ["doc_id", "tkey", "n", "skey", "check", "prefix"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")
    return keyed.mapInArrow(run, "doc_id long, tkey long, n long, skey long, check long, prefix array<long>")


def compare(docs: DataFrame, nodes: DataFrame, work: DataFrame, levels: np.ndarray) -> DataFrame:
    """Links (a, b) found by `work`: rows (target, part, share, skey, label, stored, probe); one for each two components of a part and probe."""
    rows = materialize(work.join(nodes.select("skey", "doc_id"), "skey"), "work")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    near = split_by_filter(texts, ["doc_id"], rows.select("doc_id"))[1]

    def groups(batches) -> Iterator[list[tuple]]:
        """Rows (skey, label, stored, probe, set) of each group; the rows of a task come sorted by it."""
        now, own = None, {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found, cuts = shingle_sets(part["text"])
                columns = (part[c].to_pylist() for c in ("target", "part", "share", "skey", "check", "label", "stored", "probe"))
                for i, (target, number, share, skey, check, label, stored, probe) in enumerate(zip(*columns, strict=True)):
                    if (target, number, share) != now:
                        if own:
                            yield list(own.values())
                        now, own = (target, number, share), {}
                    one = found[cuts[i] : cuts[i + 1]]
                    if skey not in own and set_keys(one)[1] == check:  # rows that repeat a doc_id bring other texts along
                        own[skey] = (skey, label, stored, probe, one.copy())
        if own:
            yield list(own.values())

    def run(batches):
        out: list[tuple[int, int]] = []
        for group in groups(batches):
            stored, probes = [r for r in group if r[2]], [r for r in group if r[3]]
            if stored and probes:
                trie = Trie([r[4] for r in stored], levels, [r[1] for r in stored])
                out += [(probes[i][0], stored[j][0]) for i, j in trie.links([r[4] for r in probes], [r[1] for r in probes])]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
                out = []
        if out:
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    group = ["target", "part", "share"]
    joined = near.join(rows, "doc_id").select(*group, "skey", "check", "label", "stored", "probe", "text")
    found = materialize(joined.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long"), "links")
    release(rows)
    return found


def near_sizes(n, m):
    return (PER * F.least(n, m) >= LEAST * F.greatest(n, m)).cast("boolean")


def shared_prefix(n, m):
    """Least number of prefix n-grams that linking sets of n and m elements share.

    Of the two prefixes let x's end first in the global order. What the sets share up to there is in both prefixes; beyond it
    x has no more than its n - prefix_length(n) elements left.
    """
    rest = lambda k: F.ceil(LEAST * k / PER) - 1
    return F.ceil(LEAST * (n + m) / (PER + LEAST)) - F.greatest(rest(n), rest(m))


def least_shared(n, low, high):
    """Least `shared_prefix` of n with any size from low to high.

    Up to n the bound rises with the size. Above n, going down by d sizes from the greatest lowers its first term by at most
    ceil(4 d / 9) and its second by at least floor(4 d / 5), which is no less unless d is 1.
    """
    return F.least(*(shared_prefix(n, m) for m in (low, F.greatest(low, high - 1), high)))


def deal(stored: DataFrame, probes: DataFrame) -> DataFrame:
    """Work for `compare` from (target, skey, n, check, label): stored sets in parts, probes in shares, both of bounded size, each part with each share."""
    count = lambda df, name: df.groupBy("target").agg(F.ceil(F.sum("n") / PART).alias(name))
    sizes = count(stored, "parts").join(count(probes, "shares"), "target")
    own = lambda name: F.pmod(F.xxhash64("skey"), F.col(name))
    each = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    rest = ("skey", "check", "label")
    a = stored.join(sizes, "target").select("target", own("parts").alias("part"), each("shares").alias("share"), *rest, F.lit(True).alias("stored"), F.lit(False).alias("probe"))
    b = probes.join(sizes, "target").select("target", own("shares").alias("share"), each("parts").alias("part"), *rest, F.lit(False).alias("stored"), F.lit(True).alias("probe"))
    # what is stored and a probe in one place goes there once
    return a.unionByName(b).groupBy("target", "part", "share", *rest).agg(F.bool_or("stored").alias("stored"), F.bool_or("probe").alias("probe"))


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every end of an edge (a, b): the least end it is connected to. Minimum labels with pointer jumping; each round is stored."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    first = both.groupBy("a").agg(F.min("b").alias("b"))
    labels = materialize(first.select(F.col("a").alias("v"), F.least("a", "b").alias("label")), "labels")
    while True:
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("next"))
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        moved = labels.join(near, labels.v == near.a, "left").select("v", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        moved = moved.join(jump, "label", "left").select("v", "old", F.least("label", "next").alias("label"))
        moved = materialize(moved, "labels")
        release(labels)
        labels = moved.select("v", "label")
        if moved.where("label <> old").isEmpty():
            release(both)
            return labels


def nodes_of(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks, stored nodes as skey, check, doc_id, n): one node a set. Sets that have only their first hash in common get new keys first."""
    while True:
        made = marks.where("doc_id is not null and n > 0").groupBy("skey").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("check").alias("check"), F.max("check").alias("other"))
        nodes = materialize(made, "nodes")
        clash = nodes.where("check <> other").select("skey", F.lit(True).alias("again"))
        if clash.isEmpty():
            return marks, nodes.drop("other")
        key = F.when(F.col("again"), F.xxhash64("skey", "check")).otherwise(F.col("skey"))
        marks = materialize(marks.join(clash, "skey", "left").withColumn("skey", key).drop("again"), "sets")


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of doc_id, tkey, n, skey; labels of linked nodes as skey, label)."""
    levels = frequent(docs)
    marks, nodes = nodes_of(materialize(sets(docs, levels), "sets"))
    n = F.col("n")
    short = F.col("pos") < n - F.ceil(2 * LEAST * n / (PER + LEAST)) + 1
    posts = marks.where("size(prefix) > 0").select("skey", "n", F.posexplode("prefix").alias("pos", "h")).select("h", "skey", "n", short.alias("short"))
    leaders = posts.groupBy("h").agg(F.min("skey").alias("leader"), F.max("skey").alias("last")).where("leader < last").select("h", "leader")
    leaders = materialize(leaders, "leaders")
    posts = materialize(split_by_filter(posts, ["h"], leaders)[1].join(leaders, "h").distinct(), "posts")
    rows = materialize(marks.select("doc_id", "tkey", "n", "skey"), "rows")
    for done in (leaders, marks):
        release(done)
    # round one: nodes and leaders. What cannot link is not compared; the second round does not rely on this one
    near = materialize(posts.groupBy("skey", "leader").agg(F.min("n").alias("n"), F.count("*").alias("shared")), "near")
    blocks = near.groupBy("skey").agg(F.max_by("leader", "shared").alias("block"))
    other = nodes.select(F.col("skey").alias("leader"), F.col("n").alias("leader_n"))
    led = near.where("skey <> leader").join(other, "leader").where(near_sizes(n, F.col("leader_n")) & (F.col("shared") >= shared_prefix(n, F.col("leader_n"))))
    led = materialize(led.select(F.col("leader").alias("target"), "skey"), "led")
    known = nodes.select("skey", "check", "n", F.col("skey").alias("label"))
    heads = led.select("target").distinct().select("target", F.col("target").alias("skey"))
    first = compare(docs, nodes, deal(heads.join(known, "skey"), led.join(known, "skey")), levels)
    # round two: blocks and what they may still link with
    linked = components(first)
    named = blocks.join(linked.withColumnRenamed("v", "skey"), "skey", "left").withColumn("label", F.coalesce("label", "skey"))
    named = materialize(named, "named")
    release(near)
    main = named.select(F.col("skey").alias("block"), F.col("label").alias("main"))
    info = materialize(named.join(main, "block", "left"), "info")
    release(named)
    told = materialize(posts.drop("leader").join(info, "skey").withColumn("class", F.floor(F.log("n") / F.lit(math.log(CLASS))).cast("int")), "told")
    release(posts)
    open_ = materialize(told.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h"), "open")
    contested = materialize(split_by_filter(told, ["h"], open_)[1].join(open_, "h"), "contested")  # stored, as all below, so that a hot side of a join can be split
    release(told)
    brief = F.when(F.col("short"), n)
    sides = contested.groupBy("h", F.col("block").alias("target"), F.col("class").alias("side")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min(brief).alias("brief_low"), F.max(brief).alias("brief_high"), F.min("label").alias("label_low"), F.max("label").alias("label_high")
    )
    sides = materialize(sides, "sides")
    # a link's smaller set has an n-gram in its first |x| - ceil(8/9 |x|) + 1 that the larger has in its prefix
    asked = (F.col("brief_low") <= n) & (PER * F.col("brief_high") >= LEAST * n) | F.col("short") & (F.col("high") >= n) & (LEAST * F.col("low") <= PER * n)
    mine = (F.col("block") > F.col("target")) | (F.col("block") == F.col("target")) & (F.col("label") != F.col("main"))
    strange = (F.col("label_low") != F.col("label")) | (F.col("label_high") != F.col("label"))
    pairs = contested.join(sides, "h").where(mine & strange & (PER * F.col("high") >= LEAST * n) & (LEAST * F.col("low") <= PER * n))
    pairs = pairs.groupBy("target", "side", "skey", "n").agg(F.count("*").alias("count"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or(F.coalesce(asked, F.lit(False))).alias("asked"))
    # sizes in the class that could link
    low, high = F.greatest("low", F.ceil(LEAST * n / PER)), F.least("high", F.floor(PER * n / LEAST))
    probes = pairs.where(F.col("asked") & (low <= high) & (F.col("count") >= least_shared(n, low, high)))
    probes = materialize(probes.select("target", "side", "skey"), "probes")
    checks = nodes.select("skey", "check", "n").join(info.select("skey", "label"), "skey")
    stored = contested.select(F.col("block").alias("target"), F.col("class").alias("side"), "skey").distinct().join(probes.select("target", "side").distinct(), ["target", "side"], "left_semi")
    for done in (led, open_, sides):
        release(done)
    second = compare(docs, nodes, deal(stored.drop("side").join(checks, "skey"), probes.drop("side").distinct().join(checks, "skey")), levels)
    for done in (info, contested, probes):
        release(done)
    labels = components(first.unionByName(second))
    return rows, labels.select(F.col("v").alias("skey"), "label")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, n_shingles and component_id of every row."""
    rows, labels = link(docs)
    least = rows.where("doc_id is not null and n > 0").groupBy("skey").agg(F.min("doc_id").alias("least"))
    root = least.join(labels, "skey", "left").withColumn("label", F.coalesce("label", "skey"))
    smallest = root.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = root.join(smallest, "label").select("skey", "component_id")
    found = rows.join(by_set, "skey", "left")
    return found.select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked documents the one with the smallest doc_id stays.

    Rows that repeat a doc_id go or stay by their own texts: a row goes if its text links it to a smaller doc_id. All rows of a
    group that have its smallest doc_id stay, exact repeats and near copies of each other included.
    """
    gone = join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone id"), F.col("tkey").alias("gone key")).distinct()
    gone, keys = materialize(gone, "gone"), ["gone id", "gone key"]
    named = docs.withColumn("gone id", F.col("doc_id").cast("long")).withColumn("gone key", F.xxhash64("text"))
    clear, near = split_by_filter(named, keys, gone)
    return clear.unionByName(near.join(gone, keys, "left_anti").select(*named.columns)).select(*docs.columns)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = join(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
