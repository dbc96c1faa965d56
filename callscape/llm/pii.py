"""Personal data: fixed patterns, and bootstrapped contextual extraction, all in DataFrame functions.

Base entities come from fixed patterns and checks. They seed the bootstrap:
a mention is an identifier-like token with words beside it, its patterns are
the one, two and three words before it, the two words after it, and one word
on either side. Mentions form a graph of patterns and token instances, and
rounds of scoring pass between the two: a pattern's confidence in a kind is
the share of its instances' scores; a seed scores 1, another instance the
noisy-or of its mentions without that pattern, each taken at the confidence of
its surest pattern. So patterns that hold together in one place cannot vouch
for each other, and copies of a text are one mention. Patterns that are sure
enough, with enough different seeds, then name the kind of the identifiers in
them that no fixed pattern covers; of several patterns the surest decides.

Offsets come from cutting a text at its matches and adding up lengths (code
points), in blocks. What several steps of that read is bound to a variable of
its own (`let`), else it would be worked out again for each element; so the
time is in proportion to the text and its matches. The regular
expressions are the contract's, made possessive and given left borders that
change no match but keep long runs linear and free of recursion.

Defined results: null and empty texts have no spans; rows with a null doc_id
have their base spans; repeated rows each give a row, of equal spans; an empty
table gives no rows; other columns are ignored (the redacting stage keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, release, split_by_filter, table

#: The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a text has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TOKEN = r"(?<![A-Za-z0-9._%+@-])(?:\+[0-9][\x20().0-9-]+[0-9]|[0-9](?:[\x20-]?[0-9]){12,18}+|[A-Za-z0-9._%+@-]*[0-9@][A-Za-z0-9._%+@-]*)"
#: Up to three words before a token and two behind it, within that many characters.
BEFORE = r"(?<!\p{L})((?:\p{L}{2,20}+[\x20:=#]{1,3}){1,3})$"
AFTER = r"^[\x20,;.)]{1,3}(\p{L}{2,20}+(?:\x20\p{L}{2,20}+)?)"
REACH = 72
BLOCK = 128
#: What a pattern needs: confidence, and different seeds.
SURE, SEEDS, ROUNDS = 0.75, 4, 3
#: Most that a pattern counts for, so that there is a logarithm of the rest.
MOST = 1 - 2.0**-40
#: Characters in a piece of a text that is cut at many places.
PIECE = 4096


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often `use` reads it, inside other lambdas as well."""
    return F.transform(F.array(value), use)[0]


def each(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def before(x: Column, zero: Column, fold) -> Column:
    """For each element of an array the fold of those before it, by blocks: an array of the same size."""
    total = lambda part: F.aggregate(part, zero, fold)
    at = lambda i: F.floor(i / BLOCK).cast("int")

    def from_blocks(v: Column, outer: Column) -> Column:
        return F.transform(each(F.size(v)), lambda i: fold(F.get(outer, at(i)), total(F.slice(v, at(i) * BLOCK + 1, i - at(i) * BLOCK))))

    def with_inner(v: Column, inner: Column) -> Column:
        return let(F.transform(each(F.size(inner)), lambda b: total(F.slice(inner, F.lit(1), b))), lambda outer: from_blocks(v, outer))

    blocks = lambda v: F.transform(each(F.ceil(F.size(v) / BLOCK).cast("int")), lambda b: total(F.slice(v, b * BLOCK + 1, BLOCK)))
    return let(x, lambda v: let(blocks(v), lambda inner: with_inner(v, inner)))


def matches(text: Column, pattern: str) -> Column:
    """Array of (text, start, end, before, after) of the leftmost non-overlapping matches; the last two are the text up to the next matches."""

    def spans(found: Column, gaps: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.char_length(g) + F.char_length(m))
        return let(before(lengths, F.lit(0), lambda a, v: a + v), lambda sums: F.transform(found, lambda m, i: one(m, i, gaps, sums)))

    def one(m: Column, i: Column, gaps: Column, sums: Column) -> Column:
        start = F.get(sums, i) + F.char_length(F.get(gaps, i))
        return F.struct(m.alias("text"), start.alias("start"), (start + F.char_length(m)).alias("end"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after"))

    empty = F.from_json(F.lit("[]"), "array<struct<text: string, start: int, end: int, before: string, after: string>>")
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(every, lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: spans(found, gaps))).otherwise(empty))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Check digit test of a string of digits."""
    turned = F.reverse(x)

    def worth(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(x)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255)
        return F.forall(F.split(x, r"\."), small)
    if kind == "card":
        d = digits(x)
        return F.char_length(d).between(13, 19) & luhn(d)
    if kind == "phone":
        return F.char_length(digits(x)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind number, start, end) of all base entities, by kind and start."""
    none = F.from_json(F.lit("[]"), "array<struct<kind: int, start: int, end: int>>")

    def own(n: int, kind: str) -> Column:
        good = F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["text"]))
        found = F.transform(good, lambda m: F.struct(F.lit(n).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
        return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none) if NEEDS[kind] else found

    parts = [own(n, kind) for n, kind in enumerate(KINDS)]
    return F.coalesce(F.concat(*parts), none)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), F.coalesce("text", F.lit("")).alias("text"))


def patterns(left: Column, right: Column) -> Column:
    """The patterns of a mention from the words before and behind it, `_` for its place."""
    last = lambda n: F.when(F.size(left) >= n, F.concat(F.array_join(F.slice(left, -n, n), " "), F.lit(" _")))
    both = F.when((F.size(left) >= 1) & (F.size(right) >= 1), F.concat(F.get(left, F.size(left) - 1), F.lit(" _ "), F.get(right, F.lit(0))))
    behind = F.when(F.size(right) >= 2, F.concat(F.lit("_ "), F.array_join(F.slice(right, 1, 2), " ")))
    return F.filter(F.array(last(1), last(2), last(3), both, behind), lambda p: p.isNotNull())


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, mention, cue, token, start, end, seed): identifier-like tokens, a row for each pattern; seed is the kind
    number of a base entity, and mentions of a token between the same words have one key."""
    rows = keyed(docs).where(F.col("text").rlike("[0-9@]")).select("doc_id", "tkey", F.explode(matches(F.col("text"), TOKEN)).alias("m"))
    words = lambda x: F.filter(F.split(F.lower(x), r"[\x20:=#]+"), lambda w: w != "")
    token = F.regexp_replace("m.text", r"[.\-]++$", "")  # closing punctuation is no part of it
    left = words(F.regexp_extract(F.substring("m.before", -REACH, REACH), BEFORE, 1))
    right = F.when(F.char_length(token) == F.char_length("m.text"), words(F.regexp_extract(F.substring("m.after", 1, REACH), AFTER, 1))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", "tkey", token.alias("token"), F.col("m.start").alias("start"), left.alias("left"), right.alias("right"))
    rows = rows.where("token <> '' and (size(left) > 0 or size(right) > 1)")
    seed = F.lit(None).cast("int")
    for n, kind in reversed(list(enumerate(KINDS))):
        whole = F.regexp_extract("token", f"^(?:{PATTERNS[kind]})$", 0)
        seed = F.when((whole != "") & valid(kind, whole), F.lit(n)).otherwise(seed)
    rows = rows.select("doc_id", "tkey", "token", "start", (F.col("start") + F.char_length("token")).cast("int").alias("end"), seed.alias("seed"), "left", "right")
    mention = F.xxhash64("token", "left", "right")
    return rows.select("doc_id", "tkey", mention.alias("mention"), F.explode(patterns(F.col("left"), F.col("right"))).alias("cue"), "token", "start", "end", "seed")


def bootstrap(found: DataFrame) -> DataFrame:
    """(cue, kind, confidence) of the patterns that the pattern-instance graph makes sure."""
    edges = materialize(found.groupBy("cue", "token", "mention").agg(F.max("seed").alias("seed")), "edges")
    instances = materialize(edges.groupBy("cue", "token").agg(F.max("seed").alias("kind")), "instances")
    sizes = instances.groupBy("cue").agg(F.count("*").alias("n"))
    seeds = instances.where("kind is not null").groupBy("cue", "kind").agg(F.count("*").alias("seeds"))
    told = materialize(seeds.where(f"seeds >= {SEEDS}").join(sizes, "cue"), "told")  # patterns that can become sure
    sure = told.select("cue", "kind", (F.col("seeds") / (F.col("n") + 1)).alias("confidence"))
    open_ = materialize(edges.where("seed is null").select("cue", "token", "mention").join(told.select("cue").distinct(), "cue"), "guesses")
    for _ in range(ROUNDS - 1):
        rest = F.log(1 - F.least(F.max("confidence"), F.lit(MOST)))
        by_mention = materialize(open_.join(sure, "cue").groupBy("token", "mention", "kind").agg(rest.alias("rest")), "by-mention")
        by_token = by_mention.groupBy("token", "kind").agg(F.sum("rest").alias("whole"))
        own = open_.join(by_mention, ["token", "mention"]).groupBy("cue", "token", "kind").agg(F.sum("rest").alias("own"))
        other = own.join(by_token, ["token", "kind"]).groupBy("cue", "kind").agg(F.sum(1 - F.exp(F.col("whole") - F.col("own"))).alias("mass"))
        mass = F.col("seeds") + F.greatest(F.coalesce("mass", F.lit(0.0)), F.lit(0.0))
        sure = materialize(told.join(other, ["cue", "kind"], "left").select("cue", "kind", (mass / (F.col("n") + 1)).alias("confidence")), "patterns")
        release(by_mention)
    for done in (edges, instances):
        release(done)
    best = F.max_by("kind", F.struct("confidence", "kind")).alias("kind")
    return sure.where(f"confidence >= {SURE}").groupBy("cue").agg(best, F.max("confidence").alias("confidence"))


def discovered(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, more): spans that sure cues add, for the rows that have any."""
    found = materialize(mentions(docs), "mentions")
    sure = bootstrap(found)
    hits = found.where("seed is null").join(sure, "cue").groupBy("doc_id", "tkey", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    out = materialize(hits.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("more")), "discovered")
    release(found)
    return out


def told(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    more = discovered(docs).select(F.col("doc_id").alias("more id"), F.col("tkey").alias("more key"), "more")
    rows = keyed(docs).select("doc_id", "tkey", base_spans(F.col("text")).alias("base"))
    rows = rows.join(more, F.col("doc_id").eqNullSafe(F.col("more id")) & (F.col("tkey") == F.col("more key")), "left")
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    both = F.array_sort(F.concat("base", F.coalesce("more", F.slice("base", 1, 0))))
    every = let(both, lambda x: F.filter(x, lambda s, i: F.coalesce(s != F.get(x, i - 1), F.lit(True))))
    return rows.select("doc_id", *(count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(every).alias("spans"))


def cutter(text: Column, use) -> Column:
    """use(part), where part(start, end) is a part of the text whose cost does not depend on where it lies."""

    def part(pieces: Column, start: Column, end: Column) -> Column:
        a, b = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        get = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
        far = F.concat(F.substring(get(a), start - a * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(get(b), F.lit(1), end - b * PIECE))
        return F.when(a == b, F.substring(get(a), start - a * PIECE + 1, end - start)).otherwise(far)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(pieces, lambda p: use(lambda start, end: part(p, start, end)))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones together, replaced by the kind of the first in angle brackets."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def with_reach(own: Column, reach: Column) -> Column:
        """reach: for each span how far those before it come; a span that starts behind that starts a group."""
        heads = F.filter(F.transform(own, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.get(reach, i).alias("past"))), lambda h: h["start"] >= h["past"])
        last = F.array_max(F.transform(own, lambda s: s["end"]))
        return let(last, lambda end: let(heads, lambda h: cutter(text, lambda part: written(h, end, part))))

    def written(heads: Column, end: Column, part) -> Column:
        shown = F.transform(heads, lambda h, i: F.concat(part(F.greatest(h["past"], F.lit(0)), h["start"]), F.element_at(names, h["kind"] + 1)))
        return F.concat(F.array_join(shown, ""), part(end, F.char_length(text)))

    reach = lambda own: before(F.transform(own, lambda s: s["end"]), F.lit(-1), lambda a, v: F.greatest(a, v))
    return F.when(F.size(spans) > 0, let(order, lambda own: let(reach(own), lambda past: with_reach(own, past)))).otherwise(text)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced by its kind; n_chars follows the text."""
    more = discovered(docs).select(F.col("doc_id").alias("pii id"), F.col("tkey").alias("pii key"), "more").withColumnRenamed("more", "pii more")
    named = docs.withColumn("pii id", F.col("doc_id").cast("long")).withColumn("pii key", F.xxhash64("text"))
    clear, near = split_by_filter(named, ["pii id", "pii key"], more)
    near = near.join(more, ["pii id", "pii key"], "left").select(*docs.columns, "pii more")
    rows = clear.select(*docs.columns).withColumn("pii more", F.lit(None).cast(more.schema["pii more"].dataType)).unionByName(near)
    base = base_spans(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("pii spans", F.concat(base, F.coalesce("pii more", F.slice(base, 1, 0))))
    out = rows.withColumn("text", F.when(F.size("pii spans") > 0, redact(F.col("text"), F.col("pii spans"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
