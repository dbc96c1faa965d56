"""The corpus operators against brute force, exact round trips and held-out labels, and their defined results at the edges."""

from __future__ import annotations

import hashlib
import os
import random
import re
import string
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from callscape.llm import ann, chat, jaccard, packing, pieces, pii, quality, records, shared, substrings, tokens, topk, vectors

BPE = public_tokenizers.path("word_bpe_49k.json")
SPM = public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LONG_TEXT = "one two three four five six seven eight nine ten " * 3000
DOCS = "doc_id long, text string, lang string, n_chars long, score double, starts string"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def docs_of(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, None, None, 0.5, "x") for i, t in (texts.items() if isinstance(texts, dict) else texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [(0, None), (1, ""), (2, LONG_TEXT), (3, "a b"), (3, "a b"), (None, "mail x@y.zz now"), (4, " \t\n"), (5, LONG_TEXT), (7, "é漢字 😀 \x1c <|endoftext|>")]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# tokens and records


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t.,'sİΣé<|>")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_cached_encoder_equals_the_library(text):
    assert cached(text) == plain(text)


cached, plain = tokens.Encoder(BPE, keep=50), tokens.Encoder(BPE, cached=False)


def test_frames_find_damage():
    data = b"".join(records.frame(p) + b"\n" for p in (b"", b"abc", b"\n" * 9))
    assert [bytes(p) for _, p in records.frames(data)] == [b"", b"abc", b"\n" * 9]
    for at in range(len(data)):
        if data[at : at + 1] != b"\n" or at in (1, 2):
            broken = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
            try:
                assert [bytes(p) for _, p in records.frames(broken)] == [b"", b"abc", b"\n" * 9]  # only a closing LF may differ
            except ValueError:
                pass
    with pytest.raises(ValueError):
        list(records.frames(data[:-4]))


def test_records_round_trip(spark, tmp_path):
    path = str(tmp_path / "r")
    records.write(docs_of(spark, EDGES), path, BPE, end_id=2, shard_bytes=20_000)
    index = records.build_index(spark, path)
    back = records.read(spark, path)
    want = Counter((d, plain(t or "") + struct.pack("<I", 2)) for d, t in EDGES)
    assert Counter((r.doc_id, bytes(r.ids)) for r in back.collect()) == want
    order = [r.doc_id for r in index.orderBy("shard", "offset").collect()]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    mixed = records.read_shuffled(spark, path, seed=3)
    assert Counter((r.doc_id, bytes(r.ids)) for r in mixed.collect()) == want
    empty = str(tmp_path / "e")
    records.write(docs_of(spark, []), empty, BPE, end_id=2)
    assert records.read(spark, empty).count() == 0


@needs_data
def test_op1(spark, real):
    start = 0
    found = {r.doc_id: r for r in records.op1_token_records(spark, DATA).collect()}
    for r in sorted(real.collect(), key=lambda r: r.doc_id):
        ids = plain(r.text or "") + struct.pack("<I", 2)
        f = found[r.doc_id]
        assert (f.start, f.n_tokens, f.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


# packing


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=150, deadline=None)
def test_plan_places_everything(lengths):
    count = Counter(lengths)
    runs = packing.plan(count, 40)
    slots = defaultdict(list)
    for x, lo, hi, seq, offset in runs.tolist():
        for k in range(hi - lo):
            slots[seq + k].append((offset, x))
    assert Counter(x for s in slots.values() for _, x in s) == count
    for s in slots.values():
        at = 0
        for offset, x in sorted(s):
            assert offset == at
            at += x
        assert at <= 40
    least = -(-sum(lengths) // 40)
    assert len(slots) <= 1.34 * least + 1


def test_exact_combinations_fill():
    for parts in ([40], [30, 10], [20, 15, 5], [16, 12, 8, 4]):
        assert len({r[3] for r in packing.plan(Counter(parts), 40).tolist()}) == 1


def test_packing_edges(spark):
    found = packing.pack(docs_of(spark, EDGES), BPE, capacity=64).collect()
    want = defaultdict(list)
    for d, t in EDGES:
        ids = plain(t or "") + struct.pack("<I", 1)
        for k, at in enumerate(range(0, len(ids), 256)):
            want[d, k, at // 4].append((len(ids[at : at + 256]) // 4, zlib.crc32(ids[at : at + 256])))
    got = defaultdict(list)
    for r in found:
        got[r.doc_id, r.piece, r.start].append((r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(docs_of(spark, []), BPE).count() == 0
    stored = shared.materialize(packing.pieces(docs_of(spark, EDGES), BPE, capacity=64), "t")
    made = packing.sequences(packing.place(stored, 64)).collect()
    assert sum(r.n_tokens for r in made) == sum(r.length for r in found) and max(r.n_tokens for r in made) <= 64


# vectors

VECTORS = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (100, [0.5, 0.5]), (3, [float("nan"), 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [1.0]), (200, [-1.0, 0.25]), (100, [0.5, 0.5]), (None, [1.0, 1.0])]


def test_search_edges(spark):
    df = spark.createDataFrame([(i, v, 9) for i, v in VECTORS], "vec_id long, embedding array<double>, score int")
    own = vectors.usable(df)
    found = topk.search(own, own.where(vectors.is_query("vec_id", 100)), 3, tile=2).collect()
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)
    points = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in VECTORS if i is not None and v and len(v) == 2 and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in points:
        if i % 100 == 0:
            best = sorted((-int(q @ d), j) for j, d in points if j != i)[:3]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    none = vectors.usable(df.limit(0))
    assert topk.search(none, none, 3).count() == 0
    near = vectors.usable(df, zero=False)
    assert {r.vec_id for r in ann.search(near, near.where("vec_id = 0"), 20).collect()} == {1, 100, 200}
    assert ann.search(near.limit(0), near.limit(0), 20).count() == 0


def test_products_stay_exact():
    q, d = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [1.0, -(2.0**30)]])
    assert products_list(q, d) == [[2**60 + 3, 2**40 - 3 * 2**30]]


def products_list(q, d):
    return [[int(x) for x in row] for row in topk.products(q, d)]


def test_op2_and_op5(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    os.makedirs(tmp_path / "t")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "t" / "embeddings.parquet"))
    s = np.floor(1024 * x.astype(float)) @ np.floor(1024 * x.astype(float)).T
    got = defaultdict(list)
    for r in topk.op2_exact_topk(spark, str(tmp_path / "t")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 1500, 100):
        best = sorted((-s[q, j], j) for j in range(1500) if j != q)[:10]
        assert got[q] == [(j, -v) for v, j in best]
    hits, exact = defaultdict(dict), x.astype(float) @ x.astype(float).T
    for r in ann.op5_nearest_neighbours(spark, str(tmp_path / "t")).collect():
        assert abs(r.score - exact[r.query_id, r.vec_id]) < 1e-9
        hits[r.query_id][r.vec_id] = r.rank
    np.fill_diagonal(exact, -np.inf)
    found = [len(set(np.argsort(-exact[q])[:20]) & set(hits[q])) for q in range(0, 1500, 20)]
    assert all(len(h) == 20 for h in hits.values()) and sum(found) / (20 * len(found)) >= 0.9


# personal data

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text) if good(k, m.group()))


def test_base_spans_equal_the_contract(spark):
    rng = np.random.default_rng(1)
    parts = ["a", ".", "@", "b.c", "-", "_", " ", "+1", "4111111111111111", "4111 1111 1111 1111", "255.", "1.2.3.4", "(", "5", "é", "😀", "x@y.zz", "+44 20 7946 0958", "\n", "999.1.1.1", "0001.2.3.4"]
    texts = ["".join(rng.choice(parts, size=rng.integers(1, 30))) for _ in range(400)]
    texts += ["x" * 3000 + "@" + "b." * 3000 + "c", "1" * 5000 + " 4111111111111111", "+1" + " 2" * 3000, "", "mail: q@w.e," * 400, "9 " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    rows = df.select("i", pii.told(pii.base_spans(F.col("text"))).alias("s"), pii.redact(F.col("text"), pii.base_spans(F.col("text"))).alias("r")).collect()
    for r in rows:
        assert r.s == base_spans(texts[r.i]), texts[r.i]
        if r.s:
            assert re.search("<(EMAIL|IP|CARD|PHONE)>", r.r)


def test_cues_find_what_patterns_miss(spark, tmp_path):
    seeds = {i: f"please write contact: user{i}@mail{i}.example.com today" for i in range(12)}
    seeds |= {20 + i: f"the {i}5 apples and contacts {i}" for i in range(12)}
    seeds |= {50: "please write contact: hidden99@intranet today", 51: None}
    docs_of(spark, seeds).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in pii.op3_personal_data(spark, str(tmp_path)).collect()}
    assert found[50].spans == "email:22:39" and found[50].n_email == 0
    assert found[50].base_sha256 == found[51].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[25].spans == "" and found[3].spans == base_spans(seeds[3])
    stage = {r.doc_id: r for r in pii.personal_data_stage(spark, docs_of(spark, seeds), "").collect()}
    assert stage[50].text == "please write contact: <EMAIL> today" and stage[51].text is None and stage[25].text == seeds[25]


def test_many_matches_stay_cheap(spark):
    """Time in proportion to the matches: two orders of magnitude more of them take well below four orders more time."""
    part = "user7@mail7.example.com, "
    texts = {1: part * 100_000, 2: "9" * 200_000, 3: "a" * 200_000, 4: "+1 " * 50_000}
    df = spark.createDataFrame(list(texts.items()), "i long, text string")
    began = time.monotonic()
    rows = df.select("i", pii.base_spans(F.col("text")).alias("s"), "text").select("i", F.size("s").alias("n"), F.get("s", F.size("s") - 1).alias("last"), pii.redact(F.col("text"), F.col("s")).alias("r")).collect()
    assert time.monotonic() - began < 90
    found = {r.i: r for r in rows}
    assert found[1].n == 100_000 and tuple(found[1].last) == (0, 99_999 * len(part), 99_999 * len(part) + 23) and found[1].r == "<EMAIL>, " * 100_000
    assert all(found[i].n == 0 and found[i].r == texts[i] for i in (2, 3, 4))


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30), st.integers(1, 9)), max_size=12))
@settings(max_examples=25, deadline=None)
def test_redaction_equals_brute_force(spark, monkeypatched_blocks, spans):
    text = "".join(chr(0x1F600 + k) if k % 5 == 0 else chr(97 + k % 26) for k in range(40))
    want, reach, out = sorted((a, min(40, a + n), k) for k, a, n in spans), 0, ""
    for a, b, k in want:
        if a >= reach:
            out += text[reach:a] + f"<{pii.KINDS[k].upper()}>"
        reach = max(reach, b)
    made = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b, k in want)) if want else F.array().cast("array<struct<kind: int, start: int, end: int>>")
    assert spark.range(1).select(pii.redact(F.lit(text), made).alias("r")).first().r == out + text[reach:]


@pytest.fixture(scope="module")
def monkeypatched_blocks():
    old = pii.BLOCK, pii.PIECE
    pii.BLOCK, pii.PIECE = 3, 4
    yield
    pii.BLOCK, pii.PIECE = old


def test_patterns_reach_three_words_on_both_sides(spark, tmp_path):
    """Planted identifiers that no fixed pattern covers, in contexts of which only the wider ones are telling."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), size=7))
    texts, planted = {}, {}
    for i in range(60):
        hidden = f"box{i}@local"
        shown = f"user{i}@mail{i}.example.com" if i < 30 else hidden
        for k, frame in enumerate(("{w} you can reach me {x} {v}", "{w} {x} is my mailbox {v}", "{w} from {x} wrote {v}")):
            n = 100 * k + i
            texts[n] = frame.format(w=word(), v=word(), x=shown)
            if i >= 30:
                planted[n] = (texts[n].index(hidden), texts[n].index(hidden) + len(hidden))
        texts[300 + i] = f"{word()} reach me {i}5 {word()}"
        texts[400 + i] = f"{word()} from {i}1@x to {word()}"
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.spans for r in pii.op3_personal_data(spark, str(tmp_path)).collect()}
    right = sum(found[n] == f"email:{a}:{b}" for n, (a, b) in planted.items())
    assert right == len(planted) and all(found[n] == "" for n in texts if n >= 300)


def test_instances_with_most_support_count(spark):
    rows = [(f"cue{c}", f"seed{k}", 0) for c in range(20) for k in range(100)] + [(f"cue{c}", f"token{k}", None) for c in range(20) for k in range(10)]
    rows += [("other", f"seed{k}", 0) for k in range(4)] + [("other", f"token{k}", None) for k in range(10)]
    assert 1 - (1 - 100 / 111) ** 20 == 1.0
    found = {(r.cue, r.kind) for r in pii.bootstrap(spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "cue string, token string, seed int, mention long")).collect()}
    assert found == {(f"cue{c}", 0) for c in range(20)} | {("other", 0)}


def test_personal_data_edges(spark):
    out = pii.personal_data_stage(spark, docs_of(spark, EDGES), "")
    assert out.columns == DOCS.replace(",", "").split()[::2] and out.count() == len(EDGES)
    assert pii.personal_data_stage(spark, docs_of(spark, []), "").count() == 0


# substrings


def removed_words(texts, window=50):
    seen, out = {}, {}
    for i, t in sorted((i, t) for i, t in texts if i is not None):
        w = WORD.findall(t or "")
        spans = [tuple(w[k : k + window]) for k in range(len(w) - window + 1)]
        gone = set()
        for k, s in enumerate(spans):
            if seen.get(s, i) < i:
                gone.update(range(k, k + window))
        for s in spans:
            seen.setdefault(s, i)
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_substrings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{k}" for k in range(2000)]
    shared_ = [list(rng.choice(vocab, size=n)) for n in (49, 50, 51, 120, 400)]
    texts = {}
    for i in range(60):
        parts = [list(rng.choice(vocab, size=rng.integers(0, 200)))]
        for _ in range(rng.integers(0, 3)):
            parts += [shared_[rng.integers(0, 5)], list(rng.choice(vocab, size=rng.integers(0, 30)))]
        texts[i] = " ".join(str(x) for p in parts for x in p)
    texts |= {70: texts[3], 71: texts[3] + " x", 72: "a " * 200, 73: "a " * 300, 74: None, 75: "", 76: "b\t" * 49}
    want = removed_words(texts.items())
    df = docs_of(spark, texts)
    for batches in (1, 4):
        kept = {r.doc_id: r.text for r in substrings.dedup(df, batches=batches).collect()}
        assert {i: WORD.findall(t or "") for i, t in kept.items()} == want
    found = substrings.digests(df, substrings.covered(df)).collect()
    for r in found:
        assert r.kept_sha256 == hashlib.sha256(" ".join(want[r.doc_id]).encode()).hexdigest()
        assert (r.n_words, r.n_removed) == (n := len(WORD.findall(texts[r.doc_id] or "")), n - len(want[r.doc_id]))


def test_substring_edges_and_log(spark):
    out = substrings.dedup(docs_of(spark, EDGES))
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter((d, "" if d == 5 else t) for d, t in EDGES)
    assert substrings.dedup(docs_of(spark, [])).count() == 0


def test_log_of_runs(spark, tmp_path):
    path, hits = str(tmp_path / "log"), []
    for k in range(5):  # opened anew for each batch, as in later sessions
        log = substrings.FingerprintIndex(spark, path, buckets=3, fan=2)
        batch = spark.createDataFrame([(h, 10 * k + h % 3) for h in range(k, k + 3)], "h long, tkey long")
        if k == 1:  # history is read by its buckets: only the batch is dealt out
            run, past = log.run(log._write(batch.groupBy("h").agg(F.min("tkey").alias("lo"), F.max("tkey").alias("hi")))), log.run(log.runs[0])
            plan = run.join(past.hint("merge"), "h")._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        hits.append({r.h for r in log.append(batch).collect()})
        assert len(log.runs) <= 2
        log.close()
    assert hits == [set(), {1, 2}, {2, 3}, {3, 4}, {4, 5}]
    log = substrings.FingerprintIndex(spark, path)
    assert log.buckets == 3 and {r.h for n in log.runs for r in log.run(n).collect()} == set(range(7))
    log.close(delete=True)
    assert not os.path.exists(path)


def test_texts_with_one_key_in_common_stay_apart(spark):
    """The first hash of a text does not decide alone."""
    texts = {1: " ".join(f"a{k}" for k in range(60)), 2: " ".join(f"b{k}" for k in range(60)), 3: " ".join(f"a{k}" for k in range(60))}
    marks = substrings.fingerprints(docs_of(spark, texts)).withColumn("tkey", F.lit(5).cast("long"))
    found = substrings.verify(docs_of(spark, texts).limit(0), marks, spark.createDataFrame([], "h long")).collect()
    assert [(r.doc_id, r.starts) for r in found] == [(3, None)]


@given(st.integers(0, 120), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_equal_windows_have_equal_anchors(n, seed):
    rng = np.random.default_rng(seed)
    passage = rng.integers(0, 2**63, 50, dtype=np.uint64)
    found = []
    for _ in range(2):
        before, after = rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64)
        at, _ = substrings.anchors(np.concatenate((before, passage, after)))
        found.append({a - n for a in at.tolist() if n <= a <= n + 25})
    assert found[0] & found[1]


# Jaccard


def brute_components(texts):
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    keys = sorted(sets)
    for k, a in enumerate(keys):
        for b in keys[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 300)  # many parts and shares
    rng = np.random.default_rng(3)
    vocab, texts, i = [f"w{k}" for k in range(500)], {}, 0
    passage = list(rng.choice(vocab, size=30))
    for _ in range(14):
        base = list(rng.choice(vocab, size=rng.integers(20, 90))) + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.integers(1, 9)):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, len(copy))] = f"n{rng.integers(0, 50)}"
            texts[i], i = " ".join(map(str, copy)), i + 1
    texts |= {i: "A b c D", i + 1: "a B c d", i + 2: "a b c", i + 3: None, i + 4: "", i + 5: texts[0], i + 6: "a b c d e", i + 7: "a b c d e f"}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs_of(spark, texts)).collect()}
    want = brute_components(texts)
    assert found == want and len({c for _, c in want.values()}) < len(want) - 10
    kept = jaccard.near_duplicate_stage(spark, docs_of(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c) and kept.columns == docs_of(spark, {}).columns


def test_join_edges(spark):
    found = Counter((r.doc_id, r.component_id) for r in jaccard.join(docs_of(spark, EDGES)).collect())
    assert found == Counter([(0, 0), (1, 1), (2, 2), (3, 3), (3, 3), (None, None), (4, 4), (5, 2), (7, 7)])
    assert jaccard.join(docs_of(spark, [])).count() == 0


def test_stage_takes_repeated_ids_by_their_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (1, a), (2, a + " more"), (2, b), (3, b), (None, a), (None, None), (2, None)]
    kept = jaccard.near_duplicate_stage(spark, docs_of(spark, rows), "").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, a), (1, a), (2, b), (None, a), (None, None), (2, None)])


def test_shared_bound_is_the_least_of_all_sizes(spark):
    def bound(n, m):
        return -(-4 * (n + m) // 9) - max(-(-4 * n // 5), -(-4 * m // 5)) + 1

    rows = [(n, low, high) for n in range(1, 61) for low in range(-(-4 * n // 5), 5 * n // 4 + 1) for high in range(low, 5 * n // 4 + 1)]
    rows.append((100, 100, 105))
    found = spark.createDataFrame(rows, "n long, low long, high long").select("*", jaccard.least_shared(F.col("n"), F.col("low"), F.col("high")).alias("least")).collect()
    assert len(found) == len(rows) and all(r.least == min(bound(r.n, m) for m in range(r.low, r.high + 1)) for r in found)


def late_link():
    """Four texts of 100, 104, 105 and 100 shingles: the first links with the second only, by the fewest prefix n-grams there can be."""
    low = lambda words: jaccard.shingles(" ".join(words[-5:]))[0]
    for seed in range(200):
        rng = np.random.default_rng(seed)
        middle = [f"m{k}" for k in rng.integers(0, 10**9, 95)]
        ninth = jaccard.shingles(" ".join(middle))[8]
        y = list(middle)
        for _ in range(14):  # n-grams that x has not come first in the order
            y.append(next(w for k in range(10**6) if low([*y, w := f"b{k}"]) < ninth))
        texts = [" ".join(t) for t in ([*(f"x{k}" for k in range(9)), *middle], y[:-1], y, y[4:-1])]
        sets = [jaccard.shingles(t) for t in texts]
        keys = [jaccard.set_keys(s)[0] for s in sets]
        prefix = [set(s[: jaccard.prefix_length(len(s))].tolist()) for s in sets]
        if min(keys) in keys[2:] and len(prefix[0] & (prefix[1] | prefix[2] | prefix[3])) == 8 and prefix[0] & prefix[3]:
            assert [len(s) for s in sets] == [100, 104, 105, 100]
            return dict(enumerate(texts))


def test_join_finds_a_link_inside_a_range_of_sizes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "frequent", lambda docs: np.zeros(jaccard.SLOTS, np.uint8))  # the order is that of the hashes
    texts = late_link()
    want = brute_components(texts)
    assert [c for _, c in want.values()] == [0, 0, 0, 0] and len({c for _, c in brute_components({i: t for i, t in texts.items() if i != 1}).values()}) == 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs_of(spark, texts)).collect()} == want


@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=20), min_size=1, max_size=25), st.sets(st.integers(0, 30), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_trie_finds_all_links(stored, probe):
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in stored]
    want = [i for i, s in enumerate(stored) if 100 * len(s & probe) >= 80 * len(s | probe)]
    probes = [np.array(sorted(p), dtype=np.uint64) for p in (probe, stored[0])]
    for levels in (np.zeros(jaccard.SLOTS, np.uint8), (np.arange(jaccard.SLOTS) % 7).astype(np.uint8)):
        found = jaccard.Trie(arrays, levels).links(probes)
        assert sorted(i for p, i in found if p == 0) == want and (1, 0) in found
        labels = [i % 3 for i in range(len(stored))]
        one = jaccard.Trie(arrays, levels, labels).links(probes, [5, 5])
        assert sorted(labels[i] for p, i in one if p == 0) == sorted({labels[i] for i in want})


#: Four texts of which the first and second share 12 of 15 shingles, by the fewest prefix n-grams that there can be.
FOUR = """cpgemlh ppdaejj kjaolle baiodga nnpmpmg jocjanj pjefppk enbchic cakncmp bddhdej oeffnfc gbdmcib dmeanck ppllbej ejhichi jehlomf eakcbcd
ohmopkd ambenhd ppdaejj kjaolle baiodga nnpmpmg jocjanj pjefppk enbchic cakncmp bddhdej oeffnfc gbdmcib dmeanck ppllbej ejhichi jehlomf eakcbcd
ohmopkd ambenhd ppdaejj kjaolle baiodga nnpmpmg jocjanj pjefppk enbchic cakncmp bddhdej oeffnfc gbdmcib dmeanck ppllbej ejhichi
ohmopkd ambenhd ppdaejj kjaolle baiodga nnpmpmg jocjanj pjefppk enbchic cakncmp bddhdej oeffnfc gbdmcib dmeanck ppllbej ejhichi jklmmel jnlbgfm"""


def families(seed):
    """Texts in families that share runs of words, with edits at their ends and in the middle; sizes vary within a family."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    texts = {}
    for _ in range(12):
        base = [word() for _ in range(rng.integers(6, 60))]
        for _ in range(rng.integers(1, 8)):
            own = [word() for _ in range(rng.integers(0, 4))] + base[rng.integers(0, 3) : len(base) - rng.integers(0, 3)] + [word() for _ in range(rng.integers(0, 4))]
            if rng.random() < 0.3:
                own[rng.integers(0, len(own))] = word()
            texts[len(texts)] = " ".join(own)
    return texts


def test_no_link_is_lost(spark):
    four = dict(enumerate(FOUR.split("\n"), 1))
    rows = spark.sparkContext.parallelize([(i, t, None, None, 0.5, "x") for i, t in four.items()], 4)
    assert {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, DOCS)).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    texts = {}
    for seed in range(50):  # families of different seeds have no shingle in common
        texts |= {1000 * seed + i: " ".join(f"{w}s{seed}" for w in t.split()) for i, t in families(seed).items()}
    want = {}
    for seed in range(50):
        want |= brute_components({i: t for i, t in texts.items() if i // 1000 == seed})
    rows = [(i, t, None, None, 0.5, "x") for i, t in texts.items()]
    for slices in (4, 16):
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, slices), DOCS)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()} == want


def test_batched_shingles_equal_single_ones():
    texts = ["A b c D e f", None, "", " \t", "x", "a b c d e f", "one two three", "é漢 字 A a A a A a", "w " * 300, "last words of all texts here"]
    own, cuts = jaccard.shingle_sets(pa.array(texts, pa.string()).slice(1))
    for i, t in enumerate(texts[1:]):
        low = (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        assert own[cuts[i] : cuts[i + 1]].tolist() == jaccard.shingles(t).tolist() and cuts[i + 1] - cuts[i] == brute_components({0: low})[0][0]
    assert jaccard.shingles(texts[0]).tolist() == jaccard.shingles(texts[5]).tolist()


def test_sets_with_one_hash_in_common_stay_apart(spark):
    rows = [(1, 0, 3, 7, 1, [1]), (2, 0, 3, 7, 2, [2]), (3, 0, 3, 8, 1, [3]), (4, 0, 3, 7, 1, [])]
    marks, nodes = jaccard.nodes_of(spark.createDataFrame(rows, "doc_id long, tkey long, n long, skey long, check long, prefix array<long>"))
    keys = {r.doc_id: r.skey for r in marks.collect()}
    assert keys[1] == keys[4] != keys[2] and keys[3] == 8 and sorted(r.doc_id for r in nodes.collect()) == [1, 2, 3]


# chat


def test_events_fold():
    log = [
        (1, 0, "start", "user", "a"), (1, 0, "delta", None, "b"), (1, 1, "start", "assistant", "x"), (1, 1, "regenerate", None, "y"), (1, 1, "delta", None, "z"),
        (1, 2, "delta", None, "late"), (1, 3, "start", "user", "gone"), (1, 3, "delete", None, None), (2, 0, "start", "user", None), (2, 0, "edit", None, "new"), (2, 0, "delta", None, "!"),
    ]
    assert list(chat.fold(log)) == [(1, 0, "user", "ab"), (1, 1, "assistant", "yz"), (1, 2, "", "late"), (2, 0, "user", "new!")]
    with pytest.raises(ValueError):
        list(chat.fold([(1, 0, "what", "user", "a")]))


@given(st.text(alphabet=st.sampled_from("<>|/s[]INST\\lbp\n a"), max_size=40), st.text(alphabet="us|<\\>\np", max_size=6))
@settings(max_examples=300, deadline=None)
def test_rendering_is_reversible(text, role):
    shown = chat.render(role, text)
    assert chat.parse(shown) == (role, text)
    inside = chat.escape(text)
    assert not any(c in inside for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|"))


def test_op6(spark, tmp_path):
    """Against a plain rendering of whole conversations."""
    rng = np.random.default_rng(8)
    words = ["</s>", "[INST]", "\\l", "<|end|>\n", "é😀", "plain", " ", "\n", "<s", "s>", "|", "[", ""]
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(words, size=rng.integers(0, 9)))
    rows = [(c, t, str(rng.choice(["user", "assistant", "system", "a|b", ""])), text()) for c in range(40) for t in range(rng.integers(1, 7))]
    rows += [(50, 1, "assistant", "</s> \\l"), (50, 0, "user", None), (51, 0, None, "x"), (51, 0, None, "x"), (None, None, "user", "n"), (50, 2, "assistant", "é😀"), (52, 0, "assistant", "y" * 100_000)]
    rng.shuffle(rows)
    rows = [(None if c is None else int(c), None if t is None else int(t), r, x, 1) for c, t, r, x in rows]
    kind = "conv_id long, turn long, role string, text string, seq int"
    os.makedirs(tmp_path / "c")
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "c" / "conversations.parquet"))
    found = {r.conv_id: tuple(r)[1:] for r in chat.op6_chat_formatting(spark, str(tmp_path / "c")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    talks = defaultdict(list)
    for c, t, r, x, _ in [*rows, *((-7, t, r, "</s>[INST] ok [/INST]", 1) for t, r in enumerate(("user", "assistant")))]:
        talks[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(found) == set(talks)
    for c, turns in talks.items():
        turns.sort(key=lambda m: m[0])
        whole = "<s>" + "".join(chat.render(r, x) for _, r, x in turns) + "</s>"
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert found[c] == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), len(whole)), c
    os.makedirs(tmp_path / "e")
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "e" / "conversations.parquet"))
    assert [r.conv_id for r in chat.op6_chat_formatting(spark, str(tmp_path / "e")).collect()] == [-7]


def test_formatted_parts_join_to_the_whole(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "a\\b"), (2, 0, "assistant", None)]
    log = chat.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.collect()} == {"start", "delta", "edit"}
    parts = sorted(chat.format_log(log).collect())
    assert "".join(r.segment for r in parts if r.conv_id == 1) == "<s><|user|>\nhi \\l/s><|end|>\n<|assistant|>\na\\\\b<|end|>\n</s>"
    whole = "".join(r.segment for r in parts if r.conv_id == 1)
    assert [whole[r.loss_start : r.loss_end] for r in parts if r.conv_id == 1 and r.loss_start is not None] == ["a\\\\b"]
    broken = [(1, 0, parts[0].segment[3:], None, None)], [(1, 0, parts[0].segment, None, None)]
    for rows in broken:
        with pytest.raises(Exception, match="mark"):
            chat.digests(spark.createDataFrame(rows, chat.FORMATTED)).collect()


# sentencepiece

vit = pieces.Viterbi(SPM, keep=20)


def best_score(text):
    score = {vit.text[i]: vit.sp.get_score(i) for i in range(vit.sp.get_piece_size()) if not (vit.sp.is_control(i) or vit.sp.is_unknown(i) or vit.sp.is_byte(i) or vit.sp.is_unused(i))}
    best = [0.0] + [-1e300] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 20), e):
            if text[s:e] in score:
                best[e] = max(best[e], best[s] + score[text[s:e]])
        if text[e - 1] not in score:
            best[e] = max(best[e], best[e - 1] + vit.unknown_score)
    return best[-1], score


def test_viterbi_is_optimal_and_reversible():
    words = ["hello", "wörld", "  two", "漢字仮名", "😀x", "a\nb", "unbelievable", "x" * 30, " ", "ñandú,"]
    rng = np.random.default_rng(4)
    for _ in range(25):
        text = " ".join(str(w) for w in rng.choice(words, size=rng.integers(1, 6)))
        ids = vit.encode(text)
        assert vit.decode(ids) == text
        normal = vit.sp.normalize(text)
        want, score = best_score(normal)
        got = sum(score.get(vit.text[i], 0.0) for i in np.frombuffer(ids, "<u4").tolist() if i not in vit.value)
        unknown = sum(1 for c in normal if c not in score)
        assert abs(got + unknown * vit.unknown_score - want) < 1e-3
        assert ids == tokens.pack(vit.path(normal))  # by word or whole: the same


bpe = pieces.Bpe(SPM, keep=20, pairs=50)


@given(st.text(st.one_of(st.sampled_from("aeinrst  \u2581"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=400, deadline=None)
def test_bpe_equals_the_library(text):
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == bpe.sp.encode(text)


def test_registered_ids_equal_the_library(spark, tmp_path):
    texts = ["the river", "internationalization", " two  spaces    and\ttabs ", "wörld 漢字仮名 😀x", "x" * 300, "unbelievable" * 30, "a\u2581b\x00<0x0A></s>", " " * 40, "", None]
    docs_of(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in pieces.op7_sentencepiece(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want = bpe.sp.encode(t or "")
        assert (found[i].n_pieces, found[i].ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))


def test_pieces_solve_parts_between_line_ends_once():
    v, solved = pieces.Bpe(SPM), []
    path = v.path
    v.path = lambda text: solved.append(text) or path(text)
    text = " ".join(f"{a}.\n{b}" for a in ("one", "two", "three", "four", "five") for b in ("red", "green", "blue", "grey"))
    assert np.frombuffer(v.encode(text), "<u4").tolist() == v.sp.encode(text)
    assert len(solved) <= 5 + 4 + 1  # not each of the 20 pairs
    assert v.decode(v.encode(text)) == text


def test_pieces_stay_apart_as_merging_has_it():
    r = random.Random(5)
    texts = [t for t in bpe.scores if len(t) < 8]
    seen = set()
    for _ in range(4000):
        whole = r.choice(texts) + r.choice(texts)
        at = r.randrange(1, len(whole))
        left, right = whole[:at], whole[at:]
        if left in bpe.scores and right in bpe.scores and bpe.merge(left) == [left] and (len(right) == 1 or bpe._last_merge(right)):
            if (got := bpe._apart(left, right)) is not None:
                assert got == (bpe.merge(whole) == [left, right]), (left, right)
                seen.add(got)
    assert seen == {True, False}


def test_pieces_edges(spark):
    found = pieces.decode(pieces.encode(docs_of(spark, EDGES), SPM), SPM).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((d, t or "") for d, t in EDGES)


# quality


def test_quality_learns_from_positives(spark, tmp_path):
    rng = np.random.default_rng(6)
    vocab = ["the", "river", "ran", "slowly", "past", "old", "stone", "houses", "and", "gardens"]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(vocab, size=80))
        bad = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."))
        if i % 5 < 2:
            labels.append((i, int(not bad)))
    rows += [(1000, None), (1001, ""), (None, "the river ran."), (3, "the river again")]
    os.makedirs(tmp_path / "q")
    docs_of(spark, rows).write.parquet(str(tmp_path / "q" / "documents.parquet"))
    spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "q" / "labels.parquet"))
    found = quality.op9_quality_classifier(spark, str(tmp_path / "q")).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    right = [r.predicted == int(r.doc_id % 4 != 0) for r in found if r.held_out and r.doc_id < 600 and r.doc_id != 3]
    assert sum(right) / len(right) > 0.97
    stage = quality.quality_stage(spark, spark.read.parquet(str(tmp_path / "q" / "documents.parquet")), str(tmp_path / "q"))
    assert stage.columns == docs_of(spark, []).columns and 400 < stage.count() < 480


def test_quality_learns_where_all_are_labelled(spark, tmp_path):
    rng = np.random.default_rng(7)
    vocab = ["the", "river", "ran", "slowly", "past", "old", "stone", "houses", "and", "gardens"]
    rows = [(i, " ".join(w.upper() + "!!" for w in words) if i % 3 else " ".join(words) + ".") for i, words in ((i, list(rng.choice(vocab, size=80))) for i in range(300))]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    found = quality.op9_quality_classifier(spark, str(tmp_path)).collect()
    right = [r.predicted == int(r.doc_id % 3 == 0) for r in found if r.held_out]
    assert len({r.score for r in found}) > 1 and sum(right) / len(right) > 0.97
    kept = [r.doc_id for r in quality.quality_stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()]
    assert 90 <= len(kept) <= 110 and sum(i % 3 == 0 for i in kept) > 90


@needs_data
def test_quality_on_held_out_labels(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    rows = quality.op9_quality_classifier(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


# pipeline and shared parts


@needs_data
def test_pipeline(spark, real):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "personal data", "best-fit packing"]
    docs = real
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, DATA), "stage")
        assert docs.columns == real.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    whole = {r.doc_id: r.text for r in real.collect()}
    assert all("@mail" not in (t or "") for t in texts.values())
    kept = {i: whole[i] for i in texts}
    assert all(i == c for i, (_, c) in brute_components(kept).items())
    assert removed_words(texts.items()) == {i: WORD.findall(t or "") for i, t in texts.items()}
    packed = corpus_pipeline.run(spark, DATA).collect()
    want = {(i, zlib.crc32((plain(t) + struct.pack("<I", 1))[:16384])) for i, t in texts.items()}
    assert {(r.doc_id, r.ids_crc32) for r in packed if r.piece == 0} == want


def test_filter_loses_nothing(spark, monkeypatch):
    big, small = spark.range(2000).withColumnRenamed("id", "k"), spark.range(0, 4000, 7).withColumnRenamed("id", "k")
    for most in (64, 1 << 14):
        monkeypatch.setattr(shared, "FILTER_LEAST", 64)
        monkeypatch.setattr(shared, "FILTER_MOST", most)
        clear, near = shared.split_by_filter(big, ["k"], small)
        assert clear.count() + near.count() == 2000 and clear.join(small, "k").count() == 0
        assert near.join(small, "k").count() == 286
