"""Source trees as frames.

Spark's file sources skip names that begin with `_` or `.`, which would lose
every `__init__.py`, so the walk is the driver's, paths are a frame, and
executors read the files. For trees in a store that only Spark reaches,
`from_frame` takes contents that are already in a frame.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import LANGUAGES, language
from .extract import extract

SOURCES = "path string, lang string, content binary, mtime_ns long, error string"


def _ignored(rules: list[tuple[str, str, bool, bool]], rel: str, is_dir: bool) -> bool:
    """Whether the last matching ignore rule excludes a path; rules are (base, pattern, negated, directories only)."""
    out = False
    for base, pattern, negated, only_dir in rules:
        if only_dir and not is_dir or base and not rel.startswith(base + "/"):
            continue
        own = rel[len(base) + 1 :] if base else rel
        anchored = "/" in pattern.rstrip("/")
        target = own if anchored else os.path.basename(own)
        regex = fnmatch.translate(pattern.lstrip("/")).replace("(?s:", "(?s:", 1)
        if anchored:
            regex = re.sub(r"(?<!\\)\.\*", "[^/]*", regex) if "**" not in pattern else regex
        if re.match(regex, target):
            out = not negated
    return out


def walk(root: str) -> Iterator[tuple[str, str, int]]:
    """(relative path, language, mtime) of the source files below a root: no hidden files, nothing that ignore files exclude."""

    def rules_of(folder: str, base: str) -> list[tuple[str, str, bool, bool]]:
        out = []
        for name in (".ignore", ".gitignore"):
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    lines = f.read().splitlines()
            except OSError:
                continue
            for line in lines:
                line = line.rstrip()
                if line and not line.startswith("#"):
                    negated = line.startswith("!")
                    body = line[negated:]
                    out.append((base, body.rstrip("/"), negated, body.endswith("/")))
        return out

    def down(folder: str, base: str, rules: list) -> Iterator[tuple[str, str, int]]:
        rules = [*rules, *rules_of(folder, base)]
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            rel = f"{base}/{entry.name}" if base else entry.name
            if entry.name.startswith(".") or entry.is_symlink() or _ignored(rules, rel, entry.is_dir()):
                continue
            if entry.is_dir():
                yield from down(entry.path, rel, rules)
            elif (lang := LANGUAGES.get(os.path.splitext(entry.name)[1][1:])) and entry.is_file():
                yield rel, lang, entry.stat().st_mtime_ns

    yield from down(root, "", [])


def read(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """The source files of a tree with their contents; unreadable ones have an error and no content."""
    listed = list(walk(root))
    paths = spark.createDataFrame(pd.DataFrame(listed, columns=["path", "lang", "mtime_ns"]), "path string, lang string, mtime_ns long") if listed else spark.createDataFrame([], "path string, lang string, mtime_ns long")
    paths = paths.repartition(partitions or max(1, min(len(listed) // 250 + 1, 4 * spark.sparkContext.defaultParallelism)), "path")

    def load(batches):
        for batch in batches:
            rows = []
            for path, lang, mtime in zip(*(batch[c].to_pylist() for c in ("path", "lang", "mtime_ns")), strict=True):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        rows.append((path, lang, f.read(), mtime, None))
                except OSError as e:
                    rows.append((path, lang, None, mtime, str(e)))
                if len(rows) == 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows):
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "lang", "content", "mtime_ns", "error"])

    return paths.mapInArrow(load, SOURCES)


def from_frame(files: DataFrame) -> DataFrame:
    """Sources from (path, content), with optional mtime_ns.

    They are dealt out over all cores: a table of millions of files may be one small Parquet file, which is one task.
    """
    spark = files.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mtime = F.col("mtime_ns") if "mtime_ns" in files.columns else F.lit(0)
    own = files.select("path", F.col("content").cast("binary").alias("content"), mtime.cast("long").alias("mtime_ns")).where(language(F.col("path")).isNotNull()).repartition(n, "path")
    return own.select("path", language(F.col("path")).alias("lang"), "content", "mtime_ns", F.lit(None).cast("string").alias("error"))


def file_records(sources: DataFrame) -> DataFrame:
    """One record a file: content hash for change detection. Files that cannot be parsed have one too."""
    return sources.where("content is not null").select("path", F.unhex(F.sha2("content", 256)).alias("content_hash"), "mtime_ns", "lang")


#: Fields of the kinds of facts.
FIELDS = {
    "defs": (("kind", "string"), ("name", "string"), ("byte_start", "long"), ("byte_end", "long")),
    "calls": (("name", "string"), ("receiver", "string"), ("byte_start", "long")),
    "imports": (("name", "string"), ("module", "string")),
    "routes": (("method", "string"), ("pattern", "string"), ("handler_name", "string"), ("byte_start", "long"), ("byte_end", "long"), ("handler_line", "long")),
}
FACTS = "file string, lang string, error string, size long, " + ", ".join(f"{k} array<struct<{', '.join(f'{n}: {t}' for n, t in own)}>>" for k, own in FIELDS.items()) + ", content binary"


def parse(sources: DataFrame) -> DataFrame:
    """One row of facts a file, with its content, each file parsed once; facts of repeated contents are remembered within a task."""
    arrow = {"string": pa.string(), "long": pa.int64()}

    def lists(kind: str, rows: list[list[tuple]]) -> pa.ListArray:
        flat = [x for row in rows for x in row]
        columns = list(zip(*flat, strict=True)) or [()] * len(FIELDS[kind])
        struct = pa.StructArray.from_arrays([pa.array(c, arrow[t]) for c, (_, t) in zip(columns, FIELDS[kind], strict=True)], [n for n, _ in FIELDS[kind]])
        offsets = [0]
        for row in rows:
            offsets.append(offsets[-1] + len(row))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)

    def facts(path: str, lang: str, content: bytes | None, error: str | None, known: dict) -> tuple:
        if content is None:
            return error or "unreadable", 0, [], [], [], []
        key = (lang, hashlib.sha256(content).digest())
        if key not in known:
            if len(known) > 1000:
                known.clear()
            f = extract(lang, content)
            known[key] = (f.error, len(content), f.defs, f.calls, f.imports, f.routes)
        return known[key]

    def run(batches):
        known: dict[tuple[str, bytes], tuple] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                columns = (part[c].to_pylist() for c in ("path", "lang", "content", "error"))
                rows = [facts(*row, known) for row in zip(*columns, strict=True)]
                error, size, *kinds = zip(*rows, strict=True)
                made = [part["path"], part["lang"], pa.array(error, pa.string()), pa.array(size, pa.int64()), *(lists(k, list(own)) for k, own in zip(FIELDS, kinds, strict=True)), part["content"]]
                yield pa.RecordBatch.from_arrays(made, ["file", "lang", "error", "size", *FIELDS, "content"])

    return sources.select("path", "lang", "content", "error").mapInArrow(run, FACTS)
