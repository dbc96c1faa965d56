"""External reference indexes in their protobuf form, decoded without a protobuf library.

Only the fields that the engine uses are read; unknown ones are skipped by
wire type, as the encoding allows.
"""

from __future__ import annotations

import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

OCCURRENCES = "document string, ordinal int, symbol string, symbol_roles int, range array<int>, enclosing_range array<int>"

#: Field numbers of the index format.
DOCUMENTS, PATH, OCCURRENCE, RANGE, SYMBOL, ROLES, ENCLOSING = 2, 1, 2, 1, 2, 3, 7
#: Languages and the programs that index them.
INDEXERS = (
    ("rust", "rust-analyzer"), ("python", "scip-python"), ("typescript", "scip-typescript"), ("javascript", "scip-typescript"),
    ("tsx", "scip-typescript"), ("go", "scip-go"), ("java", "scip-java"), ("scala", "scip-java"),
)


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("varint too long")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message; lengths give bytes, the rest integers."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        elif wire == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise ValueError("cut off")
        else:
            raise ValueError(f"wire type {wire}")
        yield number, value


def integers(values: list[int | bytes]) -> list[int]:
    """A repeated integer field, packed or not."""
    out: list[int] = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
            continue
        at = 0
        while at < len(v):
            x, at = varint(v, at)
            out.append(x)
    return out


def occurrences(data: bytes) -> Iterator[tuple]:
    """(document, ordinal, symbol, roles, range, enclosing range) of an index."""
    for number, doc in fields(data):
        if number != DOCUMENTS:
            continue
        path, found = "", []
        for n, value in fields(doc):
            if n == PATH:
                path = value.decode()
            elif n == OCCURRENCE:
                found.append(value)
        for ordinal, raw in enumerate(found):
            parts: dict[int, list] = {}
            for n, value in fields(raw):
                parts.setdefault(n, []).append(value)
            symbol = parts.get(SYMBOL, [b""])[-1].decode()
            yield path, ordinal, symbol, parts.get(ROLES, [0])[-1], integers(parts.get(RANGE, [])), integers(parts.get(ENCLOSING, []))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Occurrences of one or more index files; each file is decoded in one task."""

    def run(frames):
        for pdf in frames:
            for content in pdf["content"]:
                rows = list(occurrences(bytes(content)))
                yield pd.DataFrame(rows, columns=["document", "ordinal", "symbol", "symbol_roles", "range", "enclosing_range"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, OCCURRENCES)


def detect(spark: SparkSession) -> DataFrame:
    """Which indexers are on the driver's path."""
    rows = [(lang, program, shutil.which(program)) for lang, program in INDEXERS]
    return spark.createDataFrame(rows, "language string, program string, path string")
