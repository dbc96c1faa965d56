"""Names and paths as native expressions: languages, qualified names, and the ways to shorten them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and their languages, case-sensitive.
LANGUAGES = {
    "rs": "rust",
    "py": "python", "pyi": "python",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "tsx": "tsx",
    "go": "go",
    "java": "java",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "c++": "cpp", "h": "cpp", "hpp": "cpp", "hxx": "cpp", "h++": "cpp",
    "cs": "csharp",
    "php": "php", "phtml": "php",
    "scala": "scala", "sc": "scala",
    "lua": "lua",
}
#: What separates the parts of a qualified name.
SEPARATORS = {
    "rust": "::", "cpp": "::", "python": ".", "java": ".", "csharp": ".", "scala": ".", "lua": ".",
    "javascript": "/", "typescript": "/", "tsx": "/", "go": "/", "php": "\\",
}
#: Last path parts that a prefix drops.
DROPPED = {"rust": ("mod", "lib", "main"), "python": ("__init__",), "javascript": ("index",), "typescript": ("index",), "tsx": ("index",)}
#: Families of the name resolver.
FAMILY_A = ("python", "typescript", "javascript", "tsx", "php", "lua")
FAMILY_B = ("rust", "go", "scala", "java", "csharp", "cpp")
ROUTE_LANGUAGES = ("python", "go", "javascript", "typescript", "tsx")
#: Texts that show a web framework.
FRAMEWORKS = {
    "fastapi": (("python",), ("from fastapi import", "import fastapi")),
    "gin": (("go",), ("gin.New(", "*gin.Engine", "gin.Default()", '"github.com/gin-gonic/gin"')),
    "express": (("javascript", "typescript", "tsx"), ("require('express')", 'require("express")', "from 'express'", 'from "express"')),
}


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often `use` reads it; what is inside stays out of generated code."""
    return F.transform(F.array(value), use)[0]


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A small fixed table as one map, so that the key is worked out once; a miss is null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def extension(path: Column) -> Column:
    """What follows the last dot of the last path part; empty if nothing does, or only a leading dot."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def language(path: Column) -> Column:
    return _lookup(LANGUAGES, extension(path))


def separator(lang: Column) -> Column:
    return _lookup(SEPARATORS, lang)


def family(lang: Column) -> Column:
    return _lookup({x: "A" for x in FAMILY_A} | {x: "B" for x in FAMILY_B}, lang)


def last_segment(fqn: Column) -> Column:
    """After the last of `: . / \\`."""
    return F.regexp_extract(fqn, r"([^:./\\]*)$", 1)


def fqn_tail(fqn: Column) -> Column:
    """After the last `::`, else after the last `.`, else the whole."""
    return F.when(F.contains(fqn, F.lit("::")), F.substring_index(fqn, "::", -1)).otherwise(F.substring_index(fqn, ".", -1))


def short_name(fqn: Column) -> Column:
    """After the last `::` only."""
    return F.substring_index(fqn, "::", -1)


def strip_quotes(text: Column) -> Column:
    """Trim, then drop one matching pair of quotes."""
    return F.regexp_replace(F.trim(text), "(?s)^(['\"`])(.*)\\1$", "$2")


def prefix(path: Column, lang: Column) -> Column:
    """Qualified-name prefix of a file, by its language; null without a language."""
    head = lambda parts, n: F.slice(parts, F.lit(1), F.greatest(F.size(parts) - n, F.lit(0)))
    droppable = F.create_map(*(x for k, words in DROPPED.items() for x in (F.lit(k), F.array(*map(F.lit, words)))))

    def rooted(parts: Column) -> Column:
        """Without what is up to the first source root that has a part after it."""
        root = lambda i: (F.slice(parts, i, F.lit(3)) == F.array(F.lit("src"), F.lit("main"), F.lit("java"))) & (i + 3 <= F.size(parts))
        first = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), root), F.lit(0))
        return let(first, lambda at: F.when(at.isNotNull(), F.slice(parts, at + 3, F.size(parts))).otherwise(parts))

    def chosen(parts: Column) -> Column:
        drop = F.coalesce(F.array_contains(F.try_element_at(droppable, lang), F.try_element_at(parts, F.lit(-1))), F.lit(False))
        return F.when(lang == "go", head(parts, 1)).when(lang.isin("java", "scala"), rooted(parts)).when(drop, head(parts, 1)).otherwise(parts)

    stem = F.regexp_replace(path, r"([^/])\.[^./]*$", "$1")
    parts = F.filter(F.split(stem, "/"), lambda p: ~p.isin("", "."))
    return let(parts, lambda p: F.call_function("array_join", chosen(p), separator(lang)))


def qualified(path: Column, lang: Column, name: Column) -> Column:
    """Prefix, separator and bare name; an empty prefix leaves the name."""
    return let(prefix(path, lang), lambda p: F.when(p == "", name).otherwise(F.concat(p, separator(lang), name)))


def framework(lang: Column, text: Column) -> Column:
    """The web framework that a source text shows, if its language can have one."""
    out = None
    for name, (langs, signs) in FRAMEWORKS.items():
        seen = F.lit(False)
        for s in signs:
            seen = seen | F.contains(text, F.lit(s))
        test = lang.isin(*langs) & seen
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


# symbols of external reference indexes


def normalize_symbol(symbol: Column) -> Column:
    """Keep local symbols; of others the descriptor, under a neutral scheme."""
    return F.when(F.startswith(symbol, F.lit("local ")), symbol).otherwise(F.concat(F.lit(". . . . "), F.coalesce(F.try_element_at(F.split(symbol, " ", 5), F.lit(5)), F.lit(""))))


def symbol_key(symbol: Column) -> Column:
    """Name by which a symbol's definition is looked up; null for local ones."""
    descriptor = F.try_element_at(F.split(symbol, " ", 5), F.lit(5))
    bare = F.regexp_replace(F.substring_index(descriptor, "/", -1), r"[#.():]+$", "")
    key = F.regexp_replace(bare, "^`+|`+$", "")
    return F.when(F.startswith(symbol, F.lit("local ")), F.lit(None)).otherwise(F.nullif(key, F.lit("")))


def symbol_tail(symbol: Column) -> Column:
    """Last name in a symbol; empty for local ones."""
    descriptor = F.coalesce(F.try_element_at(F.split(symbol, " ", 5), F.lit(5)), F.lit(""))
    bare = F.regexp_replace(descriptor, r"[#./():]+$", "")
    tail = F.regexp_replace(F.regexp_extract(bare, r"([^#./:()]*)$", 1), "^`+|`+$", "")
    return F.when(F.startswith(symbol, F.lit("local ")), F.lit("")).otherwise(tail)
