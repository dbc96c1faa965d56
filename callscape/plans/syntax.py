"""Text to syntax tree for the query language: one MATCH pattern, WHERE, RETURN, ORDER BY, SKIP, LIMIT."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from .errors import Clause, ParseError, UnsupportedError

#: Words with a meaning of their own, whatever their case.
KEYWORDS = frozenset(
    "MATCH WHERE RETURN ORDER BY LIMIT SKIP DISTINCT AND OR NOT IS NULL CONTAINS STARTS ENDS WITH AS ASC DESC TRUE FALSE IN "
    "UNWIND MERGE CREATE DELETE SET REMOVE OPTIONAL".split()
)
FORBIDDEN = {w: Clause[w] for w in "UNWIND MERGE CREATE DELETE SET REMOVE OPTIONAL".split()}
#: Keywords that may also be names, and what they are then called.
NAMES = {"MATCH": "match", "WITH": "with", "IN": "in", "ASC": "ASC", "DESC": "DESC"}
STRING_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}

LEXEMES = re.compile(
    r"""
      (?P<skip> [ \t\n\r\f]+ | //[^\n]* | /\*.*?\*/ )
    | (?P<open> /\* )
    | (?P<symbol> -> | <- | -- | <= | >= | != | <> | =~ | [()\[\]{},.:;\-*|<>=] )
    | (?P<string> "(?:\\.|[^"\\])*" | '(?:\\.|[^'\\])*' )
    | (?P<quote> ["'] )
    | (?P<tick> `[^`]*` )
    | (?P<float> [0-9]+ (?: \.[0-9]+ (?:[eE][+-]?[0-9]*)? | [eE][+-]?[0-9]* ) )
    | (?P<int> [0-9]+ )
    | (?P<word> [A-Za-z_$][A-Za-z0-9_$]* )
    """,
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str  # symbol, keyword, name, string, int, float, end
    value: Any
    span: tuple[int, int]


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Ref:
    """A variable, or one of its properties."""

    var: str
    prop: str | None = None

    @property
    def name(self) -> str:
        return self.var if self.prop is None else f"{self.var}.{self.prop}"


@dataclass(frozen=True)
class Op:
    """An operator: AND OR NOT ISNULL = != < > <= >= CONTAINS STARTS ENDS =~."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Node:
    var: str | None
    label: str | None
    props: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Rel:
    var: str | None = None
    types: tuple[str, ...] = ()
    direction: str = "out"  # out, in, any
    props: tuple[tuple[str, Any], ...] = ()


@dataclass
class Query:
    head: Node
    hops: list[tuple[Rel, Node]] = field(default_factory=list)
    where: Any = None
    distinct: bool = False
    returns: list[tuple[Ref, str]] = field(default_factory=list)
    order: list[tuple[Ref, bool]] = field(default_factory=list)
    skip: int | None = None
    limit: int | None = None


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    offset = lambda i: len(text[:i].encode())  # noqa: E731  spans are in bytes
    while at < len(text):
        m = LEXEMES.match(text, at)
        span = (offset(at), offset(m.end() if m else at + 1))
        if not m:
            raise ParseError(f"unexpected character `{text[at]}`", span)
        kind, value, at = m.lastgroup, m[0], m.end()
        if kind == "skip":
            continue
        if kind == "open":
            raise ParseError("unterminated block comment", span)
        if kind == "quote":
            raise ParseError("unterminated string literal", span)
        if kind == "string":
            value = re.sub(r"\\(.)", lambda e: STRING_ESCAPES.get(e[1], e[0]), value[1:-1], flags=re.DOTALL)
        elif kind == "tick":
            kind, value = "name", value[1:-1]
        elif kind == "int":
            value = int(value)
            if value >= 2**63:
                raise ParseError(f"invalid integer literal `{value}`", span)
        elif kind == "float":
            try:
                value = float(value)
            except ValueError:
                raise ParseError(f"invalid float literal `{value}`", span) from None
        elif kind == "word":
            kind, value = ("keyword", value.upper()) if value.upper() in KEYWORDS else ("name", value)
        out.append(Token(kind, value, span))
    if text.count("`") and any(t.value == "`" for t in out):
        raise ParseError("unterminated backtick identifier", (0, 0))
    end = len(text.encode())
    return [*out, Token("end", None, (end, end))]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, wanted: str):
        got = "end of query" if self.now.kind == "end" else repr(self.now.value)
        raise ParseError(f"expected {wanted}, got {got}", self.now.span)

    def sees(self, *values: str) -> bool:
        return self.now.kind in ("symbol", "keyword") and self.now.value in values

    def eat(self, value: str) -> bool:
        if self.sees(value):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.eat(value):
            self.fail(f"`{value}`")

    def name(self) -> str:
        t = self.now
        if t.kind == "name" or t.kind == "keyword" and t.value in NAMES:
            self.at += 1
            return t.value if t.kind == "name" else NAMES[t.value]
        self.fail("identifier")

    def query(self) -> Query:
        for before, t in zip([None, *self.tokens], self.tokens, strict=False):
            if t.kind == "keyword" and t.value in FORBIDDEN:
                raise UnsupportedError(FORBIDDEN[t.value])
            if t.kind == "keyword" and t.value == "WITH" and not (before and before.kind == "keyword" and before.value in ("STARTS", "ENDS")):
                raise UnsupportedError(Clause.WITH)
        if not self.sees("MATCH"):
            raise ParseError("query must start with MATCH", self.now.span)
        patterns = []
        while self.eat("MATCH"):
            patterns.append(self.pattern())
        q = Query(*patterns[0])
        if self.eat("WHERE"):
            q.where = self.either()
        if not self.eat("RETURN"):
            raise ParseError("expected RETURN clause", self.now.span)
        q.distinct = self.eat("DISTINCT")
        q.returns = self.several(self.returned)
        if self.eat("ORDER"):
            self.need("BY")
            q.order = self.several(self.ordered)
        if self.eat("SKIP"):
            q.skip = self.whole()
        if self.eat("LIMIT"):
            q.limit = self.whole()
        self.eat(";")
        if self.now.kind != "end":
            self.fail("end of query")
        if len(patterns) > 1:
            raise UnsupportedError(Clause.MULTIPLE_MATCH)
        return q

    def several(self, item) -> list:
        out = [item()]
        while self.eat(","):
            out.append(item())
        return out

    def whole(self) -> int:
        if self.now.kind != "int":
            self.fail("integer literal")
        self.at += 1
        return self.tokens[self.at - 1].value

    # patterns

    def pattern(self) -> tuple[Node, list[tuple[Rel, Node]]]:
        if self.now.kind == "name" and self.tokens[self.at + 1].value == "=":
            raise UnsupportedError(Clause.PATH_VARIABLE)
        head, hops = self.node(), []
        while self.sees("->", "<-", "--", "-"):
            hops.append((self.rel(), self.node()))
        return head, hops

    def variable(self) -> str | None:
        return self.name() if self.now.kind == "name" else None

    def node(self) -> Node:
        self.need("(")
        var = self.variable()
        label = self.name() if self.eat(":") else None
        props = self.props() if self.sees("{") else ()
        self.need(")")
        return Node(var, label, props)

    def rel(self) -> Rel:
        """Closing dashes are optional after a bracket, so a bare `-` is undirected too."""
        if self.eat("->"):
            return Rel(direction="out")
        if self.eat("--"):
            return Rel(direction="any")
        back = self.eat("<-")
        if back and not self.sees("["):
            return Rel(direction="in")
        if not back:
            self.need("-")
        var, types, props = self.body() if self.eat("[") else (None, (), ())
        if back:
            self.eat("-")
            return Rel(var, types, "in", props)
        direction = "out" if self.eat("->") else "any"
        if direction == "any":
            self.eat("-")
        return Rel(var, types, direction, props)

    def body(self) -> tuple:
        def no_star() -> None:
            if self.sees("*"):
                raise UnsupportedError(Clause.VARIABLE_LENGTH)

        no_star()
        var = self.variable()
        no_star()
        types = []
        if self.eat(":"):
            types.append(self.name())
            while self.eat("|"):
                self.eat(":")
                types.append(self.name())
        no_star()
        props = self.props() if self.sees("{") else ()
        self.need("]")
        return var, tuple(types), props

    def props(self) -> tuple:
        self.need("{")
        out = []
        while not self.sees("}") and self.now.kind != "end":
            key = self.name()
            self.need(":")
            lit = self.literal()
            if lit is None:
                self.fail("literal value")
            out.append((key, lit.value))
            if not self.eat(","):
                break
        self.need("}")
        return tuple(out)

    # expressions

    def either(self):
        left = self.both()
        while self.eat("OR"):
            left = Op("OR", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.eat("AND"):
            left = Op("AND", (left, self.negated()))
        return left

    def negated(self):
        return Op("NOT", (self.negated(),)) if self.eat("NOT") else self.comparison()

    def comparison(self):
        left = self.primary()
        if self.eat("IS"):
            no = self.eat("NOT")
            if not self.eat("NULL"):
                raise ParseError("expected NULL after IS [NOT]", self.now.span)
            test = Op("ISNULL", (left,))
            return Op("NOT", (test,)) if no else test
        if self.eat("CONTAINS"):
            return Op("CONTAINS", (left, self.primary()))
        for word in ("STARTS", "ENDS"):
            if self.eat(word):
                self.need("WITH")
                return Op(word, (left, self.primary()))
        if self.sees("IN"):
            raise UnsupportedError(Clause.FUNCTION)
        for sign in ("=", "!=", "<>", "<", ">", "<=", ">=", "=~"):
            if self.now.kind == "symbol" and self.eat(sign):
                return Op("!=" if sign == "<>" else sign, (left, self.primary()))
        return left

    def primary(self):
        if self.eat("("):
            inner = self.either()
            self.need(")")
            return inner
        if (lit := self.literal()) is not None:
            return lit
        if self.sees("NOT"):
            return self.negated()
        return self.reference("expression")

    def literal(self) -> Lit | None:
        t = self.now
        if t.kind in ("string", "int", "float"):
            self.at += 1
            return Lit(t.value)
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.eat(word):
                return Lit(value)
        return None

    def reference(self, wanted: str) -> Ref:
        if self.now.kind != "name":
            self.fail(wanted)
        var = self.name()
        if self.eat("."):
            return Ref(var, self.name())
        if self.sees("("):
            raise UnsupportedError(Clause.FUNCTION)
        return Ref(var)

    def returned(self) -> tuple[Ref, str]:
        ref = self.reference("return expression")
        return ref, self.name() if self.eat("AS") else ref.name

    def ordered(self) -> tuple[Ref, bool]:
        ref = self.reference("return expression")
        if self.eat("DESC"):
            return ref, True
        self.eat("ASC")
        return ref, False


def parse(text: str) -> Query:
    return Parser(text).query()
