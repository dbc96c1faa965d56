"""Facts from source texts: definitions, calls, imports and routes of twelve languages.

Python is read with the standard library's parser. The other languages go
through one lexical reader: comments and string contents are blanked (offsets
stay), declarations are found by each language's rules, and their spans by
matching braces or `end`s. Offsets are in bytes. A text that cannot be read
gives an error and no facts, never an exception.
"""

from __future__ import annotations

import ast
import re
import signal
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

TIMEOUT_S = 5.0
ID = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"


@dataclass
class Facts:
    defs: list[tuple[str, str, int, int]] = field(default_factory=list)  # kind, name, start, end
    calls: list[tuple[str, str | None, int]] = field(default_factory=list)  # name, receiver, start of the name
    imports: list[tuple[str, str]] = field(default_factory=list)  # name, module
    routes: list[tuple[str, str, str | None, int, int, int]] = field(default_factory=list)  # method, pattern, handler, start, end, line
    error: str | None = None


@dataclass(frozen=True)
class Rules:
    """How to read one language. Patterns see Latin-1 decoded bytes with comments and strings blanked."""

    defs: tuple[tuple[str, str], ...]  # kind and pattern with a group `name`
    comments: str = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    strings: str = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
    members: tuple[str, str] | None = None  # kind of a function within a body of this kind of container, twin or instead
    containers: str = ""
    blocks: str = "braces"
    news: bool = False
    imports: tuple[str, ...] = ()


def _c_like(*types: tuple[str, str]) -> tuple[tuple[str, str], ...]:
    mods = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|export|default|declare|strictfp|readonly|unsafe|new|data|case|open)\s+)*"
    return tuple((kind, rf"(?m)(?<![\w.]){mods}\b{word}\s+(?P<name>{ID})") for kind, word in types)


BACKTICK = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
#: Words that look like calls or methods and are not; in PHP there are more.
NOT_NAMES = frozenset(
    "if for while switch catch return function fn def class new sizeof match elseif else do try unless until select case func type "
    "await typeof instanceof in of and or not with lock using foreach synchronized super this import "
    "struct enum trait interface impl mod pub let const var val package yield throw delete".split()
)
NOT_NAMES_PHP = NOT_NAMES | frozenset("array list isset unset empty echo print exit die include require_once".split())
METHOD_C = rf"(?m)(?:^|(?<=[{{}};,]))[ \t]*(?:(?:@\w+(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|extern|synchronized|native|default|inline|constexpr|explicit|readonly|get|set|\*)\s+)*(?:[\w$<>\[\],.?*&:]+[ \t*&]+)?(?P<name>~?{ID})[ \t]*\((?:[^(){{}};]|\([^()]*\))*\)[^(){{}};=]*(?=\{{|;)"

RULES: dict[str, Rules] = {
    "rust": Rules(
        defs=(
            ("Function", rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*\bfn\s+(?P<name>{ID})"),
            ("Struct", rf"(?:pub(?:\([^)]*\))?\s+)?\bstruct\s+(?P<name>{ID})"),
            ("Enum", rf"(?:pub(?:\([^)]*\))?\s+)?\benum\s+(?P<name>{ID})"),
            ("Trait", rf"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?\btrait\s+(?P<name>{ID})"),
            ("Module", rf"(?:pub(?:\([^)]*\))?\s+)?\bmod\s+(?P<name>{ID})"),
        ),
        strings=r'"(?:\\.|[^"\\])*"|\'(?:\\.[^\']*|[^\'\\\n])\'',
        members=("Function", "twin"),
        containers=r"\b(?:impl|trait|mod)\b[^;{}]*\{",
        imports=(r"\buse\s+(?P<use>[^;]+);",),
    ),
    "javascript": Rules(
        defs=(("Function", rf"(?:async\s+)?\bfunction\b\s*\*?\s*(?P<name>{ID})"), ("Class", rf"\bclass\s+(?P<name>{ID})"), ("Method", METHOD_C), ("Arrow", rf"\b(?:const|let)\s+(?P<name>{ID})\s*=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{ID})\s*=>")),
        strings=BACKTICK,
        news=True,
        imports=(rf"\bimport\s+(?P<names>[^;'\"`]*?)\s*from\s*(?P<q>['\"])(?P<module>[^'\"\n]*)(?P=q)", rf"\b(?:const|let|var)\s+(?P<names>{ID}|\{{[^}}]*\}})\s*=\s*require\(\s*(?P<q>['\"])(?P<module>[^'\"\n]*)(?P=q)"),
    ),
    "typescript": Rules(
        defs=(
            ("Function", rf"(?:async\s+)?\bfunction\b\s*\*?\s*(?P<name>{ID})"),
            *_c_like(("Class", "class"), ("Class", "interface"), ("Enum", "enum")),
            ("Function", rf"\btype\s+(?P<name>{ID})\s*(?:<[^=]*>)?\s*="),
            ("Method", METHOD_C),
        ),
        strings=BACKTICK,
        news=True,
        imports=(r"\bimport\s+(?:type\s+)?(?P<names>[^;'\"`]*?)\s*from\s*(?P<q>['\"])(?P<module>[^'\"\n]*)(?P=q)",),
    ),
    "go": Rules(
        defs=(("Function", rf"(?m)^func\s+(?P<name>{ID})"), ("Method", rf"(?m)^func\s*\([^)]*\)\s*(?P<name>{ID})"), ("Function", rf"(?m)^[ \t]*type\s+(?P<name>{ID})")),
        strings=BACKTICK,
        imports=(r"(?m)^[ \t]*(?:import\s+)?(?P<alias>[\w.]+[ \t]+)?\"(?P<module>[^\"\n]+)\"[ \t]*$",),
    ),
    "java": Rules(defs=(*_c_like(("Class", "class"), ("Class", "interface"), ("Enum", "enum")), ("Method", METHOD_C)), news=True, imports=(r"\bimport\s+(?:static\s+)?(?P<module>[\w.]+(?:\.\*)?)\s*;",)),
    "cpp": Rules(
        defs=(*_c_like(("Class", "class"), ("Struct", "struct"), ("Enum", r"enum(?:\s+class|\s+struct)?"), ("Module", "namespace")), ("Function", METHOD_C)),
        members=("Method", "instead"),
        containers=r"\b(?:class|struct)\s+[^;{}()]*\{",
        imports=(r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"](?P<module>[^>\"\n]+)[>\"]", r"\busing\s+(?:namespace\s+)?(?P<module>[\w:]+)\s*;"),
    ),
    "csharp": Rules(
        defs=(*_c_like(("Class", "class"), ("Class", "interface"), ("Struct", "struct"), ("Enum", "enum")), ("Module", r"\bnamespace\s+(?P<name>[\w.]+)"), ("Method", METHOD_C)),
        news=True,
        imports=(r"(?m)^[ \t]*using\s+(?:static\s+|(?P<alias>\w+)\s*=\s*)?(?P<module>[\w.]+)\s*;",),
    ),
    "php": Rules(
        defs=(*_c_like(("Class", "class"), ("Class", "interface"), ("Trait", "trait")), ("Function", rf"(?:(?:public|private|protected|static|final|abstract)\s+)*\bfunction\s+&?\s*(?P<name>{ID})")),
        comments=r"//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z)",
        members=("Method", "instead"),
        containers=r"\b(?:class|interface|trait)\s+[^;{}()]*\{",
        news=True,
        imports=(r"(?m)^[ \t]*use\s+(?P<module>[\w\\]+)(?:\s+as\s+\w+)?\s*;",),
    ),
    "lua": Rules(
        defs=(("Function", rf"(?:local\s+)?\bfunction\s+(?P<name>{ID})\s*\("), ("Method", rf"\bfunction\s+{ID}\.(?P<name>{ID})\s*\("), ("Function", rf"(?:local\s+)(?P<name>{ID})\s*=\s*function\b")),
        comments=r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*",
        strings=r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|\[\[.*?\]\]',
        blocks="ends",
        imports=(r"\brequire\s*\(?\s*(?P<q>['\"])(?P<module>[^'\"\n]*)(?P=q)",),
    ),
    "scala": Rules(
        defs=(("Function", rf"(?:(?:override|private|protected|final|implicit|inline)\s+)*\bdef\s+(?P<name>{ID})"), *_c_like(("Class", "class"), ("Trait", "trait"), ("Class", "object"))),
        strings=r'""".*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\'',
        members=("Method", "twin"),
        containers=r"\b(?:class|trait|object)\s+[^;{}]*?\{",
        imports=(r"(?m)^[ \t]*import\s+(?P<module>[\w.]+?)(?:\.\{(?P<names>[^}]*)\})?[ \t]*$",),
    ),
}
RULES["tsx"] = RULES["typescript"]


def blank(text: str, rules: Rules) -> tuple[str, str]:
    """(text without comments, text without comments and string contents), offsets unchanged."""
    spaces = lambda s: re.sub(r"[^\n]", " ", s)
    pattern = re.compile(f"(?P<c>{rules.comments})|(?P<s>{rules.strings})", re.DOTALL)
    no_comments = pattern.sub(lambda m: spaces(m[0]) if m["c"] else m[0], text)
    return no_comments, pattern.sub(lambda m: spaces(m[0]) if m["c"] else m[0][0] + spaces(m[0][1:-1]) + m[0][-1], text)


def closing(text: str, at: int) -> int:
    """End of the declaration that starts at `at`: after its matching brace, or its line where a `;` or nothing opens one."""
    depth = 0
    for m in re.compile(r"[{};]|\n[ \t]*\n").finditer(text, at):
        c = m[0]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.end() if depth == 0 else m.start()
        elif depth == 0:
            return m.end() if c == ";" else m.start()
    return len(text)


def lua_end(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"\b(function|if|do|repeat|end|until)\b").finditer(text, at):
        depth += -1 if m[1] in ("end", "until") else 1
        if depth == 0:
            return m.end()
    return len(text)


#: What stands before a name in a statement that is no declaration, and in a declaration with a type.
STATEMENT, TYPE_END, OPENS = re.compile(r"\b(?:return|new|else|throw|await)\s+"), re.compile(r"[\w>\]]\s+"), re.compile(r"\s*\(")


def _opens_after(before: re.Pattern, name: str, text: str) -> bool:
    """Whether `name` and a parenthesis follow a match of `before`. A pattern with the name in it would be compiled for every name."""
    return any(text.startswith(name, b.end()) and OPENS.match(text, b.end() + len(name)) for b in before.finditer(text))


def _spans(code: str, pattern: str) -> list[tuple[int, int]]:
    return [(m.end() - 1, closing(code, m.end() - 1)) for m in re.finditer(pattern, code)] if pattern else []


def lexical(lang: str, data: bytes) -> Facts:
    rules, facts = RULES[lang], Facts()
    text = data.decode("latin-1")
    bare, code = blank(text, rules)
    name_of = lambda s: s.encode("latin-1").decode("utf-8", "replace")
    reserved = NOT_NAMES_PHP if lang == "php" else NOT_NAMES if rules.news else NOT_NAMES - {"new"}
    end_of = lua_end if rules.blocks == "ends" else closing
    bodies, named = _spans(code, rules.containers), set()
    interfaces = _spans(code, r"\binterface\s+[^;{}()]*\{")
    for kind, pattern in rules.defs:
        for m in re.finditer(pattern, code):
            name, at = m["name"], m.start("name")
            if at in named or pattern is METHOD_C and name in reserved:
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            own = kind
            if pattern is METHOD_C:
                before, open_end = code[:start].rstrip()[-1:], code[m.end() : m.end() + 1] == ";"
                if before not in ("", "{", "}", ";", ",", ")", "*", ":", ">") or _opens_after(STATEMENT, name, m[0]):
                    continue
                if open_end:  # a signature, or a call that only looks like one
                    typed = _opens_after(TYPE_END, name, m[0])
                    if lang in ("typescript", "tsx") and any(a < start < b and code.count("{", a + 1, start) == code.count("}", a + 1, start) for a, b in interfaces):
                        own = "Function"
                    elif not (lang in ("java", "csharp") and (typed or any(a < start < b for a, b in interfaces))):
                        continue
            named.add(at)
            if lang == "rust" and kind == "Function" and code[closing(code, start) - 1 : closing(code, start)] == ";":
                continue  # a signature without a body
            inside = any(a < start < b for a, b in bodies)
            end = end_of(code, start)
            twin = rules.members and inside and kind == "Function"
            if kind == "Arrow":
                own = "Function"
            if not (twin and rules.members[1] == "instead"):
                facts.defs.append((own, name_of(name), start, end))
            if twin:
                facts.defs.append(("Method", name_of(name), start, end))
    call = re.compile(rf"(?:(?P<receiver>{ID})\s*(?:\?\.|\.|::|->|:)\s*)?(?P<name>{ID})\s*(?:::\s*<[^<>()]*>\s*)?\(" + (rf"|\bnew\s+(?:(?P<space>[\w.$\\]+)[.\\])?(?P<made>{ID})" if rules.news else ""))
    at = 0
    while m := call.search(code, at):
        group = "name" if m["name"] else "made"
        at = m.end(group)
        name = m[group]
        if m.start(group) in named or name in reserved:
            continue
        facts.calls.append((name_of(name), name_of(m["receiver"]) if m["receiver"] and m["receiver"] not in ("new",) else None, m.start(group)))
    facts.calls = list(dict.fromkeys(facts.calls))
    for pattern in rules.imports:
        for m in re.finditer(pattern, bare):
            facts.imports += _imported({k: name_of(v) for k, v in m.groupdict().items() if v})
    facts.routes = _call_routes(bare, code, name_of)
    return facts


def _imported(found: dict[str, str]) -> list[tuple[str, str]]:
    if "use" in found:  # Rust: a path, a list, or nested lists
        return [(p.rsplit("::", 1)[-1], p.rsplit("::", 1)[0]) for p in _rust_paths(re.sub(r"\s+", " ", found["use"]).strip())]
    module = found.get("module", "")
    last = re.split(r"[./\\:]+", module)[-1]
    if "names" in found:
        names = [re.split(r"\s+as\s+|\s*=>\s*|\s*:\s*", n.strip())[0].strip("* ") for n in re.sub(r"[{}]", ",", found["names"]).split(",")]
        return [(n or last, module) for n in names if n] or [(last, module)]
    return [(last, module)]


def _rust_paths(path: str) -> list[str]:
    m = re.match(r"(.*?)::\s*\{(.*)\}$", path)
    if not m:
        return [re.sub(r"\s+as\s+\w+$", "", path)]
    parts, depth, start = [], 0, 0
    for i, c in enumerate(m[2] + ","):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(m[2][start:i].strip())
            start = i + 1
    return [f"{m[1]}::{p}" for part in parts if part for p in _rust_paths(part)]


def _call_routes(bare: str, code: str, name_of) -> list[tuple]:
    """Member calls with a string and then a handler, by name or in place, among their arguments."""
    out = []
    for m in re.finditer(rf"\.\s*(?P<method>{ID})\s*\(\s*(?P<pattern>\"[^\"\n]*\"|'[^'\n]*')\s*,", bare):
        depth, at = 1, m.end()
        while at < len(code) and depth:
            depth += (code[at] in "([{") - (code[at] in ")]}")
            at += 1
        handler = re.search(rf"(?:^|,)\s*(?:(?P<name>{ID})|(?P<inline>(?:async\s*)?(?:\([^()]*\)|{ID})\s*=>.*|(?:async\s+)?function\b.*|func\s*\(.*))\s*,?\s*$", code[m.end() : at - 1], re.DOTALL)
        if not handler:
            continue
        inline = handler["inline"] is not None
        start = m.end() + handler.start("inline" if inline else "name")
        end = m.end() + handler.end("inline" if inline else "name")
        line = bare.count("\n", 0, start)
        out.append((name_of(m["method"]).upper(), name_of(m["pattern"][1:-1]), None if inline else name_of(handler["name"]), m.start("method"), end, line))
    return out


def python(data: bytes) -> Facts:
    facts = Facts()
    tree = ast.parse(data)
    starts = [0]
    for line in data.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    at = lambda line, col: starts[line - 1] + col
    span = lambda n: (at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset))

    def visit(node: ast.AST, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                start, end = span(child)
                facts.defs.append(("Function", child.name, start, end))
                if child.decorator_list:
                    first = child.decorator_list[0]
                    facts.defs.append(("Function", child.name, data.rfind(b"@", 0, at(first.lineno, first.col_offset)), end))
                elif in_class:
                    facts.defs.append(("Method", child.name, start, end))
                for d in child.decorator_list:
                    if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute):
                        texts = [a for a in d.args if isinstance(a, ast.Constant) and isinstance(a.value, str)]
                        if texts:
                            name = data.index(child.name.encode(), start)
                            method = at(d.func.end_lineno, d.func.end_col_offset) - len(d.func.attr.encode())
                            facts.routes.append((d.func.attr.upper(), texts[0].value, child.name, method, name + len(child.name.encode()), child.lineno - 1))
            elif isinstance(child, ast.ClassDef):
                facts.defs.append(("Class", child.name, *span(child)))
            elif isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    facts.calls.append((f.id, None, at(f.lineno, f.col_offset)))
                elif isinstance(f, ast.Attribute):
                    receiver = f.value.id if isinstance(f.value, ast.Name) else f.value.attr if isinstance(f.value, ast.Attribute) else None
                    facts.calls.append((f.attr, receiver, at(f.end_lineno, f.end_col_offset) - len(f.attr.encode())))
            elif isinstance(child, ast.Import):
                facts.imports += [(a.name.rsplit(".", 1)[-1], a.name) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                facts.imports += [(module.rsplit(".", 1)[-1] if a.name == "*" else a.name, module) for a in child.names]
            visit(child, isinstance(child, ast.ClassDef))

    visit(tree, False)
    return facts


class Overlong(Exception):
    """A text took more than its time."""


@contextmanager
def time_limit(seconds: float) -> Iterator[None]:
    """Stops what runs within it after that time. Matching of regular expressions heeds it too; tasks run in their worker's main thread."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(number, frame):
        raise Overlong

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def extract(lang: str, data: bytes, seconds: float = TIMEOUT_S) -> Facts:
    """Facts of one text; failures and overlong work become `error`."""
    try:
        with time_limit(seconds):
            return python(data) if lang == "python" else lexical(lang, data)
    except Overlong:
        return Facts(error="timeout")
    except (SyntaxError, ValueError, RecursionError, KeyError, IndexError) as e:
        return Facts(error=f"{type(e).__name__}: {e}"[:200])
