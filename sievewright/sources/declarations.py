"""What source files import and declare: a table of rules, each a pattern for some languages, read by one loop."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

#: Fields of a summary, with the most values that each keeps.
CAPS = {"imports": 40, "classes": 40, "types": 40, "functions": 80, "exports": 40, "routes": 40, "symbols": 120}
PYTHON_SYMBOLS = 100

# Suffixes of each language.
LANGUAGES = {
    "python": (".py",), "js": (".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".vue", ".svelte"), "rust": (".rs",), "go": (".go",), "jvm": (".cs", ".java", ".kt", ".kts"), "swift-php": (".swift", ".php"),
    "c": (".c", ".h", ".cc", ".cpp", ".hpp"), "shell": (".sh", ".bash", ".zsh"), "powershell": (".ps1",), "sql": (".sql",),
}
_CURLY = ("jvm", "swift-php")


class Rule(NamedTuple):
    """A pattern that puts what it matches in a field. Of the rules of a field a statement's first match counts, unless
    it is `more`: then all its matches do, and the field's other rules are tried as well. `languages` empty: all but sql,
    which has rules of its own. Names in `never` don't count. `search`: the match may stand anywhere in the statement."""

    field: str
    languages: tuple[str, ...]
    pattern: str
    show: Callable[[re.Match], str] = lambda m: m[1]
    never: tuple[str, ...] = ()
    more: bool = False
    search: bool = False


def _short(text: str, limit: int = 180) -> str:
    flat = " ".join(text.split())
    return flat[:limit] + "…" * (len(flat) > limit)


def _call(m: re.Match) -> str:
    return _short(f"{m[1]}({m[2]})")


def _bare(m: re.Match) -> str:
    return _short(f"{m[1]}()")


def _unquoted(m: re.Match) -> str:
    return m[1].strip("'\"")


def _route(m: re.Match) -> str:
    return f"{m[1].upper()} {(m[2] or '').strip()}".strip()


# Patterns of what lines import and declare, words that are no functions' names.
_SQL = r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)\s+|GLOBAL\s+|UNIQUE\s+|MATERIALIZED\s+)?"
_SQL_NAME = r"\s+(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z_][\w.]*)"
_C_WORDS = ("if", "for", "while", "switch", "catch", "return", "sizeof", "do", "else")
RULES = (
    Rule("imports", ("js",), r"(?:from\s+|require\s*\(\s*)['\"]([^'\"]+)['\"]", more=True, search=True),
    Rule("imports", ("js",), r"(?:import\s*\(\s*)['\"]([^'\"]+)['\"]", more=True, search=True),
    Rule("imports", ("rust",), r"(?:use|mod)\s+([^;{]+)", lambda m: _short(m[1])),
    Rule("imports", ("go",), r"import\s+(?:\w+\s+)?[\"`]([^\"`]+)"),
    Rule("imports", ("jvm",), r"(?:using|import)\s+([^;]+)"),
    Rule("imports", ("c",), r"#include\s+\"([^\"]+)\"", lambda m: f"./{m[1]}"),
    Rule("imports", ("c",), r"#include\s+<([^>]+)>"),
    Rule("imports", ("shell",), r"(?:source|\.)\s+(?!\$)([^\s;|&]+)", _unquoted),
    Rule("imports", ("powershell",), r"(?i)Import-Module\s+([^\s;]+)", _unquoted),
    Rule("imports", ("powershell",), r"\.\s+([.\\/][^\s;]+)", lambda m: m[1].replace("\\", "/")),
    Rule("functions", ("sql",), _SQL + r"(?:PROCEDURE|FUNCTION)" + _SQL_NAME, lambda m: f"{m[1]}()"),
    Rule("types", ("sql",), _SQL + r"(?:TABLE|VIEW|TYPE|SCHEMA|INDEX|TRIGGER)" + _SQL_NAME),
    Rule("classes", (), r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_]\w*)"),
    Rule("classes", (), r"(?:public\s+|private\s+|internal\s+|protected\s+)?(?:abstract\s+|sealed\s+|static\s+)?class\s+([A-Za-z_]\w*)"),
    Rule("classes", (), r"(?:pub\s+)?struct\s+([A-Za-z_]\w*)"),
    Rule("types", (), r"(?:export\s+)?interface\s+([A-Za-z_]\w*)"),
    Rule("types", (), r"(?:export\s+)?type\s+([A-Za-z_]\w*)"),
    Rule("types", (), r"(?:pub\s+)?(?:enum|trait)\s+([A-Za-z_]\w*)"),
    Rule("types", (), r"(?:public\s+)?(?:interface|enum|record)\s+([A-Za-z_]\w*)"),
    Rule("functions", ("js",), r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_]\w*)\s*\((.*?)\)", _call),
    Rule("functions", ("js",), r"(?:export\s+)?(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?\((.*?)\)\s*=>", _call),
    Rule("functions", ("js",), r"(?:export\s+)?(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?([A-Za-z_]\w*)\s*=>", _call),
    Rule("functions", ("rust",), r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)\s*\((.*?)\)", _call),
    Rule("functions", ("go",), r"func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\((.*?)\)", _call),
    Rule("functions", _CURLY, r"(?!(?:if|for|while|switch|catch|foreach)\b).*?([A-Za-z_]\w*)\s*\((.*?)\)", _call, ("if", "for", "while", "switch", "catch", "new", "return")),
    Rule("functions", ("c",), r"(?:[A-Za-z_][\w:<>,\s\*&]*?[\s\*&])([A-Za-z_]\w*)\s*\((.*?)\)\s*(?:const\s*)?\{", _call, _C_WORDS),
    Rule("functions", ("shell",), r"(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\s*\)\s*\{", _bare),
    Rule("functions", ("shell",), r"function\s+([A-Za-z_][\w-]*)\s*\{", _bare),
    Rule("functions", ("powershell",), r"(?i)function\s+([A-Za-z_][\w-]*)", _bare),
    Rule("exports", (), r"export\s+.*?(?:class|function|const|let|var|interface|type|enum)\s+([A-Za-z_]\w*)"),
    Rule("routes", (), r"(?i)^.*?\b(?:app|router)\.(get|post|put|patch|delete)\s*\(\s*['\"]([^'\"]+)", _route, more=True, search=True),
    Rule("routes", (), r"(?i)^.*?\[Http(Get|Post|Put|Patch|Delete)(?:\(\s*['\"]([^'\"]*)['\"]\s*\))?\]", _route, more=True, search=True),
    Rule("routes", (), r"(?i)^.*?@(get|post|put|patch|delete)\s*\(\s*['\"]([^'\"]+)", _route, more=True, search=True),
)
# Patterns of the lines at which symbols begin.
STARTS = (
    Rule("class", (), r"(?:export\s+)?(?:default\s+)?(?:public\s+|private\s+|protected\s+|internal\s+|abstract\s+|sealed\s+|static\s+)*class\s+([A-Za-z_]\w*)"),
    Rule("type", (), r"(?:export\s+)?(?:interface|type|enum|record|trait|struct)\s+([A-Za-z_]\w*)"),
    Rule("function", (), r"(?:export\s+)?(?:default\s+)?(?:public\s+|private\s+|protected\s+|internal\s+|static\s+|async\s+|pub\s+)*function\s+([A-Za-z_]\w*)\s*\("),
    Rule("function", (), r"(?:export\s+)?(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_]\w*)\s*=>"),
    Rule("function", (), r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)\s*\("),
    Rule("function", (), r"func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\("),
    Rule("function", ("c",), r"(?:[A-Za-z_][\w:<>,\s\*&]*?[\s\*&])([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:const\s*)?\{", never=_C_WORDS),
    Rule("function", ("shell",), r"(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\s*\)\s*\{"),
    Rule("function", ("shell",), r"function\s+([A-Za-z_][\w-]*)\s*\{"),
    Rule("function", ("powershell",), r"(?i)function\s+([A-Za-z_][\w-]*)"),
    Rule("type", ("sql",), _SQL + r"(?:TABLE|VIEW|TYPE|SCHEMA|INDEX|TRIGGER|PROCEDURE|FUNCTION)" + _SQL_NAME),
)


def language_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""
    return next((k for k, suffixes in LANGUAGES.items() if suffix in suffixes), "")


@cache
def _rules(table: str, language: str) -> tuple[tuple[Rule, re.Pattern], ...]:
    """The rules of a language, compiled. A summary of sql has its own alone."""
    rows = {"summary": RULES, "symbols": STARTS}[table]
    shared = table == "symbols" or language != "sql"
    return tuple((r, re.compile(r.pattern)) for r in rows if language in r.languages or shared and not r.languages)


def _found(statement: str, rules: tuple[tuple[Rule, re.Pattern], ...]) -> Iterator[tuple[Rule, re.Match]]:
    """What a statement matches, rule by rule."""
    settled: set[str] = set()
    for rule, pattern in rules:
        if rule.field in settled:
            continue
        hits = list(pattern.finditer(statement)) if rule.more else list(filter(None, [(pattern.search if rule.search else pattern.match)(statement)]))
        if hits and not rule.more:
            settled.add(rule.field)
        yield from ((rule, m) for m in hits if m[1] not in rule.never)


def statements(text: str) -> list[str]:
    """Lines without white space at the ends; those whose parentheses stay open take the next ones in, until they close
    or there are more than 500 characters."""
    lines = [x for x in map(str.strip, text.splitlines()) if x]
    out, at = [], 0
    while at < len(lines):
        end, depth, size = at, 0, -1
        while end < len(lines):
            depth, size, end = depth + lines[end].count("(") - lines[end].count(")"), size + 1 + len(lines[end]), end + 1
            if depth <= 0 or size > 500:
                break
        out.append(" ".join(lines[at:end]))
        at = end
    return out


def _once(values: list[str], most: int) -> list[str]:
    return list(dict.fromkeys(filter(None, map(str.strip, values))))[:most]


def _tree(text: str) -> ast.AST | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError):
        return None


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    return f"{node.name}({', '.join(a.arg for a in node.args.args)})"


def _of_tree(tree: ast.AST) -> Iterator[tuple[str, str]]:
    """(field, value) of a Python file's nodes."""
    for node in ast.walk(tree):
        match node:
            case ast.Import():
                yield from (("imports", a.name) for a in node.names)
            case ast.ImportFrom():
                yield "imports", "." * node.level + (node.module or "")
            case ast.ClassDef():
                yield from (("classes", node.name), ("symbols", node.name))
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                yield from (("functions", _signature(node)), ("symbols", node.name))
            case ast.Assign(targets=targets):
                yield from (("types", t.id) for t in targets if isinstance(t, ast.Name) and t.id[:1].isupper())
            case ast.AnnAssign(target=ast.Name(id=name)) if name[:1].isupper():
                yield "types", name


def _of_statements(text: str, language: str) -> Iterator[tuple[str, str]]:
    """(field, value) of the statements of a file in any other language; comments have none."""
    rules, exports = _rules("summary", language), []
    for statement in statements(text):
        if statement.startswith(("//", "/*", "*")) or statement.startswith("#") and not (language == "c" and statement.startswith("#include")):
            continue
        for rule, m in _found(statement, rules):
            yield rule.field, rule.show(m)
            if rule.field in ("classes", "types", "functions"):
                yield "symbols", m[1]
            elif rule.field == "exports":
                exports.append(m[1])
    yield from (("symbols", x) for x in exports)


def summarize(path: str, text: str) -> dict:
    """What a source file imports and declares: by the syntax tree for Python, else statement by statement."""
    language = language_of(path)
    tree = _tree(text) if language == "python" else None
    found: dict[str, list[str]] = {k: [] for k in CAPS}
    for field, value in _of_tree(tree) if tree is not None else _of_statements(text, language):
        found[field].append(value)
    caps = CAPS if tree is None else CAPS | {"symbols": PYTHON_SYMBOLS}
    return {k: _once(v, caps[k]) for k, v in found.items()} | {"lines": len(text.splitlines()), "parser": "heuristic" if tree is None else "python-ast"}


def _last_line(lines: list[str], start: int, language: str) -> int:
    """Last line (from 0) of what begins at line `start`: the statement's end in sql, else where its braces close."""
    if language == "sql":
        return next((i for i in range(start, min(len(lines), start + 200)) if ";" in lines[i]), start)
    depth, opened = 0, False
    for i in range(start, min(len(lines), start + 500)):
        opened = opened or "{" in lines[i]
        depth += lines[i].count("{") - lines[i].count("}")
        if opened and depth <= 0:
            return i
    return min(len(lines), start + 80) - 1


def _spans(path: str, text: str, lines: list[str]) -> Iterator[tuple[str, str, str | None, int, int]]:
    """(name, kind, signature, first line, last line), from 1."""
    language = language_of(path)
    if language == "python":
        for n in ast.walk(_tree(text) or ast.Module([], [])):
            if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                plain = isinstance(n, ast.ClassDef)
                yield n.name, "class" if plain else "function", None if plain else _signature(n), n.lineno, n.end_lineno or n.lineno
        return
    rules = _rules("symbols", language)
    for i, line in enumerate(lines):
        hit = next(((r, m) for r, p in rules if (m := p.match(line.lstrip())) and m[1] not in r.never), None)
        if hit:
            yield hit[1][1], hit[0].field, line.strip()[:220], i + 1, _last_line(lines, i, language) + 1


def symbols(path: str, text: str) -> list[dict]:
    """Symbols with their lines, a hash of those, and about their tokens."""
    lines, out = text.splitlines(), []
    for name, kind, signature, start, end in _spans(path, text, lines):
        chunk = "\n".join(lines[start - 1 : end]).encode()
        out.append({"name": name, "kind": kind, "signature": signature, "start_line": start, "end_line": end, "fingerprint": hashlib.sha256(chunk).hexdigest(), "estimated_tokens": max(1, len(chunk) // 4)})
    return out
