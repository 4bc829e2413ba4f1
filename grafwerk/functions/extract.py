"""Symbols and references of source texts, one file at a time, by a registry of parsers.

extract() runs them in Arrow batches; a file whose parser fails gives a row with record = 'failed' and the reason, so that
one file never stops a job. Python is parsed with ast; markup, styles and data files with their own small parsers; other
languages with a structural scanner over brace or end blocks.
"""

from __future__ import annotations

import ast
import html.parser
import json
import re
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, record string, kind string, name string, fqn string, signature string, doc string, start_line int, start_col int, end_line int, end_col int, visibility string, parent string, reason string"
_FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
_INTS = {"start_line", "start_col", "end_line", "end_col"}


@dataclass
class Found:
    module: str
    rows: list[dict] = field(default_factory=list)

    def symbol(self, kind: str, name: str, fqn: str, start: int, end: int | None = None, col: int = 0, end_col: int = 0, signature: str = "", doc: str | None = None, visibility: str = "public", parent: str | None = None) -> None:
        self.rows.append({"record": "sym", "kind": kind, "name": name, "fqn": fqn, "signature": " ".join(signature.split()), "doc": doc, "start_line": start, "start_col": col, "end_line": end or start, "end_col": end_col, "visibility": visibility, "parent": parent})

    def ref(self, kind: str, source: str, name: str, line: int, col: int = 0) -> None:
        self.rows.append({"record": "ref", "kind": kind, "name": name, "fqn": source, "start_line": line, "start_col": col})


# ---- Python ------------------------------------------------------------------

_BUILTINS = frozenset(dir(__import__("builtins")))


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


class _Python(ast.NodeVisitor):
    def __init__(self, found: Found, text: str) -> None:
        self.found, self.lines = found, text.splitlines()
        self.scope, self.kinds = [found.module], ["module"]
        self.alias: dict[str, str] = {}

    def here(self) -> str:
        return ".".join(self.scope)

    def _definition(self, node, kind: str, signature: str) -> None:
        name = node.name
        self.found.symbol(kind, name, f"{self.here()}.{name}", node.lineno, node.end_lineno, node.col_offset, node.end_col_offset, signature, ast.get_docstring(node), "private" if name.startswith("_") and not name.startswith("__") else "public", self.here())
        for d in node.decorator_list:
            self.visit(d)
        self.scope.append(name)
        self.kinds.append(kind)
        for child in node.body:
            self.visit(child)
        self.scope.pop()
        self.kinds.pop()

    def visit_FunctionDef(self, node) -> None:
        lead = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
        returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        for default in [*node.args.defaults, *[d for d in node.args.kw_defaults if d]]:
            self.visit(default)
        self._definition(node, "method" if self.kinds[-1] == "class" else "function", f"{lead} {node.name}({ast.unparse(node.args)}){returns}")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        for base in node.bases:
            if name := _dotted(base):
                self.found.ref("inherits", f"{self.here()}.{node.name}", self._resolve(name), node.lineno, node.col_offset)
        self._definition(node, "class", f"class {node.name}({', '.join(map(ast.unparse, node.bases))})" if node.bases else f"class {node.name}")

    def _assigned(self, target: ast.AST, node: ast.AST) -> None:
        if isinstance(target, ast.Name) and self.kinds[-1] in ("module", "class"):
            n = target.id
            self.found.symbol("constant" if n.isupper() else "variable", n, f"{self.here()}.{n}", node.lineno, node.end_lineno, node.col_offset, node.end_col_offset, (self.lines[node.lineno - 1] if node.lineno <= len(self.lines) else "")[:200], None, "private" if n.startswith("_") else "public", self.here())
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self._assigned(t, node)

    def visit_Assign(self, node) -> None:
        for t in node.targets:
            self._assigned(t, node)
        self.generic_visit(node)

    def visit_AnnAssign(self, node) -> None:
        self._assigned(node.target, node)
        self.generic_visit(node)

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.alias[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            self.found.ref("imports", self.here(), a.name, node.lineno, node.col_offset)

    def visit_ImportFrom(self, node) -> None:
        base = node.module or ""
        if node.level:
            around = self.found.module.split(".")[: -node.level]
            base = ".".join([*around, *([base] if base else [])])
        for a in node.names:
            full = f"{base}.{a.name}" if base else a.name
            if a.name != "*":
                self.alias[a.asname or a.name] = full
            self.found.ref("imports", self.here(), full, node.lineno, node.col_offset)

    def _resolve(self, name: str) -> str:
        head, dot, rest = name.partition(".")
        return self.alias[head] + dot + rest if head in self.alias else name

    def visit_Call(self, node) -> None:
        name = _dotted(node.func)
        if name is None and isinstance(node.func, ast.Attribute):
            name = node.func.attr
        if name:
            head = name.partition(".")[0]
            if "." in name and head not in self.alias:
                name = name.rpartition(".")[2]  # self, cls and unknown receivers keep the last part only
            if head in self.alias or name not in _BUILTINS:
                self.found.ref("calls", self.here(), self._resolve(name), node.lineno, node.col_offset)
        self.generic_visit(node)


def _python(text: str, found: Found) -> None:
    _Python(found, text).visit(ast.parse(text))


# ---- markup, styles, data ----------------------------------------------------

_ABSOLUTE = re.compile(r"^(?:[a-z][a-z0-9+.-]*:|//|#|\?)", re.I)


def asset_path(url: str) -> str | None:
    """A local asset's path without query and fragment, or None for other urls."""
    url = url.strip()
    return None if not url or _ABSOLUTE.match(url) else re.split(r"[?#]", url, maxsplit=1)[0] or None


class _Html(html.parser.HTMLParser):
    def __init__(self, found: Found) -> None:
        super().__init__(convert_charrefs=True)
        self.found = found

    def handle_starttag(self, tag, attrs) -> None:
        line, col = self.getpos()
        for name, value in attrs:
            if not value:
                continue
            if name == "id":
                self.found.symbol("html_id", value, f"{self.found.module}#{value}", line, line, col, col, f"<{tag} id={value}>")
            elif name == "class":
                for c in value.split():
                    self.found.ref("references", self.found.module, c, line, col)
            elif name == "src" or (name == "href" and tag in ("link", "a")) or (name == "data" and tag == "object"):
                if (path := asset_path(value)) and not (tag == "a" and not re.search(r"\.\w+$", path)):
                    self.found.ref("imports", self.found.module, path, line, col)


def _html(text: str, found: Found) -> None:
    p = _Html(found)
    p.feed(text)
    p.close()


def _css(text: str, found: Found) -> None:
    clean = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    line_at = lambda at: clean.count("\n", 0, at) + 1
    seen: set[tuple[str, str]] = set()
    for m in re.finditer(r"@(?:import|use|forward)\s+(?:url\()?['\"]?([^'\");\s]+)", clean):
        found.ref("imports", found.module, m[1], line_at(m.start()))
    for m in re.finditer(r"@(mixin|function)\s+([\w-]+)", clean):
        found.symbol(m[1], m[2], f"{found.module}.{m[2]}", line_at(m.start()))
    for block in re.finditer(r"([^{};]+)\{", clean):
        if block[1].lstrip().startswith("@"):
            continue
        for m in re.finditer(r"([.#])((?:\\.|[\w-])+)", block[1]):
            name = re.sub(r"\\(.)", r"\1", m[2])
            kind, line = "css_class" if m[1] == "." else "css_id", line_at(block.start() + m.start())
            if name[0].isdigit() or (kind, name) in seen:
                continue
            seen.add((kind, name))
            found.symbol(kind, name, f"{found.module}{m[1]}{name}", line, signature=block[1].strip())
            if kind == "css_id":
                found.ref("references", found.module, name, line)


def _markdown(text: str, found: Found) -> None:
    stack: list[tuple[int, str]] = []
    fenced = False
    for number, line in enumerate(text.split("\n"), 1):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line)
        if m:
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            parent = ".".join([found.module, *[s for _, s in stack]])
            found.symbol("section", m[2], f"{parent}.{m[2]}", number, signature=line, parent=parent)
            stack.append((len(m[1]), m[2]))


def _keys(names: list[str], text: str, found: Found, lead: str) -> None:
    for name in names:
        m = re.search(lead.format(re.escape(name)), text, re.M)
        found.symbol("key", name, f"{found.module}.{name}", text.count("\n", 0, m.start()) + 1 if m else 1)


def _json(text: str, found: Found) -> None:
    data = json.loads(text)
    _keys(list(data) if isinstance(data, dict) else [], text, found, r'"{}"\s*:')


def _toml(text: str, found: Found) -> None:
    _keys(list(tomllib.loads(text)), text, found, r"^\s*\[*\"?{}\b")


def _yaml(text: str, found: Found) -> None:
    _keys(list(dict.fromkeys(re.findall(r"^([A-Za-z_][\w.-]*)\s*:(?:\s|$)", text, re.M))), text, found, r"^{}\s*:")


def _terraform(text: str, found: Found) -> None:
    for m in re.finditer(r'^(resource|data|variable|output|module|provider|locals)\b[ \t]*((?:"[^"]*"[ \t]*)*)\{', text, re.M):
        labels = re.findall(r'"([^"]*)"', m[2])
        line = text.count("\n", 0, m.start()) + 1
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        body, end = text[m.end() : at], text.count("\n", 0, at) + 1
        kind = {"locals": "local"}.get(m[1], m[1])
        names = re.findall(r"^\s*(\w+)\s*=", body, re.M) if kind == "local" else [".".join(labels)]
        for name in names:
            address = {"resource": name, "variable": f"var.{name}", "local": f"local.{name}"}.get(kind, f"{kind}.{name}")
            found.symbol(kind, name.rpartition(".")[2], address, line, end, signature=m[0])
        address = f"{m[1]}.{'.'.join(labels)}"
        for r in re.finditer(r"\b((?:var|local|module|data)\.\w+(?:\.\w+)?|[a-z]+_\w+\.\w+)", body):
            found.ref("references", address, r[1], line + body.count("\n", 0, r.start()))
        if kind == "module" and (s := re.search(r'^\s*source\s*=\s*"([^"]+)"', body, re.M)):
            found.ref("imports", address, s[1], line + body.count("\n", 0, s.start()))


# ---- other languages ---------------------------------------------------------

_NAME = r"[A-Za-z_$][\w$]*"
_PATTERNS: dict[str, list[tuple[str, str]]] = {
    "curly": [("class", rf"\b(?:class|record|object|trait|actor|extension)\s+({_NAME})"), ("interface", rf"\b(?:interface|protocol)\s+({_NAME})"), ("struct", rf"\bstruct\s+({_NAME})"), ("enum", rf"\benum\s+(?:class\s+)?({_NAME})"), ("function", rf"\b(?:func|fn|fun|function|def)\s+(?:\([^)]*\)\s*)?({_NAME})\s*(?:<[^>]*>)?\s*\("), ("type_alias", rf"\btype\s+({_NAME})\s*(?:<[^>]*>)?\s*="), ("module", rf"\b(?:namespace|mod|module)\s+({_NAME})")],
    "arrow": [("function", rf"\b(?:const|let|var)\s+({_NAME})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{_NAME})\s*=>"), ("function", rf"\b({_NAME})\s*=\s*function\b")],
    "typed": [("function", rf"^[ \t]*(?:[\w<>\[\],.*&:]+[ \t]+)+[*&]*((?:{_NAME}::)?~?{_NAME})\s*\([^;{{}}]*\)\s*(?:const|noexcept|override|throws[\w\s,.]+)?\s*\{{")],
    "ends": [("class", rf"^\s*class\s+({_NAME})"), ("module", rf"^\s*(?:module|defmodule)\s+([\w.]+)"), ("method", rf"^\s*(?:def|defp|defmacro)\s+(?:self\.)?({_NAME}[?!]?)"), ("function", rf"^\s*(?:local\s+)?function\s+([\w.:]+)\s*\(")],
    "lisp": [("function", r"\((?:defn-?|defmacro|defmulti|defmethod)\s+([^\s()\[\]]+)"), ("variable", r"\((?:def|defonce)\s+([^\s()\[\]]+)"), ("interface", r"\(defprotocol\s+([^\s()\[\]]+)"), ("struct", r"\((?:defrecord|deftype)\s+([^\s()\[\]]+)"), ("module", r"\(ns\s+([^\s()\[\]]+)")],
    "sql": [("class", r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?([\w.]+)"), ("function", r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.]+)")],
    "shell": [("function", r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{")],
}
_FAMILY = {"java": ["curly", "typed"], "csharp": ["curly", "typed"], "c": ["curly", "typed"], "cpp": ["curly", "typed"], "cuda": ["curly", "typed"], "dart": ["curly", "typed"], "typescript": ["curly", "arrow"], "tsx": ["curly", "arrow"], "javascript": ["curly", "arrow"], "vue": ["curly", "arrow"], "svelte": ["curly", "arrow"], "ruby": ["ends"], "lua": ["ends"], "luau": ["ends"], "elixir": ["ends"], "clojure": ["lisp"], "sql": ["sql"], "bash": ["shell"], "go": ["curly"]}
_IMPORT = [r"^\s*import\s+(?:static\s+)?(?:.*?\bfrom\s+)?['\"]?([\w./@*-]+)['\"]?", r"^\s*(?:using|use|require_once|require|include|require_relative)\s+['\"(]*([\w.:/\\-]+)", r"^\s*#\s*include\s*[<\"]([^>\"]+)", r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]", r"^\s*(?:alias|source)\s+([\w./-]+)", r"^\s*\"([\w./-]+)\"\s*$"]
_INHERITS = [r"\bclass\s+(\w+)(?:\s*<[^>]*>)?\s*(?:extends|:|<)\s*(?:public\s+|private\s+)?([\w.:]+)", r"\bimpl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+(\w+)"]
_NOT_CALLS = frozenset("if for while switch return catch function def fn func fun sizeof typeof new class when match elif elsif unless until and or not in is do else try throw await yield super this self init case guard defer go select with using lock foreach print ns def defn defn- defmacro defmulti defmethod defonce defprotocol defrecord deftype".split())
_CONTROL = frozenset("if for while switch return catch else do try with match when until unless elif elsif new await".split())
_METHOD = re.compile(rf"^[ \t]+(?:(?:public|private|protected|static|async|get|set|override|readonly|final|abstract|internal|virtual)\s+)*({_NAME})\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?::\s*[^;{{}}=]+)?\{{", re.M)


def _blanked(text: str, language: str) -> str:
    """text with comments and strings blanked, line breaks kept; import lines keep their strings elsewhere."""
    comment = {"clojure": r";[^\n]*", "lua": r"--[^\n]*", "luau": r"--[^\n]*", "sql": r"--[^\n]*", "haskell": r"--[^\n]*", "ruby": r"#[^\n]*", "bash": r"#[^\n]*", "elixir": r"#[^\n]*", "r": r"#[^\n]*", "julia": r"#[^\n]*", "perl": r"#[^\n]*", "php": r"(?://|#)[^\n]*"}.get(language, r"//[^\n]*")
    pattern = rf"/\*.*?\*/|{comment}|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _block_end(code: str, at: int, ends: bool) -> int:
    if ends:
        indent = len(re.match(r"[ \t]*", code[code.rfind("\n", 0, at) + 1 :])[0])
        m = re.compile(rf"^[ \t]{{0,{indent}}}end\b", re.M).search(code, at)
        return m.end() if m else len(code)
    open_ = code.find("{", at)
    stop = code.find("\n\n", at)
    if open_ < 0 or (0 <= stop < open_) or ";" in code[at:open_]:
        return code.find("\n", at) if code.find("\n", at) >= 0 else len(code)
    depth = 0
    for k in range(open_, len(code)):
        depth += {"{": 1, "}": -1}.get(code[k], 0)
        if not depth:
            return k + 1
    return len(code)


def _structural(text: str, found: Found, language: str) -> None:
    code = _blanked(text, language)
    family = _FAMILY.get(language, ["curly", "ends"])
    starts = [0, *[m.end() for m in re.finditer("\n", code)]]
    import bisect

    where = lambda at: (bisect.bisect_right(starts, at), at - starts[bisect.bisect_right(starts, at) - 1])
    defined: dict[int, tuple[str, str, int, int]] = {}
    for f in family:
        for kind, pattern in _PATTERNS[f]:
            for m in re.finditer(pattern, code, re.M):
                name = m[1].replace("::", ".").replace(":", ".")
                if name in _CONTROL:
                    continue
                defined.setdefault(m.start(1), (kind, name, m.start(), _block_end(code, m.end(), f in ("ends",)) if f != "lisp" else _paren_end(code, m.start())))
    if "curly" in family or "arrow" in family:
        for m in _METHOD.finditer(code):
            if m[1] not in _CONTROL:
                defined.setdefault(m.start(1), ("method", m[1], m.start(1), _block_end(code, m.end() - 1, False)))
    spans = sorted((at, end, kind, name) for kind, name, at, end in defined.values())
    stack: list[tuple[int, str, str]] = []
    owners: list[tuple[int, int, str]] = []
    for at, end, kind, name in spans:
        while stack and stack[-1][0] <= at:
            stack.pop()
        parent = stack[-1][1] if stack else found.module
        if kind == "function" and stack and stack[-1][2] in ("class", "interface", "struct", "enum"):
            kind = "method"
        fqn = f"{parent}.{name}"
        line, col = where(at)
        end_line, end_col = where(min(end, len(code)))
        public = not (name.startswith("_") or (language == "go" and not name[:1].isupper()) or re.search(r"\b(?:private|local)\b[^\n]*$", code[code.rfind("\n", 0, at) + 1 : at + 1]))
        found.symbol(kind, name.rpartition(".")[2], fqn, line, end_line, col, end_col, re.split(r"[{\n]", text[at:end], maxsplit=1)[0], None, "public" if public else "private", parent)
        stack.append((end, fqn, kind))
        owners.append((at, end, fqn))
    def owner(at: int) -> str:
        best = found.module
        for a, b, fqn in owners:
            if a > at:
                break
            if at < b:
                best = fqn
        return best

    for pattern in _IMPORT:
        for m in re.finditer(pattern, text, re.M):
            found.ref("imports", found.module, m[1].replace("::", "."), *where(m.start(1)))
    for k, pattern in enumerate(_INHERITS):
        for m in re.finditer(pattern, code):
            child, base = (m[2], m[1]) if k else (m[1], m[2])
            found.ref("inherits", f"{found.module}.{child}", base.replace("::", "."), *where(m.start()))
    names = {a for a in defined}
    call = r"\(\s*([A-Za-z_][\w.*+!?<>=/-]*)" if language == "clojure" else rf"(?<![\w$.])((?:{_NAME}(?:\.|::|->))*{_NAME}!?)\s*\("
    for m in re.finditer(call, code):
        name = re.sub(r"::|->", ".", m[1]).rstrip("!")
        if m.start(1) in names or name.rpartition(".")[2] in _NOT_CALLS or name.rpartition(".")[0] in _NOT_CALLS - {"this", "self", "super"} and "." in name:
            continue
        if re.match(r"(?:this|self|super|cls)\.", name):
            name = name.rpartition(".")[2]
        if not any(at == m.start(1) + len(m[1]) - len(name) for at in names):
            found.ref("calls", owner(m.start()), name, *where(m.start(1)))


def _paren_end(code: str, at: int) -> int:
    depth = 0
    for k in range(at, len(code)):
        depth += {"(": 1, ")": -1}.get(code[k], 0)
        if not depth:
            return k + 1
    return len(code)


PARSERS: dict[str, Callable[[str, Found], None]] = {"python": _python, "html": _html, "css": _css, "scss": _css, "markdown": _markdown, "json": _json, "toml": _toml, "yaml": _yaml, "terraform": _terraform}


def register(language: str, parser: Callable[[str, Found], None]) -> None:
    """Adds or replaces the parser of a language; it must be importable on executors."""
    PARSERS[language] = parser


def module_name(path: str) -> str:
    return re.sub(r"\.__init__$", "", re.sub(r"\.[^./]*$", "", path).replace("/", "."))


def extract_one(path: str, language: str, text: str) -> list[dict]:
    """All rows of one file; the file itself is the last symbol."""
    found = Found(module_name(path))
    try:
        if language in PARSERS:
            PARSERS[language](text, found)
        else:
            _structural(text, found, language)
    except Exception as problem:  # noqa: BLE001 - any parser's failure is that file's
        found.rows = [{"record": "failed", "reason": f"{type(problem).__name__}: {problem}"[:300]}]
    name = path.rpartition("/")[2]
    found.symbol("file", name, path, 1, text.count("\n") + 1)
    return [r | {"path": path} for r in found.rows]


def extract(files: DataFrame) -> DataFrame:
    """Symbols (record sym), references (ref) and failures of files (path, language, text); a null text is empty.

    The text ends here: only the rows found leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, language, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows += extract_one(path or "", language or "", text or "")
            for k in range(0, max(1, len(rows)), 20_000):
                some = rows[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in some], pa.int32() if f in _INTS else pa.string()) for f in _FIELDS], names=_FIELDS)

    return files.select("path", "language", "text").mapInArrow(run, SCHEMA)
