"""Source files to chunks, symbols and calls, in one pass over each file.

Python is read with the standard library's parser.  JavaScript, TypeScript, Go, Rust and
Java go through a light lexer that finds definitions by pattern and their ends by
brackets (strings and comments are skipped), which is shallower than a grammar.  HTML
and CSS are one chunk a file.  A file that can't be parsed gives one file chunk.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import SUFFIX_LANGUAGE

SPLIT_METHODS = 8
PARAMETER = "struct<name: string, type_annotation: string, default_value: string, is_variadic: boolean, is_keyword_only: boolean, is_variadic_keyword: boolean>"
CHUNK = "id string, content string, file_path string, language string, chunk_type string, symbol_name string, parent_symbol string, start_line int, end_line int, tags array<string>, docstring string"
SYMBOL = f"qualified_name string, name string, symbol_type string, file_path string, line_number int, signature string, return_type string, parameters array<{PARAMETER}>, base_classes array<string>, implemented_interfaces array<string>, decorators array<string>, class_methods array<string>"
CALL = "caller string, callee string, call_site string, call_type string, context string, condition string, in_loop boolean"

_TAGS: dict[str, list[tuple[str, str]]] = {
    "python": [("decorator", r"@\w+"), ("async", r"\basync\b"), ("classmethod", r"@\s*classmethod"), ("staticmethod", r"@\s*staticmethod"), ("property", r"@\s*property"), ("abstractmethod", r"@\s*abstractmethod"), ("generator", r"\byield\b"), ("type_hint", r":\s*\w+\s*=|->\s*\w+")],
    "typescript": [("decorator", r"@\w+"), ("async", r"\basync\b"), ("export", r"\bexport\b"), ("generic", r"<\w+>"), ("interface", r"\binterface\b"), ("abstract", r"\babstract\b")],
    "javascript": [("decorator", r"@\w+"), ("async", r"\basync\b"), ("export", r"\bexport\b"), ("generator", r"\byield\b"), ("default", r"\bdefault\b")],
    "go": [("export", r"\bfunc\s+[A-Z]"), ("goroutine", r"\bgo\s+\w+"), ("defer", r"\bdefer\b"), ("interface", r"\binterface\b"), ("pointer", r"\*\w+")],
    "rust": [("async", r"\basync\b"), ("unsafe", r"\bunsafe\b"), ("pub", r"\bpub\b"), ("trait", r"\btrait\b"), ("macro", r"macro_rules!"), ("lifetime", r"'\w+")],
    "java": [("annotation", r"@\w+"), ("abstract", r"\babstract\b"), ("synchronized", r"\bsynchronized\b"), ("native", r"\bnative\b"), ("generic", r"<\w+>"), ("interface", r"\binterface\b")],
}


def tags_of(c: dict[str, Any]) -> list[str]:
    out = [t for t, p in _TAGS.get(c["language"], []) if re.search(p, c["content"])]
    name = c["symbol_name"] or ""
    if c["docstring"]:
        out.append("documented")
    head = c["content"].lower()[:80].split("(")[0]
    if (name.startswith("test") or "test" in head) and ("test" in name.lower() or "test" in c["file_path"].lower()):
        out.append("test")
    if re.search(r"async[ \t]", c["content"]) and "async" not in out:
        out.append("async")
    if name and "export" not in out and ((c["language"] == "python" and not name.startswith("_")) or (c["language"] == "go" and name[:1].isupper())):
        out.append("exported")
    return out


def chunk(path: str, language: str, lines: list[str], kind: str, name: str | None, start: int, end: int, parent: str | None = None, doc: str | None = None, content: str | None = None) -> dict[str, Any]:
    c = {"id": f"{path}#{name}@{start}-{end}", "content": content if content is not None else "\n".join(lines[start - 1 : end]), "file_path": path, "language": language, "chunk_type": kind, "symbol_name": name, "parent_symbol": parent, "start_line": start, "end_line": end, "docstring": doc}
    return {**c, "tags": tags_of(c)}


def language_of(path: str) -> str:
    return SUFFIX_LANGUAGE.get(path.rpartition(".")[2].lower(), "unknown")


def module_of(path: str) -> str:
    return re.sub(r"[/\\]+", ".", re.sub(r"^[./\\]+", "", re.sub(r"\.[^./\\]+$", "", path)))


# -- Python -------------------------------------------------------------------------


def _start(n: ast.AST) -> int:
    return min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))])


_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def _params(a: ast.arguments) -> list[dict[str, Any]]:
    text = lambda x: ast.unparse(x) if x is not None else None
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    row = lambda x, d=None, v=False, k=False, kv=False: {"name": x.arg, "type_annotation": text(x.annotation), "default_value": text(d), "is_variadic": v, "is_keyword_only": k, "is_variadic_keyword": kv}
    out = [row(x, d) for x, d in zip(plain, defaults)]
    out += [row(a.vararg, v=True)] if a.vararg else []
    out += [row(x, d, k=True) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    return out + ([row(a.kwarg, kv=True)] if a.kwarg else [])


def _python_chunks(path: str, lines: list[str], tree: ast.Module) -> Iterator[dict[str, Any]]:
    rest = [n for n in tree.body if not isinstance(n, (*_DEF, ast.ClassDef))]
    if rest:
        text = "\n".join("\n".join(lines[n.lineno - 1 : n.end_lineno]) for n in rest)
        yield chunk(path, "python", lines, "file", "<module>", rest[0].lineno, rest[-1].end_lineno, doc=ast.get_docstring(tree), content=text)
    for n in tree.body:
        if isinstance(n, _DEF):
            yield chunk(path, "python", lines, "function", n.name, _start(n), n.end_lineno, doc=ast.get_docstring(n))
        elif isinstance(n, ast.ClassDef):
            methods = [m for m in n.body if isinstance(m, _DEF)]
            if len(methods) <= SPLIT_METHODS:
                yield chunk(path, "python", lines, "class", n.name, _start(n), n.end_lineno, doc=ast.get_docstring(n))
                continue
            init = next((m for m in methods if m.name == "__init__"), None)
            end = init.end_lineno if init else _start(methods[0]) - 1
            yield chunk(path, "python", lines, "class", n.name, _start(n), max(end, n.lineno), doc=ast.get_docstring(n))
            for m in methods:
                if m is not init:
                    yield chunk(path, "python", lines, "function", m.name, _start(m), m.end_lineno, n.name, ast.get_docstring(m))


class _Walk(ast.NodeVisitor):
    """Symbols and raw calls, with the scopes that they stand in."""

    def __init__(self, path: str, lines: list[str]):
        self.path, self.lines, self.scope = path, lines, [module_of(path)]
        self.owners: list[str] = []
        self.symbols: dict[str, dict[str, Any]] = {}
        self.calls: list[dict[str, Any]] = []
        self.typed: dict[str, str] = {}
        self.inside: list[str] = []
        self.conditions: list[str] = []

    def _symbol(self, n: Any, kind: str, signature: str, returns: str | None, params: list, bases: list[str], methods: list[str]) -> str:
        name = ".".join([*self.scope, n.name])
        self.symbols[name] = {"qualified_name": name, "name": n.name, "symbol_type": kind, "file_path": self.path, "line_number": n.lineno, "signature": signature, "return_type": returns, "parameters": params, "base_classes": bases, "implemented_interfaces": [], "decorators": [ast.unparse(d) for d in n.decorator_list], "class_methods": methods}
        return name

    def visit_ClassDef(self, n: ast.ClassDef) -> None:
        bases = [ast.unparse(b) for b in n.bases if isinstance(b, (ast.Name, ast.Attribute, ast.Subscript))]
        self._symbol(n, "class", f"class {n.name}" + (f"({', '.join(bases)})" if bases else ""), None, [], bases, [m.name for m in n.body if isinstance(m, _DEF)])
        self._in(n, n.name, True)

    def visit_FunctionDef(self, n: Any) -> None:
        returns = ast.unparse(n.returns) if n.returns else None
        self._symbol(n, "function", f"def {n.name}({ast.unparse(n.args)})" + (f" -> {returns}" if returns else ""), returns, _params(n.args), [], [])
        self._in(n, n.name, False)

    visit_AsyncFunctionDef = visit_FunctionDef

    def _in(self, n: Any, name: str, owner: bool) -> None:
        kept, self.inside, cond, self.conditions = self.inside, [], self.conditions, []
        self.scope.append(name)
        self.owners += [name] * owner
        for x in n.body:
            self.visit(x)
        self.owners = self.owners[: len(self.owners) - owner]
        self.scope.pop()
        self.inside, self.conditions = kept, cond

    def _block(self, mark: str, n: ast.AST, condition: str | None = None) -> None:
        self.inside.append(mark)
        self.conditions += [condition] if condition else []
        self.generic_visit(n)
        if condition:
            self.conditions.pop()
        self.inside.pop()

    def visit_If(self, n: ast.If) -> None:
        self._block("if", n, ast.unparse(n.test))

    def visit_For(self, n: Any) -> None:
        self._block("loop", n)

    visit_AsyncFor = visit_While = visit_For

    def visit_Await(self, n: ast.Await) -> None:
        self._block("await", n)

    def visit_Assign(self, n: ast.Assign) -> None:
        t = n.targets[0]
        if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" and isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name):
            self.typed[t.attr] = n.value.func.id
        self.generic_visit(n)

    def visit_Call(self, n: ast.Call) -> None:
        name = ast.unparse(n.func) if isinstance(n.func, (ast.Name, ast.Attribute)) else None
        if name and re.fullmatch(r"[\w.]+", name):
            kind = "async" if "await" in self.inside else "conditional" if "if" in self.inside else "dynamic" if name in ("getattr", "eval", "exec", "setattr") else "direct"
            self.calls.append({"caller": ".".join(self.scope), "raw": name, "owner": self.owners[-1] if self.owners else None, "call_site": f"{self.path}:{n.lineno}", "call_type": kind, "context": self.lines[n.lineno - 1].strip() if n.lineno <= len(self.lines) else None, "condition": self.conditions[-1] if self.conditions else None, "in_loop": "loop" in self.inside})
        self.generic_visit(n)

    def resolved(self) -> list[dict[str, Any]]:
        """Calls with the names of this file resolved: own methods, typed attributes, same module; others stay as written."""
        by_name: dict[str, str] = {}
        for q in self.symbols:
            by_name.setdefault(q.rpartition(".")[2], q)
        module, out = module_of(self.path), []
        for c in self.calls:
            raw, parts = c.pop("raw"), None
            owner = c.pop("owner")
            parts = raw.split(".")
            own = parts[0] == "self"
            tries = [f"{module}.{raw}"]
            if own and len(parts) == 3 and parts[1] in self.typed:
                tries.append(f"{module}.{self.typed[parts[1]]}.{parts[2]}")
            if own and len(parts) == 2 and owner:
                tries.append(f"{module}.{owner}.{parts[1]}")
            found = next((t for t in tries if t in self.symbols), None) or (by_name.get(parts[-1]) if own or len(parts) == 1 else None)
            out.append({"callee": found or raw, **c})
        return out


# -- other languages -------------------------------------------------------------------

_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`", re.S)
_JS = [
    ("class", re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)(?:\s+extends\s+(?P<base>[\w.]+))?(?:\s+implements\s+(?P<impl>[\w., ]+))?", re.M)),
    ("interface", re.compile(r"^[ \t]*(?:export\s+)?interface\s+(?P<name>\w+)", re.M)),
    ("function", re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<params>[^)]*)\)(?:\s*:\s*(?P<ret>[\w<>\[\]. |]+?))?(?=\s*\{)", re.M)),
    ("function", re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?\((?P<params>[^)]*)\)(?:\s*:\s*(?P<ret>[\w<>\[\]. |]+?))?\s*=>", re.M)),
    ("method", re.compile(r"^[ \t]+(?:(?:public|private|protected|static|readonly|async|get|set)\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)\w+)\s*\((?P<params>[^)]*)\)(?:\s*:\s*(?P<ret>[\w<>\[\]. |]+?))?\s*(?=\{)", re.M)),
]
RULES: dict[str, list[tuple[str, re.Pattern[str]]]] = {
    "javascript": _JS,
    "typescript": _JS,
    "go": [
        ("interface", re.compile(r"^type\s+(?P<name>\w+)\s+interface\b", re.M)),
        ("class", re.compile(r"^type\s+(?P<name>\w+)\s+struct\b", re.M)),
        ("function", re.compile(r"^func\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?P<params>[^)]*)\)\s*(?P<ret>[^{\n]*?)\s*(?=\{)", re.M)),
    ],
    "rust": [
        ("class", re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)", re.M)),
        ("interface", re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)", re.M)),
        ("impl", re.compile(r"^[ \t]*impl(?:<[^>]*>)?\s+(?:(?P<impl>[\w:<>]+)\s+for\s+)?(?P<name>\w+)", re.M)),
        ("function", re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<params>[^)]*)\)(?:\s*->\s*(?P<ret>[^{\n]+?))?\s*(?=\{)", re.M)),
    ],
    "java": [
        ("class", re.compile(r"^[ \t]*(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|enum|record)\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s+extends\s+(?P<base>[\w.<>]+))?(?:\s+implements\s+(?P<impl>[\w., <>]+))?", re.M)),
        ("interface", re.compile(r"^[ \t]*(?:(?:public|private|protected|static)\s+)*interface\s+(?P<name>\w+)", re.M)),
        ("method", re.compile(r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|native)\s+)*(?:<[^>]*>\s+)?(?P<ret>[\w<>\[\].]+)\s+(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b)\w+)\s*\((?P<params>[^)]*)\)[^;{]*(?=\{)", re.M)),
    ],
}
_CALL = re.compile(r"(?<![\w.])((?:\w+(?:\.|::))*\w+)\s*\(")
_WORDS = set("if for while switch catch return function fn func match new super class await typeof sizeof".split())


def _blank(text: str) -> str:
    """The text with strings and comments as spaces, of the same length."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _end(text: str, at: int) -> int:
    """Where the block that opens after ``at`` closes; the line's end if none opens."""
    depth = 0
    for k in range(at, len(text)):
        c = text[k]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return k + 1
        elif c == ";" and not depth:
            return k + 1
    return len(text)


def split_params(text: str) -> list[str]:
    out, depth, held = [], 0, ""
    for c in text:
        if c == "," and not depth:
            out.append(held.strip())
            held = ""
            continue
        depth += (c in "([{<") - (c in ")]}>")
        held += c
    return [p for p in [*out, held.strip()] if p]


def parameter(text: str, language: str) -> dict[str, Any]:
    left, _, default = text.partition("=")
    left = left.strip()
    if language in ("javascript", "typescript", "rust"):
        name, _, kind = left.partition(":")
    elif language == "go":
        name, _, kind = left.partition(" ")
    else:
        kind, _, name = left.rpartition(" ")
    return {"name": name.strip().lstrip("&").replace("mut ", "").replace("...", "").rstrip("?"), "type_annotation": kind.strip() or None, "default_value": default.strip() or None, "is_variadic": "..." in text, "is_keyword_only": False, "is_variadic_keyword": False}


def parse_braces(path: str, language: str, text: str) -> tuple[list[dict], list[dict], list[dict]]:
    code, lines, module = _blank(text), text.split("\n"), module_of(path)
    line = lambda at: text.count("\n", 0, at) + 1
    found = []
    taken: set[int] = set()
    for kind, pattern in RULES[language]:
        for m in pattern.finditer(code):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            if at not in taken:
                taken.add(at)
                found.append((at, _end(code, m.end()), kind, m))
    found.sort(key=lambda f: (f[0], -f[1]))
    chunks, symbols, spans = [], {}, []
    for at, end, kind, m in found:
        g = m.groupdict()
        around = [f for f in found if f[0] < at and f[1] >= end and f[2] in ("class", "impl", "interface")]
        if kind == "method" and not around:
            continue
        parent = around[-1][3]["name"] if around else None
        if language == "go" and g.get("recv"):
            parent = g["recv"].split()[-1].lstrip("*")
        name, a, b = g["name"], line(at), line(max(at, end - 1))
        sort = "class" if kind in ("class", "impl", "interface") else "function"
        if not (language in ("go", "rust") and kind in ("class", "interface")):
            chunks.append(chunk(path, language, lines, sort, name, a, b, parent if sort == "function" else None))
        params = [parameter(p, language) for p in split_params(text[m.start("params") : m.end("params")])] if g.get("params") else []
        q = ".".join(x for x in (module, parent if sort == "function" else None, name) if x)
        if kind != "impl" and q not in symbols:
            methods = [f[3]["name"] for f in found if at < f[0] and f[1] <= end and f[2] in ("method", "function")]
            head = re.sub(r"\s+", " ", text[at : m.end()]).strip()
            impl = [x.strip() for x in (g.get("impl") or "").split(",") if x.strip()]
            symbols[q] = {"qualified_name": q, "name": name, "symbol_type": "interface" if kind == "interface" else sort, "file_path": path, "line_number": a, "signature": head, "return_type": (g.get("ret") or "").strip() or None, "parameters": params, "base_classes": [g["base"]] if g.get("base") else [], "implemented_interfaces": impl, "decorators": [], "class_methods": methods if sort == "class" else []}
        if sort == "function":
            spans.append((at, end, q, m.end()))
    covered = [False] * (len(lines) + 1)
    for c in chunks:
        for k in range(c["start_line"], c["end_line"] + 1):
            covered[k] = True
    rest = [k for k in range(1, len(lines) + 1) if not covered[k] and lines[k - 1].strip()]
    if rest:
        chunks.insert(0, chunk(path, language, lines, "file", "<module>", rest[0], rest[-1], content="\n".join(lines[k - 1] for k in rest)))
    names: dict[str, str] = {}
    for q in symbols:
        names.setdefault(q.rpartition(".")[2], q)
    calls = []
    for m in _CALL.finditer(code):
        raw = m[1]
        last = re.split(r"\.|::", raw)[-1]
        if last in _WORDS or any(at <= m.start() < body for at, _, _, body in spans):
            continue
        inside = [s for s in spans if s[0] <= m.start() < s[1]]
        before = code[inside[-1][0] if inside else 0 : m.start()]
        open_ = re.findall(r"\b(if|for|while|loop)\b[^{}]*\{", before[before.rfind("}") + 1 :])
        kind = "conditional" if "if" in open_ else "async" if re.search(r"await\s+$", code[: m.start()]) else "direct"
        calls.append({"callee": symbols[raw]["qualified_name"] if raw in symbols else names.get(last, raw), "caller": inside[-1][2] if inside else module, "call_site": f"{path}:{line(m.start())}", "call_type": kind, "context": lines[line(m.start()) - 1].strip(), "condition": None, "in_loop": any(w in open_ for w in ("for", "while", "loop"))})
    return chunks, list(symbols.values()), calls


def parse_text(path: str, text: str) -> tuple[list[dict], list[dict], list[dict]]:
    """(chunks, symbols, calls) of one file."""
    language = language_of(path)
    lines = text.split("\n")
    if not text.strip():
        return [], [], []
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return [chunk(path, language, lines, "file", "<module>", 1, len(lines))], [], []
        w = _Walk(path, lines)
        w.visit(tree)
        return list(_python_chunks(path, lines, tree)), list(w.symbols.values()), w.resolved()
    if language in RULES:
        return parse_braces(path, language, text)
    if language in ("html", "css"):
        m = re.search(r"(?is)<title\b[^>]*>(.*?)</title\s*>", text) if language == "html" else re.search(r"(?s)/\*(.*?)\*/", text)
        c = chunk(path, language, lines, "file", path.rpartition("/")[2], 1, len(lines), doc=m[1].strip() if m else None)
        return [{**c, "tags": [language, "frontend", "asset"]}], [], []
    return [], [], []


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, symbols, calls) of a table (path, content).  Each file is parsed once; the three are projections of one tagged table."""
    import json

    chunk_type = T._parse_datatype_string(CHUNK)  # noqa: SLF001
    symbol_type, call_type = T._parse_datatype_string(SYMBOL), T._parse_datatype_string(CALL)  # noqa: SLF001

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                for kind, rows in zip(("chunk", "symbol", "call"), parse_text(path, content or "")):
                    out += [(kind, json.dumps(r)) for r in rows]
            yield pd.DataFrame(out, columns=["kind", "row"])

    tagged = files.select("path", "content").mapInPandas(run, "kind string, row string")
    get = lambda kind, shape: tagged.filter(F.col("kind") == kind).select(F.from_json("row", shape).alias("r")).select("r.*")
    return get("chunk", chunk_type), get("symbol", symbol_type), get("call", call_type)
