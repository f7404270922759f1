"""One file in, its nodes, edges, re-exports, named imports and aliases out. Top-level declarations only.

Python is read with its own parser, the other languages with scanners over blanked source (sources.scan).
Accepted gaps: conditional compilation, macros that make items, and regular-expression literals with quotes.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from depweave.sources.scan import Code, split_top


@dataclass
class Parsed:
    """Nodes (id, kind, line); edges (src, dst, kind, line, confidence, confidence_kind); the rest as named."""

    nodes: list[tuple] = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)
    reexports: list[dict] = field(default_factory=list)
    named_imports: list[dict] = field(default_factory=list)
    use_aliases: dict[str, str] = field(default_factory=dict)

    def link(self, src: str, dst: str, kind: str, line: int, confidence: float = 1.0, how: str = "Extracted") -> None:
        self.edges.append((src, dst, kind, line, confidence, how))

    def define(self, module: str, name: str, kind: str, line: int) -> None:
        self.nodes.append((f"{module}.{name}", kind, line))
        self.link(module, f"{module}.{name}", "Defines", line)


def parse(language: str, module: str, data: bytes) -> Parsed:
    out = Parsed()
    out.nodes.append((module, "Module", 1))
    {"Python": _python, "TypeScript": _typescript, "Go": _go, "Rust": _rust, "Php": _php}[language](module, data, out)
    return out


# --- Python ------------------------------------------------------------------------------------------------------


def _python(module: str, data: bytes, out: Parsed) -> None:
    """Imports, functions and classes of the top level, and bare calls of imported names inside those bodies."""
    try:
        tree = ast.parse(data)
    except (SyntaxError, ValueError):
        return
    known: dict[str, str] = {}
    for x in tree.body:
        if isinstance(x, ast.Import):
            for a in x.names:
                out.link(module, a.name, "Imports", x.lineno)
                known[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(x, ast.ImportFrom):
            source = "." * x.level + (x.module or "")
            out.link(module, source, "Imports", x.lineno)
            for a in x.names:
                if a.name != "*":
                    out.link(module, f"{source}.{a.name}", "Calls", a.lineno)
                    known[a.asname or a.name] = f"{source}.{a.name}"
    for x in tree.body:
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.define(module, x.name, "Class" if isinstance(x, ast.ClassDef) else "Function", x.lineno)
        for body in (x.body if hasattr(x, "body") and isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else [x]):
            for call in ast.walk(body):
                if isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id in known:
                    out.link(module, known[call.func.id], "Calls", call.lineno, 0.9)


# --- TypeScript --------------------------------------------------------------------------------------------------

_TS_IMPORT = re.compile(r"\bimport\b\s*(type\b\s*(?!from\b|,))?([^;'\"`()=]*?\bfrom\b\s*)?(['\"])")
_TS_REEXPORT = re.compile(r"\bexport\b\s*(?:type\b\s*)?(\*(?:\s*as\s+[\w$]+)?|\{[^}]*\})\s*from\s*(['\"])")
_TS_ITEM = re.compile(r"(?:\bexport\s+)?(?:\bdefault\s+)?(?:\b(?:async|abstract|declare)\s+)*\b(function\s*\*?|class)\s+([\w$]+)")
_TS_REQUIRE = re.compile(r"(?:\b(?:const|let|var)\s+([\w$]+|\{[^}]*\}|\[[^\]]*\])\s*(?::[^=]+)?=\s*)?\brequire\s*\(\s*(['\"])")
_TS_CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\s*\(")


def _specs(text: str) -> list[tuple[str, str]]:
    """(upstream, local) of a list in braces."""
    out = []
    for _, part in split_top(text.strip().strip("{}")):
        words = re.sub(r"^\s*type\s+(?=[\w$])", "", part).split()
        if words:
            out.append((words[0], words[2] if len(words) == 3 and words[1] == "as" else words[0]))
    return out


def _typescript(module: str, data: bytes, out: Parsed) -> None:
    code = Code.of(data, "TypeScript")
    known: set[str] = set()
    skip: list[tuple[int, int]] = []
    for m in _TS_IMPORT.finditer(code.bare):
        if code.depth(m.start()) or not (target := code.quoted(m.end() - 1)):
            continue
        line, clause = code.line(m.start()), re.sub(r"\bfrom\s*$", "", m[2] or "").strip()
        skip.append((m.start(), m.end()))
        names, wide = [], False
        for _, part in split_top(clause):
            part = part.strip()
            if part.startswith("{"):
                pairs = _specs(part)
                names += [a for a, _ in pairs]
                known |= {b for _, b in pairs}
            elif part.startswith("*"):
                wide = True
                known.add(part.split()[-1])
            else:
                names.append("default")
                known.add(part)
        if wide or not names:
            out.link(module, target, "Imports", line)
        else:
            out.named_imports.append({"from_module": module, "raw_target": target, "line": line, "specs": names, "is_type_only": bool(m[1])})
    for m in _TS_REEXPORT.finditer(code.bare):
        if code.depth(m.start()) or not (target := code.quoted(m.end() - 1)):
            continue
        line, star = code.line(m.start()), m[1].startswith("*")
        out.link(module, target, "Imports", line)
        pairs = [] if star else _specs(m[1])
        for _, local in pairs:
            out.define(module, local, "Function", line)
        if star or pairs:
            out.reexports.append({"from_module": module, "raw_target": target, "line": line, "is_star": star, "specs": pairs})
    for m in _TS_ITEM.finditer(code.bare):
        if not code.depth(m.start(1)):
            out.define(module, m[2], "Class" if m[1] == "class" else "Function", code.line(m.start(1)))
            skip.append((m.start(), m.end() + 1))
    for m in _TS_REQUIRE.finditer(code.bare):
        if target := code.quoted(m.end() - 1):
            out.link(module, target, "Imports", code.line(m.start()))
            if m[1] and not code.depth(m.start()):
                known |= {x.split(":")[-1].strip() for x in re.split(r"[,{}\[\]]", m[1]) if x.strip()}
    for m in _TS_CALL.finditer(code.bare):
        if m[1] in known and not any(a <= m.start() < b for a, b in skip):
            out.link(module, m[1], "Calls", code.line(m.start()), 0.9)


# --- Go ----------------------------------------------------------------------------------------------------------

_GO_IMPORT = re.compile(r"^\s*import\b\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?([\"`]))", re.M)
_GO_FUNC = re.compile(r"^func\s*(\([^)]*\))?\s*([A-Za-z_]\w*)", re.M)
_GO_TYPE = re.compile(r"^type\b\s*(\(|([A-Za-z_]\w*)(?:\[[^\]]*\])?\s*=?\s*(\w+)?)", re.M)
_GO_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\(")
_GO_WORDS = frozenset("if for switch select return func go defer range case else var const type import package interface struct map chan".split())


def _go(module: str, data: bytes, out: Parsed) -> None:
    code = Code.of(data, "Go")
    for m in _GO_IMPORT.finditer(code.bare):
        first, last = (m.start(1), m.end(1)) if m[1] is not None else (m.start(2), m.end(2))
        for q in re.finditer(r"([\"`])[^\"`]*\1" if m[1] is not None else r"[\"`]", code.bare[first:last]):
            at = first + q.start()
            if target := code.quoted(at):
                out.link(module, target, "Imports", code.line(at))
    bodies = []
    for m in _GO_FUNC.finditer(code.bare):
        if code.depth(m.start()):
            continue
        name, kind = m[2], "Function"
        if m[1]:
            words = re.findall(r"[A-Za-z_]\w*", re.sub(r"\[[^\]]*\]", "", m[1]))
            name, kind = f"{words[-1]}.{m[2]}" if words else m[2], "Method"
        out.define(module, name, kind, code.line(m.start()))
        bodies.append(code.block(code.close(code.bare.index("(", m.end())) if "(" in code.bare[m.end() :] else m.end()))
    for m in _GO_TYPE.finditer(code.bare):
        if code.depth(m.start()):
            continue
        if m[1] == "(":
            at = m.start(1)
            inner = code.bare[at + 1 : code.close(at)]
            base = code.depth(at)
            for t in re.finditer(r"^[ \t]*([A-Za-z_]\w*)(?:\[[^\]]*\])?[ \t]*=?[ \t]*(\w+)?", inner, re.M):
                if code.depth(at + 1 + t.start(1)) == base:
                    out.define(module, t[1], "Trait" if t[2] == "interface" else "Class", code.line(at + 1 + t.start(1)))
        elif m[2]:
            out.define(module, m[2], "Trait" if m[3] == "interface" else "Class", code.line(m.start()))
    for a, b in bodies:
        for c in _GO_CALL.finditer(code.bare, a, b):
            if c[1] not in _GO_WORDS:
                out.link(module, c[1], "Calls", code.line(c.start()), 0.7, "Inferred")


# --- Rust --------------------------------------------------------------------------------------------------------

_RS_ITEM = re.compile(r"(?:^|(?<=[;}\s]))(pub(?:\s*\([^)]*\))?\s+)?(?:(?:unsafe|async|const|extern(?:\s*\"[^\"]*\")?|default)\s+)*\b(use|mod|fn|struct|enum|trait|type|static|const|impl|union)\b\s*", re.M)
_RS_CALL = re.compile(r"(?<![\w.:!])((?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)(?:::<[^;{}()]*>)?\s*(!?)[ ]*[(\[{]")
_RS_WORDS = frozenset("if while for match return loop fn in let mut move ref else as where impl struct enum union trait mod use pub unsafe dyn box await async".split())


def _use_tree(text: str, prefix: str = "") -> list[tuple[str, str | None, bool]]:
    """(path, alias, wildcard) of a use tree, groups flattened."""
    text = text.strip()
    if (at := text.find("{")) >= 0:
        head = text[:at].strip().removesuffix("::").strip()
        inner = text[at + 1 : text.rfind("}")]
        base = "::".join(x for x in (prefix, head) if x)
        return [y for _, x in split_top(inner) for y in _use_tree(x, base)]
    path, _, alias = (x.strip() for x in re.sub(r"\s+as\s+", " as ", text).partition(" as "))
    path = re.sub(r"\s+", "", path)
    full = "::".join(x for x in (prefix, path) if x)
    if full.endswith("*"):
        return [(full.removesuffix("*").removesuffix("::"), None, True)]
    return [(full, alias or None, False)]


def _rust_use(module: str, text: str, public: bool, line: int, out: Parsed) -> None:
    groups: dict[str, list[tuple[str, str]]] = {}
    for path, alias, wild in _use_tree(text):
        if not path:
            continue
        out.link(module, path, "Imports", line)
        head, _, leaf = path.rpartition("::")
        if wild:
            continue
        short = alias or (leaf if leaf != "self" else head.rpartition("::")[2])
        if short and short != "_":
            out.use_aliases.setdefault(short, head if leaf == "self" and head else path)
        if public and head:
            groups.setdefault(head, []).append((leaf, alias or leaf))
    for head, specs in groups.items():
        out.reexports.append({"from_module": module, "raw_target": head, "line": line, "is_star": False, "specs": specs})


def _rust(module: str, data: bytes, out: Parsed) -> None:
    code = Code.of(data, "Rust")
    bare, bodies = code.bare, []
    for m in _RS_ITEM.finditer(bare):
        word, at, line = m[2], m.end(), code.line(m.start(2))
        if word == "use":
            end = bare.find(";", at)
            if end > 0:
                _rust_use(module, bare[at:end], bool(m[1]) and not code.depth(m.start()), line, out)
            continue
        if code.depth(m.start(2)):
            continue
        name = re.compile(r"(?:mut\s+)?([A-Za-z_]\w*)").match(bare, at)
        if word == "impl":
            _rust_impl(module, code, at, out, bodies)
        elif not name or name[1] == "_":
            continue
        elif word == "mod":
            if re.compile(r"\s*;").match(bare, name.end()):
                out.link(module, name[1], "Imports", line)
        elif word == "fn":
            out.define(module, name[1], "Function", line)
            bodies.append(code.block(name.end()))
        elif word == "const" and bare[at : at + 3] == "fn ":
            continue
        else:
            out.define(module, name[1], {"enum": "Enum", "trait": "Trait"}.get(word, "Class"), line)
            if word == "enum":
                a, b = code.block(name.end())
                for i, part in split_top(bare[a:b]):
                    if v := re.match(r"\s*(?:#\[[^\]]*\]\s*)*([A-Za-z_]\w*)", part):
                        out.define(module, f"{name[1]}.{v[1]}", "Class", code.line(a + i + v.start(1)))
    for a, b in bodies:
        text = bare[a:b]
        local = set(re.findall(r"\blet\s+(?:mut\s+)?([a-z_]\w*)", text)) | set(re.findall(r"\bfn\s+([A-Za-z_]\w*)", text))
        for c in _RS_CALL.finditer(bare, a, b):
            name, line = c[1], code.line(c.start())
            if c[2]:
                if "::" not in name and name not in _RS_WORDS:
                    out.link(module, name, "Calls", line, 0.6, "Inferred")
            elif bare[c.end() - 1] == "(" and name not in _RS_WORDS and ("::" in name or name not in local) and not re.search(r"\bfn\s+$", bare[max(a, c.start() - 8) : c.start()]):
                out.link(module, name, "Calls", line, 0.7, "Inferred")


def _rust_impl(module: str, code: Code, at: int, out: Parsed, bodies: list) -> None:
    bare = code.bare
    if bare[at : at + 1] == "<":
        at = code.close(at) + 1
    a, b = code.block(at)
    head = re.split(r"\bwhere\b", bare[at : max(a - 1, at)])[0]
    target = re.split(r"\bfor\b", head)[-1]
    plain = re.sub(r"<.*", "", target, flags=re.S).strip().lstrip("&").strip()
    owner = re.findall(r"[A-Za-z_]\w*", plain)
    base = code.depth(a)
    for f in re.compile(r"\bfn\s+([A-Za-z_]\w*)").finditer(bare, a, b):
        if code.depth(f.start()) == base:
            out.define(module, f"{owner[-1]}.{f[1]}" if owner else f[1], "Method", code.line(f.start()))
            bodies.append(code.block(f.end()))


# --- PHP ---------------------------------------------------------------------------------------------------------

_PHP_USE = re.compile(r"^[ \t]*use\s+(?:(?:function|const)\s+)?([^;(]+);", re.M)
_PHP_ITEM = re.compile(r"(?:^|(?<=[;}\s]))(?:(?:abstract|final|readonly)\s+)*\b(class|interface|trait|enum|function)\s+&?([A-Za-z_]\w*)", re.M)
_PHP_CALL = re.compile(r"(?<![\w$>:\\])([A-Za-z_]\w*)\s*\(")
_PHP_WORDS = frozenset("if elseif while for foreach switch match return function fn array list isset unset empty echo print include require include_once require_once catch declare exit die new use static self parent and or xor".split())


def _php(module: str, data: bytes, out: Parsed) -> None:
    code = Code.of(data, "Php")
    bare = code.bare
    spaced = re.search(r"\bnamespace\s+[\w\\]+\s*\{", bare)
    base = 1 if spaced else 0
    for m in _PHP_USE.finditer(bare):
        if code.depth(m.start(1)) != base:
            continue
        line, text, prefix = code.line(m.start(1)), m[1], ""
        if "{" in text:
            prefix, _, text = text.partition("{")
            prefix, text = prefix.strip().strip("\\"), text.rpartition("}")[0]
        for _, part in split_top(text):
            name = re.split(r"\s+as\s+", re.sub(r"^\s*(?:function|const)\s+", "", part).strip())[0].strip().lstrip("\\")
            if name:
                symbol = (f"{prefix}\\{name}" if prefix else name).replace("\\", ".")
                out.link(module, symbol.rpartition(".")[0] or symbol, "Imports", line)
                out.link(module, symbol, "Calls", line)
    bodies = []
    for m in _PHP_ITEM.finditer(bare):
        if code.depth(m.start(1)) != base or re.search(r"\buse\s+$", bare[max(0, m.start(1) - 8) : m.start(1)]):
            continue
        kind = {"class": "Class", "interface": "Trait", "trait": "Trait", "enum": "Enum", "function": "Function"}[m[1]]
        out.define(module, m[2], kind, code.line(m.start(1)))
        a, b = code.block(m.end())
        bodies.append((a, b))
        if m[1] != "function":
            inner = code.depth(a)
            for f in re.compile(r"\bfunction\s+&?([A-Za-z_]\w*)").finditer(bare, a, b):
                if code.depth(f.start()) == inner:
                    out.define(module, f"{m[2]}.{f[1]}", "Method", code.line(f.start()))
    for a, b in bodies:
        for c in _PHP_CALL.finditer(bare, a, b):
            if c[1].lower() not in _PHP_WORDS and not re.search(r"\b(?:function|new)\s+&?$", bare[max(a, c.start() - 12) : c.start()]):
                out.link(module, c[1], "Calls", code.line(c.start()), 0.7, "Inferred")
