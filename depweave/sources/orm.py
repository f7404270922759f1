"""Contracts from TypeScript source: database tables built by column calls, and interfaces or object types."""

from __future__ import annotations

import json
import re

from depweave.sources.scan import Code, split_top

#: Column functions and the primitive they hold.
COLUMN_TYPES = {
    **dict.fromkeys(("text", "varchar", "char", "uuid", "citext", "time", "interval", "inet", "cidr", "macaddr"), "string"),
    **dict.fromkeys(("integer", "serial", "smallint", "smallserial", "bigint", "bigserial", "real", "doublePrecision", "numeric", "decimal", "int", "tinyint", "mediumint", "double", "float"), "number"),
    **dict.fromkeys(("boolean",), "boolean"),
    **dict.fromkeys(("timestamp", "date", "datetime"), "date"),
    **dict.fromkeys(("json", "jsonb"), "unknown"),
}
_PRIMITIVES = {"string": "string", "number": "number", "bigint": "number", "boolean": "boolean", "Date": "date", "unknown": "unknown", "any": "unknown"}


def primitive(value: str) -> dict:
    return {"kind": "primitive", "value": value}


def type_json(kind: dict) -> str:
    return json.dumps(kind, separators=(",", ":"), sort_keys=True)


def ts_type(text: str) -> tuple[dict, bool]:
    """(type, nullable) of an annotation; null and undefined members only make it nullable."""
    text = text.strip()
    while text.startswith("(") and text.endswith(")"):
        text = text[1:-1].strip()
    parts = [x.strip() for _, x in split_top(text, "|")]
    if len(parts) > 1:
        rest = [x for x in parts if x not in ("null", "undefined")]
        nullable = len(rest) < len(parts)
        if len(rest) == 1:
            return ts_type(rest[0])[0], nullable
        if rest and all(re.fullmatch(r"'[^']*'|\"[^\"]*\"", x) for x in rest):
            return primitive("string"), nullable
        return {"kind": "union", "value": [ts_type(x)[0] for x in rest]}, nullable
    if text.endswith("[]"):
        return {"kind": "array", "value": ts_type(text[:-2])[0]}, False
    if m := re.fullmatch(r"(?:Readonly)?Array<(.*)>", text, re.S):
        return {"kind": "array", "value": ts_type(m[1])[0]}, False
    if text in _PRIMITIVES:
        return primitive(_PRIMITIVES[text]), False
    if text in ("null", "undefined"):
        return primitive("unknown"), True
    if text[:1] in "'\"":
        return primitive("string"), False
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return primitive("number"), False
    if text in ("true", "false"):
        return primitive("boolean"), False
    if text.startswith("{"):
        return primitive("unknown"), False
    return {"kind": "named", "value": re.sub(r"<.*", "", text, flags=re.S)}, False


def _members(code: Code, a: int, b: int, text: str) -> list[dict]:
    out = []
    for i, part in split_top(code.bare[a:b], ";,\n"):
        if m := re.match(r"\s*(?:readonly\s+)?([A-Za-z_$][\w$]*|(['\"])[^'\"]*\2)\s*(\?)?\s*:\s*", part):
            at = a + i + m.start(1)
            name = text[at : at + len(m[1])].strip("'\"")
            kind, nullable = ts_type(text[a + i + m.end() : a + i + len(part)])
            out.append({"raw_name": name, "type": kind, "nullable": nullable or bool(m[3]), "line": code.line(at)})
    return out


def ts_contract(source: bytes | str, name: str) -> dict | None:
    """Fields of an exported interface or object type (intersections: the members of all object parts); relations are always empty."""
    code = Code.of(source, "TypeScript")
    m = re.search(rf"\b(interface|type)\s+{re.escape(name)}\b", code.bare)
    if not m:
        return None
    end = code.block(m.end())[1] if m[1] == "interface" else len(code.bare)
    fields, at = [], m.end()
    while 0 <= (at := code.bare.find("{", at)) < max(end, m.end() + 1):
        close = code.close(at)
        fields += _members(code, at + 1, close, code.text)
        at = close + 1
        if m[1] == "interface" or not re.match(r"\s*&", code.bare[at:]):
            break
    return {"name": name, "fields": fields, "relations": []}


def as_relations(contract: dict, known: set[str]) -> dict:
    """Fields whose type (or whose array's) is a known contract become relations: one, or many for arrays."""
    fields, relations = [], list(contract["relations"])
    for f in contract["fields"]:
        many = f["type"]["kind"] == "array"
        inner = f["type"]["value"] if many else f["type"]
        if inner["kind"] == "named" and inner["value"] in known:
            relations.append({"raw_name": f["raw_name"], "cardinality": "many" if many else "one", "target": inner["value"], "nullable": f["nullable"], "line": f["line"]})
        else:
            fields.append(f)
    return contract | {"fields": fields, "relations": relations}


def orm_contract(source: bytes | str, table: str) -> dict | None:
    """Columns of `const <table> = xTable('…', {...})` (or schema.table) and the relations declared for it.

    A column is named by its property; it is nullable unless .notNull() is called, primary keys too.
    """
    code = Code.of(source, "TypeScript")
    m = re.search(rf"\b(?:const|let|var)\s+{re.escape(table)}\s*(?::[^=]+)?=\s*[\w$.]*(?:[A-Za-z]*Table|\.table)\s*\(", code.bare)
    if not m:
        return None
    at = code.bare.find("{", m.end())
    fields = []
    for i, part in split_top(code.bare[at + 1 : code.close(at)]):
        if c := re.match(r"\s*([A-Za-z_$][\w$]*|['\"][^'\"]*['\"])\s*:\s*(?:[\w$]+\.)?([A-Za-z_$][\w$]*)\s*\(", part):
            start = at + 1 + i
            chain = code.text[start : start + len(part)]
            own = re.search(r"\.\$type<(.*?)>\(", chain, re.S)
            kind = ts_type(own[1])[0] if own else primitive(COLUMN_TYPES[c[2]]) if c[2] in COLUMN_TYPES else {"kind": "unmapped", "value": c[2]}
            if re.search(r"\.array\s*\(", part):
                kind = {"kind": "array", "value": kind}
            name = code.text[start + c.start(1) : start + c.end(1)].strip("'\"")
            fields.append({"raw_name": name, "type": kind, "nullable": not re.search(r"\.notNull\s*\(", part), "has_default": bool(re.search(r"\.(default|defaultNow|\$default\w*)\s*\(", part)), "line": code.line(start + c.start(1))})
    relations = []
    for r in re.finditer(rf"\brelations\s*\(\s*{re.escape(table)}\s*,", code.bare):
        stop = code.close(code.bare.index("(", r.start()))
        arrow = code.bare.find("=>", r.end(), stop)
        at = code.bare.find("{", arrow, stop) if arrow > 0 else -1
        if at < 0:
            continue
        for i, part in split_top(code.bare[at + 1 : code.close(at)]):
            if c := re.match(r"\s*([A-Za-z_$][\w$]*)\s*:\s*(one|many)\s*\(\s*([\w$]+)", part):
                relations.append({"raw_name": c[1], "cardinality": c[2], "target": c[3], "nullable": c[2] == "one", "line": code.line(at + 1 + i + c.start(1))})
    return {"name": table, "fields": fields, "relations": relations}


def contract_rows(pair: str, side: str, contract: dict) -> tuple[list[tuple], list[tuple]]:
    """Rows for operators.contracts: fields and relations of one side."""
    fields = [(pair, side, f["raw_name"], type_json(f["type"]), f["nullable"], f["line"], k) for k, f in enumerate(contract["fields"])]
    relations = [(pair, side, r["raw_name"], r["cardinality"], r["line"], k) for k, r in enumerate(contract["relations"])]
    return fields, relations
