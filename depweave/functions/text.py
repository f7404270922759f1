"""Column expressions on ids, paths and report text. All of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STUB_ENDS = ("::", "/", ".")


def as_bytes(text: Column) -> Column:
    """One character a UTF-8 byte, so that a pattern's '?' takes a byte and not a character."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for `*` (any run, dots too) and `?` (one byte); over as_bytes() text."""
    out = []
    for ch in pattern.encode().decode("latin-1"):
        out.append(".*" if ch == "*" else "." if ch == "?" else re.sub(r"([^A-Za-z0-9_\x80-\xff])", r"\\\1", ch))
    return f"(?s)^{''.join(out)}$"


def glob_match(text: Column, pattern: str) -> Column:
    if "?" not in pattern and pattern.isascii():  # bytes and characters cannot be told apart
        if "*" not in pattern:
            return text == F.lit(pattern)
        if pattern == "*":
            return text.isNotNull()
        if pattern.count("*") == 1 and pattern.endswith("*"):
            return text.startswith(pattern[:-1])
        return text.rlike(glob_regex(pattern))
    return as_bytes(text).rlike(glob_regex(pattern))


def leaf_symbol(node_id: Column) -> Column:
    """After the last dot."""
    return F.substring_index(node_id, ".", -1)


def anchored(pattern: str) -> str:
    """Adds only the missing anchors; alternatives are not grouped."""
    return ("" if pattern.startswith("^") else "^") + pattern + ("" if pattern.endswith("$") else "$")


def check_regex(pattern: str) -> str:
    """A pattern that means the same without look-around and back-references; ValueError otherwise."""
    if re.search(r"\(\?(?:=|!|<=|<!)|\\[1-9]|\(\?P=", pattern):
        raise ValueError(f"look-around and back-references are not supported: {pattern!r}")
    re.compile(pattern)
    return pattern


def allowlisted(node_id: Column, patterns: list[str]) -> Column:
    """The leaf matches one of the patterns, each anchored."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | leaf_symbol(node_id).rlike(anchored(check_regex(pattern)))
    return out


def stub_match(target: Column, prefix: Column) -> Column:
    """Equal to the prefix, or the prefix followed by `::`, `/` or `.`."""
    out = target == prefix
    for end in STUB_ENDS:
        out = out | target.startswith(F.concat(prefix, F.lit(end)))
    return out


def stub_candidates(target: Column) -> Column:
    """All prefixes of a target that stub_match would accept: turns the prefix join into an equi-join."""
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(target), F.lit(1))), lambda i: (i == F.length(target)) | F.substring(target, i + 1, F.lit(1)).isin("/", ".") | (F.substring(target, i + 1, F.lit(2)) == "::"))
    return F.when(F.length(target) > 0, F.array_distinct(F.transform(ends, lambda i: F.substring(target, F.lit(1), i)))).otherwise(F.array())


def top_segment(node_id: Column) -> Column:
    """Up to the earliest of `::`, `/`, `.`; null for blank ids."""
    text = F.trim(node_id)
    return F.when(text != "", F.regexp_extract(text, r"(?s)^(.*?)(?:::|/|\.|$)", 1))


def extract_prefix(node_id: Column, language: Column) -> Column:
    """The package part of an external id, by language; null for blank ids."""
    text = F.trim(node_id)
    slashes = F.split(text, "/")
    first = F.element_at(slashes, 1)
    scoped = F.regexp_extract(text, r"^(@[^/]+/[^/]+)", 1)
    go = F.when((F.size(slashes) >= 3) & first.contains("."), F.array_join(F.slice(slashes, 1, 3), "/")).when(F.size(slashes) == 1, F.substring_index(first, ".", 1)).otherwise(first)
    out = (
        F.when(language == "Rust", F.substring_index(text, "::", 1))
        .when(language.isin("Python", "Php"), F.substring_index(text, ".", 1))
        .when((language == "TypeScript") & text.startswith("@"), F.when(scoped != "", scoped).otherwise(text))
        .when(language == "TypeScript", first)
        .when(language == "Go", go)
        .otherwise(text)
    )
    return F.when(text != "", out)


def segment(node_id: Column, index: int) -> Column:
    """The dotted segment number `index` (from 0), or null."""
    return F.get(F.split(node_id, r"\."), F.lit(index))


def snake_to_camel(name: Column) -> Column:
    """Drops underscores and upper-cases the character behind them; a leading underscore does so too."""
    parts = F.split(name, "_")
    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))
    return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))


def canonical_rotation(nodes: Column) -> Column:
    """A cycle turned so that its least id comes first."""
    at = F.array_position(nodes, F.array_min(nodes)).cast("int")
    return F.concat(F.slice(nodes, at, F.size(nodes)), F.slice(nodes, F.lit(1), at - 1))


def edge_kind_rank(kind: Column) -> Column:
    return F.when(kind == "Imports", 0).when(kind == "Defines", 1).otherwise(2)


def confidence_label(mean: Column) -> Column:
    return F.when(mean.isNull(), "—").when(mean >= 0.9, "resolved").when(mean >= 0.5, "partial").otherwise("ambiguous")


def confidence_tag(kind: Column) -> Column:
    return F.when(kind == "Extracted", "").when(kind == "Inferred", "~inferred").when(kind == "Ambiguous", "?ambiguous").otherwise("external")


def score_style(score: Column) -> Column:
    return F.when(score >= 0.6, "red").when(score >= 0.3, "yellow").otherwise("green")


def cypher_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def xml_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def wikilink_target(node_id: Column) -> Column:
    return F.replace(node_id, F.lit("/"), F.lit("_"))


def script_safe(json: Column) -> Column:
    return F.replace(json, F.lit("</script>"), F.lit("<\\/script>"))


def iso_utc(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_days(then: Column, now: Column) -> Column:
    """Whole days from an ISO-8601 instant to another timestamp; null in the future or if it can't be read."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(then))
    return F.when(seconds >= 0, F.floor(seconds / 86_400))


def dotted_path(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("."))
