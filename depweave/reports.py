"""Markdown and JSON of comparison reports: drift, trend, gates, contracts, smells, consolidation, stubs, pull requests, sessions.

Text is streamed from sorted tables; only what a report caps by itself (five rows a section) is collected.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.sinks import lines_of

ROWS = 5


def table_json(df: DataFrame, *order: str) -> str:
    """One JSON text, for tables that a report bounds (drift, gates, candidates); graphs are streamed by depweave.sinks."""
    return "[" + ",".join(lines_of(df, F.to_json(F.struct(*df.columns)), *order)) + "]"


def drift_json(parts: dict[str, DataFrame], labels: tuple[str, str] | None = None) -> str:
    """All parts of operators.drift.diff by name; `labels` names the two sides of a comparison."""
    order = {"summary_delta": ("what",), "nodes": ("id",), "degrees": ("id",), "hotspots": ("bucket", "id"), "communities": ("id",)}
    fields = [f'"{name}":' + table_json(df.withColumn("nodes", F.array_join("nodes", ">")) if name == "cycles" else df, *order.get(name, ("nodes",))) for name, df in parts.items()]
    if labels:
        fields.insert(0, f'"labels":{json.dumps({"left": labels[0], "right": labels[1]})}')
    return "{" + ",".join(fields) + "}"


def drift_markdown(parts: dict[str, DataFrame], labels: tuple[str, str] = ("before", "after")) -> Iterable[str]:
    a, b = (x.replace("|", "\\|") for x in labels)
    yield from (f"# Drift: {a} → {b}", "", f"| what | {a} | {b} | change |", "|---|---|---|---|")
    yield from lines_of(parts["summary_delta"], F.format_string("| %s | %d | %d | %+d |", "what", "before", "after", "change"), "what")
    for change in ("added", "removed"):
        yield from ("", f"## Nodes {change}", "")
        yield from lines_of(parts["nodes"].filter(F.col("change") == change), F.concat(F.lit("- `"), "id", F.lit("`")), "id")
    hot = parts["hotspots"]
    mirrored = F.col("intentional_mirror").isNotNull() if "intentional_mirror" in hot.columns else F.lit(False)
    for bucket in ("rising", "falling", "new", "removed"):
        yield from ("", f"## Hotspots {bucket}", "", "| node | before | after | delta |", "|---|---|---|---|")
        yield from lines_of(hot.filter((F.col("bucket") == bucket) & ~mirrored), F.format_string("| `%s` | %.3f | %.3f | %+.3f |", "id", "before", "after", "delta"), F.desc("delta") if bucket in ("rising", "new") else "delta", "id")
    if "intentional_mirror" in hot.columns:
        yield from ("", "## Intentional mirrors", "")
        yield from lines_of(hot.filter("intentional_mirror is not null"), F.format_string("- `%s` %+.3f (%s, %s)", "id", "delta", "bucket", "intentional_mirror"), "id")
    for change in ("introduced", "resolved"):
        yield from ("", f"## Cycles {change}", "")
        yield from lines_of(parts["cycles"].filter(F.col("change") == change), F.concat(F.lit("- "), F.array_join("nodes", " → ")), F.array_join("nodes", ">"))
    yield from ("", "## Community moves", "")
    yield from lines_of(parts["communities"].filter("moved"), F.format_string("- `%s`: %d → %d", "id", "from_community", "to_community"), "id")


def trend_json(project: str, parts: dict[str, DataFrame]) -> str:
    order = {"points": ("captured_at",), "intervals": ("to_captured_at",), "hotspots": ("to_captured_at", "bucket", "id"), "churn": ("to_captured_at",)}
    return f'{{"project":{json.dumps(project)},' + ",".join(f'"{k}":{table_json(df, *order[k])}' for k, df in parts.items()) + "}"


def trend_markdown(project: str, parts: dict[str, DataFrame]) -> Iterable[str]:
    yield from (f"# Trend: {project}", "", "| captured at | nodes | edges | communities | cycles |", "|---|---|---|---|---|")
    yield from lines_of(parts["points"], F.format_string("| %d | %d | %d | %d | %d |", "captured_at", "total_nodes", "total_edges", "total_communities", "total_cycles"), "captured_at")
    yield from ("", "## Intervals", "")
    both = parts["intervals"].join(parts["churn"], ["project", "from_captured_at", "to_captured_at"], "left").na.fill(0)
    yield from lines_of(both, F.format_string("- %d → %d: nodes %+d, edges %+d, cycles %+d, churn %.1f %%", "from_captured_at", "to_captured_at", "change_total_nodes", "change_total_edges", "change_total_cycles", F.col("churn_pct").cast("double")), "to_captured_at")
    yield from ("", "## Hotspots", "")
    yield from lines_of(parts["hotspots"], F.format_string("- %d `%s` %s", "to_captured_at", "id", "bucket"), "to_captured_at", "bucket", "id")


def check_json(rows: DataFrame, violations: DataFrame, contracts: DataFrame | None = None) -> str:
    """The whole check report; the row without a project is the total."""
    total = rows.filter("project is null").first()
    fields = [f'"ok":{str(bool(total["ok"])).lower()}', f'"violations":{total["violations"]}', f'"projects":{table_json(rows.filter("project is not null"), "project")}', f'"policy_violations":{table_json(violations, "rule", "source_node", "target_node", "target_project")}']
    if contracts is not None:
        fields.append(f'"contracts":{table_json(contracts, "pair", "line", "rank", "name")}')
    return "{" + ",".join(fields) + "}"


def contract_markdown(violations: DataFrame) -> Iterable[str]:
    yield from ("## Contracts", "")
    yield from lines_of(violations, F.format_string("- **%s** line %d: %s `%s` (%s)", "pair", "line", "violation", "name", "severity"), "pair", "line", "rank", "name")


def consolidation_markdown(groups: DataFrame, across: bool = False) -> Iterable[str]:
    yield from ("# Consolidation candidates" + (" across projects" if across else ""), "")
    members = F.array_join(F.transform("members", lambda m: F.concat(F.lit("`"), m["id"], F.lit("` ("), m["fan_in"].cast("string"), F.lit(")"))), ", ")
    order = ([F.desc("project_count")] if across else []) + [F.desc("group_size"), "leaf_name"]
    yield from lines_of(groups, F.format_string("- **%s** × %d: %s", "leaf_name", "group_size", members), *order)


def stubs_markdown(candidates: DataFrame, seen: DataFrame) -> Iterable[str]:
    yield from ("# Stub suggestions", "")
    yield from lines_of(candidates, F.format_string("- [%s] `%s` (%s): weight %d over %d nodes, e.g. %s", "scope", "prefix", "language", "edge_weight", "node_count", F.array_join("example_nodes", ", ")), "scope", F.desc("edge_weight"), "prefix")
    for state in ("covered", "shadowed"):
        yield from ("", f"## Already {state}", "")
        yield from lines_of(seen.filter(F.col("state") == state), F.concat(F.lit("- `"), "prefix", F.lit("`")), "prefix")


def consolidation_json(groups: DataFrame, across: bool = False) -> str:
    order = ([F.desc("project_count")] if across else []) + [F.desc("group_size"), "leaf_name"]
    return f'{{"candidates":{table_json(groups, *order)}}}'


def stubs_json(candidates: DataFrame, seen: DataFrame) -> str:
    return f'{{"candidates":{table_json(candidates, "scope", F.desc("edge_weight"), "prefix")},"seen":{table_json(seen, "state", "prefix")}}}'


def stub_scopes(candidates: DataFrame) -> dict[str, list[str]]:
    """The suggested prefixes by scope, heaviest first."""
    scopes: dict[str, list[str]] = {}
    for r in candidates.select("scope", "prefix", "edge_weight").orderBy("scope", F.desc("edge_weight"), "prefix").toLocalIterator():
        scopes.setdefault(r["scope"], []).append(r["prefix"])
    return scopes


def stubs_toml(candidates: DataFrame) -> str:
    """external_stubs lists: for the settings, then for each project."""
    scopes = stub_scopes(candidates)
    order = sorted(scopes, key=lambda s: (s != "settings", s))
    return "\n".join((f"[settings]\n" if s == "settings" else f'# project "{s}"\n') + f"external_stubs = {json.dumps(scopes[s])}\n" for s in order)


def apply_stubs(text: str, scopes: dict[str, list[str]]) -> str:
    """The workspace file with suggested prefixes added to its lists; a second run changes nothing."""

    def add(block: str, prefixes: list[str]) -> str:
        m = re.search(r"^external_stubs\s*=\s*\[(.*?)\]", block, re.S | re.M)
        have = re.findall(r'"([^"]*)"', m[1]) if m else []
        line = f"external_stubs = {json.dumps([*have, *[p for p in prefixes if p not in have]])}"
        if m:
            return block if set(prefixes) <= set(have) else block[: m.start()] + line + block[m.end() :]
        head, _, rest = block.partition("\n")
        return f"{head}\n{line}\n{rest}"

    out = []
    for block in re.split(r"(?m)^(?=\[)", text):
        name = re.search(r'^name\s*=\s*"([^"]*)"', block, re.M)
        if block.startswith("[settings]") and "settings" in scopes:
            block = add(block, scopes["settings"])
        elif block.startswith("[[project]]") and name and name[1] in scopes:
            block = add(block, scopes[name[1]])
        out.append(block)
    if "settings" in scopes and not any(b.startswith("[settings]") for b in out):
        out.insert(0, add("[settings]\n", scopes["settings"]) + "\n")
    return "".join(out)


def pull_request_markdown(project: str, summary: DataFrame, drift: dict[str, DataFrame] | None = None, smells: DataFrame | None = None, gates: DataFrame | None = None, violations: DataFrame | None = None, contracts: DataFrame | None = None) -> Iterable[str]:
    """A short summary for a pull request: at most five rows a section, with a note of how many more there are."""

    def section(title: str, df: DataFrame | None, line, *order):
        if df is None:
            return
        total = df.count()
        if not total:
            return
        yield from ("", f"### {title}", "")
        yield from lines_of(df.orderBy(*order).limit(ROWS), line, *order)
        if total > ROWS:
            yield f"- … and {total - ROWS} more"

    yield f"## Architecture: {project}"
    s = summary.first()
    if s:
        yield f"{s['total_nodes']} nodes, {s['total_edges']} edges, {s['communities']} communities, {s['cycles']} cycles"
    if drift:
        hot = drift["hotspots"]
        for bucket in ("new", "rising", "falling", "removed"):
            yield from section(f"Hotspots {bucket}", hot.filter(F.col("bucket") == bucket), F.format_string("- `%s` %.3f → %.3f", "id", "before", "after"), F.desc(F.abs("delta")), "id")
        yield from section("Cycles introduced", drift["cycles"].filter("change = 'introduced'"), F.concat(F.lit("- "), F.array_join("nodes", " → ")), F.array_join("nodes", ">"))
        yield from section("Community moves", drift["communities"].filter("moved"), F.format_string("- `%s`: %d → %d", "id", "from_community", "to_community"), "id")
    yield from section("Smells", smells, F.format_string("- `%s` → `%s` (%d): %s", "src", "dst", "score", F.array_join("reasons", ", ")) if smells is not None else None, F.desc("score"), "src", "dst")
    yield from section("Rule violations", violations, F.format_string("- %s: `%s` → `%s`", "rule", "source_node", "target_node") if violations is not None else None, "rule", "source_node", "target_node")
    yield from section("Failed gates", gates.filter("not ok") if gates is not None else None, F.format_string("- %s: %d cycles, hottest `%s` %.3f", "project", "cycles", "max_hotspot_id", "max_hotspot_score") if gates is not None else None, "project")
    yield from section("Contract violations", contracts, F.format_string("- %s: %s `%s`", "pair", "violation", "name") if contracts is not None else None, "pair", "line")


def session_brief(metrics: DataFrame, cycles: DataFrame, ages: dict[str, int | None], top: int = 10) -> str:
    """The hottest nodes and the cycles of all projects, and the age in days of the youngest baseline."""
    hot = metrics.select("project", "id", "score").orderBy(F.desc("score"), "project", "id").limit(top)
    loops = cycles.select("project", F.array_join("nodes", " → ").alias("cycle"))
    known = [a for a in ages.values() if a is not None]
    return f'{{"hotspots":{table_json(hot, F.desc("score"), "project", "id")},"cycles":{table_json(loops.orderBy("project", "cycle").limit(top), "project", "cycle")},"baseline_age_days":{min(known) if known else "null"}}}'
