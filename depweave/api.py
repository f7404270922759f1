"""What a user calls: one function for each command, over a workspace file and a report folder."""

from __future__ import annotations

import glob
import os
import re
import time
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave import reports, sinks
from depweave.functions.text import allowlisted
from depweave.operators import communities, contracts, cycles, drift, extract, history, metrics, policy, query, smells
from depweave.plans.staging import stage
from depweave.sources import files, manifests, orm, snapshots
from depweave.sources.config import Config, Project, barrel_exclusions
from depweave.streaming import watch

TEMPLATE = """[settings]
output = "./report"
exclude = []
format = ["json", "csv", "md"]

[[project]]
name = "my-project"
repo = "."
lang = ["python"]
"""


@dataclass
class Workspace:
    """The analysed tables of all projects."""

    config: Config
    nodes: DataFrame
    edges: DataFrame
    metrics: DataFrame
    assignment: DataFrame
    communities: DataFrame
    cycles: DataFrame

    def of(self, project: str) -> dict[str, DataFrame]:
        own = lambda t: t.filter(F.col("project") == project)
        return {"nodes": own(self.nodes), "edges": own(self.edges), "metrics": own(self.metrics), "communities": own(self.communities), "cycles": own(self.cycles)}


def init(path: str) -> str:
    """Write a workspace file to start from; an existing one is an error."""
    with open(path, "x", encoding="utf-8") as out:
        out.write(TEMPLATE)
    return path


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except OSError:
        return None


def _context(project: Project, prefix: str) -> tuple[extract.Context, list[tuple[str, str]]]:
    """What the manifests under a project's root say. They are few small files, read on the driver."""
    aliases = {}
    if "TypeScript" in project.languages:
        for path in [os.path.join(project.repo, "tsconfig.json"), *glob.glob(os.path.join(project.repo, "**", "tsconfig.json"), recursive=True)]:
            folder = os.path.relpath(os.path.dirname(path), project.repo)
            if not set(folder.split(os.sep)) & set(files.DEFAULT_EXCLUDES) and (text := _read(path)):
                aliases["" if folder == "." else folder] = manifests.tsconfig_aliases(text)
    go, composer = _read(os.path.join(project.repo, "go.mod")), _read(os.path.join(project.repo, "composer.json"))
    return extract.Context(os.path.normpath(project.repo), prefix, manifests.go_module(go) if go else None, aliases), manifests.psr4_mappings(composer) if composer else []


def _cache_path(root: str, project: str) -> str:
    return os.path.abspath(os.path.join(root, project, ".extract-cache"))


def load(spark: SparkSession, config: Config, cache: str | None = None, only: list[str] | None = None, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, parsed) of the workspace; `only` names projects.

    `cache` is a report folder whose projects keep their parses (on a cluster: one that all machines see). Files with
    the same path, content, version and prefix are not parsed again, unless `force` is set; the cache is renewed.
    """
    parts, contexts, languages, stubs, keys = [], {}, [], [], {}
    for p in config.projects:
        if only and p.name not in only:
            continue
        prefix = p.local_prefix.put_before
        if not p.local_prefix.values:
            found = files.discover(spark, p.name, p.repo, list(p.languages), "", config.exclude, content=False)
            row = files.detect_prefix(found).first()
            prefix = row["prefix"] if row else ""
        ctx, psr4 = _context(p, prefix)
        contexts[p.name], keys[p.name] = ctx, p.local_prefix.cache_key or prefix
        found = files.discover(spark, p.name, p.repo, list(p.languages), prefix, config.exclude, psr4)
        held = None
        if cache and not force and os.path.isdir(_cache_path(cache, p.name)):
            found, held = files.split_cached(found, spark.read.schema(extract.PARSED + ", version int, prefix_key string").parquet(_cache_path(cache, p.name)), keys[p.name])
        parts.append(extract.parse_files(found) if held is None else extract.parse_files(found).unionByName(held))
        languages.append((p.name, p.languages[0]))
        stubs += [(p.name, s) for s in (*config.stubs, *p.stubs)]
    if not parts:
        raise ValueError(f"no such project: {', '.join(only or [])}")
    parsed = stage(reduce(DataFrame.unionByName, parts), "parsed-files")
    for name, key in keys.items() if cache else ():
        own = parsed.filter(F.col("project") == name).withColumn("version", F.lit(files.CACHE_VERSION)).withColumn("prefix_key", F.lit(key))
        own.write.mode("overwrite").parquet(_cache_path(cache, name))
    known = spark.createDataFrame(stubs, "project string, prefix string") if stubs else None
    across = config.workspace_reexports and len(config.projects) > 1 and any("TypeScript" in p.languages for p in config.projects)
    nodes, edges = extract.build_graph(parsed, contexts, known, spark.createDataFrame(languages, "project string, language string"), across)
    return stage(nodes, "nodes"), stage(edges, "edges"), parsed


def analyze(config: Config, nodes: DataFrame, edges: DataFrame, weights: metrics.Weights | None = None) -> Workspace:
    """Metrics, communities and cycles of all projects at once."""
    scored = metrics.compute_metrics(nodes, edges, weights or config.weights, config.thresholds)
    assignment = stage(communities.detect(nodes, edges), "communities")
    table = stage(scored.join(assignment, ["project", "id"], "left").na.fill({"community_id": 0}), "analysis")
    outside = [(p.name, x) for p in config.projects for x in barrel_exclusions(config, p)]
    kept = lambda t, *ends: t.filter(reduce(lambda a, b: a & b, [~((F.col("project") == p) & (F.col(c) == x)) for p, x in outside for c in ends])) if outside else t
    loops = stage(cycles.report_cycles(kept(nodes, "id"), kept(edges, "src", "dst")), "cycles")
    return Workspace(config, nodes, edges, table, assignment, stage(communities.communities(assignment, edges), "groups"), loops)


def workspace(spark: SparkSession, config: Config, cache: str | None = None, only: list[str] | None = None, weights: metrics.Weights | None = None, force: bool = False) -> Workspace:
    nodes, edges, _ = load(spark, config, cache, only, force)
    return analyze(config, nodes, edges, weights)


def extract_graphs(spark: SparkSession, config: Config, output: str | None = None, force: bool = False) -> list[str]:
    """graph.json of every project (and the cache), nothing else."""
    root = output or config.output
    nodes, edges, _ = load(spark, config, root, force=force)
    own = lambda t, p: t.filter(F.col("project") == p.name)
    return [sinks.write_lines(sinks.graph_json(own(nodes, p), own(edges, p)), os.path.join(root, p.name, "graph.json")) for p in config.projects]


def analyze_graphs(spark: SparkSession, config: Config, output: str | None = None, force: bool = False) -> Workspace:
    """analysis.json (without the allow-list) and the two CSV files of every project."""
    root = output or config.output
    w = workspace(spark, config, root, force=force)
    for p in config.projects:
        t, at = w.of(p.name), os.path.join(root, p.name)
        sinks.write_lines(sinks.analysis_json(t["metrics"], t["edges"], t["communities"], t["cycles"]), os.path.join(at, "analysis.json"))
        sinks.write_all(at, p.name, t, ["csv"])
    return w


def report(spark: SparkSession, config: Config, output: str | None = None, formats: list[str] | None = None, now: int | None = None, force: bool = False, only: list[str] | None = None, ignore_allowlist: bool = False) -> Workspace:
    """Reports of all projects (or `only` some), a history snapshot each; then old folders are pruned and the summary is written."""
    root, taken = output or config.output, now or time.time_ns()
    w = workspace(spark, config, root, only, force=force)
    chosen = [p for p in config.projects if not only or p.name in only]
    for p in chosen:
        t = w.of(p.name)
        listed = None
        if config.allowlist and not ignore_allowlist:
            rows = t["nodes"].filter(allowlisted(F.col("id"), list(config.allowlist))).select("id").orderBy("id")
            listed = (r["id"] for r in rows.toLocalIterator())
        sinks.write_all(os.path.join(root, p.name), p.name, t, formats or config.formats, listed)
        members = t["communities"].select("project", "community_id", F.explode("members").alias("id"), "cohesion")
        snap = history.snapshot(t["nodes"], t["edges"], t["metrics"], members, t["cycles"], taken)
        sinks.write_lines((r["j"] for r in snap.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()), os.path.join(root, p.name, "history", f"{taken}.json"))
    if len(chosen) == len(config.projects):
        sinks.prune(root, [p.name for p in config.projects])
        if len(chosen) > 1:
            sinks.write_lines([summary_json(w)], os.path.join(root, "workspace-summary.json"))
    return w


def run(spark: SparkSession, config: Config, output: str | None = None, formats: list[str] | None = None, now: int | None = None, force: bool = False) -> Workspace:
    """Everything from the sources to the reports."""
    return report(spark, config, output, formats, now, force)


def watch_workspace(spark: SparkSession, config: Config, checkpoint: str, output: str | None = None, formats: list[str] | None = None, once: bool = False) -> list:
    """Build once, then rebuild the projects whose files change: one stream a project folder. `once` ends when all is seen."""
    root = output or config.output
    report(spark, config, root, formats)
    roots = {p.name: os.path.abspath(p.repo) for p in config.projects}
    languages = sorted({x for p in config.projects for x in p.languages})
    rebuild = lambda names: report(spark, config, root, formats, only=names)
    started = []
    for name, repo in roots.items():
        changes = watch.file_changes(spark, repo)
        started.append(watch.watch(changes, roots, rebuild, os.path.join(checkpoint, name), languages, config.exclude, os.path.abspath(root), once))
    return started


def _saved(spark: SparkSession, config: Config, output: str | None, name: str, only: str | None = None) -> list[tuple[str, str]]:
    """(project, path) of a report file of each project; ValueError names what is missing."""
    if only and only not in [p.name for p in config.projects]:
        raise ValueError(f"no such project: {only}")
    found = [(p.name, os.path.join(output or config.output, p.name, name)) for p in config.projects if not only or p.name == only]
    if gone := [path for _, path in found if not os.path.exists(path)]:
        raise ValueError(f"missing {', '.join(gone)}: run the reports first")
    return found


def consolidation(spark: SparkSession, config: Config, output: str | None = None, min_size: int = 2, ignore_allowlist: bool = False, across: bool = False) -> DataFrame:
    """Groups of nodes with one leaf name, from the saved reports; `across` all projects."""
    tables, graphs = [], []
    for name, path in _saved(spark, config, output, "analysis.json"):
        tables.append(snapshots.read_analysis(spark, path, name).nodes)
    for name, path in _saved(spark, config, output, "graph.json"):
        graphs.append(snapshots.read_graph(spark, path, name)[0])
    join = lambda parts: reduce(DataFrame.unionByName, parts)
    return smells.consolidation(join(tables), join(graphs), min_size, list(config.allowlist), ignore_allowlist, across)


def suggest_stubs(spark: SparkSession, config: Config, output: str | None = None, min_edges: int = 2, only: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, seen) from the saved graphs."""
    found = [snapshots.read_graph(spark, path, name) for name, path in _saved(spark, config, output, "graph.json", only)]
    stubs = [(p.name, s) for p in config.projects for s in (*config.stubs, *p.stubs)]
    prefixes = [(p.name, v) for p in config.projects for v in p.local_prefix.values]
    table = lambda rows: spark.createDataFrame(rows, "project string, prefix string") if rows else None
    join = lambda k: reduce(DataFrame.unionByName, [x[k] for x in found])
    return smells.suggest_stubs(join(0), join(1), table(stubs), table(prefixes), min_edges)


def apply_stubs(path: str, candidates: DataFrame) -> bool:
    """Add the candidates to the workspace file at once, through a neighbour that is renamed; whether it changed.

    What would be written is parsed first: a file that the result would break stays as it is.
    """
    from depweave.sources.config import parse

    with open(path, encoding="utf-8") as lines:
        text = lines.read()
    new = reports.apply_stubs(text, reports.stub_scopes(candidates))
    parse(new)
    if new == text:
        return False
    with open(path + ".part", "w", encoding="utf-8") as out:
        out.write(new)
    os.replace(path + ".part", path)
    return True


def summary_json(w: Workspace) -> str:
    rows = smells.workspace_summary(w.nodes, w.edges, w.assignment, w.cycles)
    shared = smells.shared_modules(w.nodes)
    top = w.metrics.select("project", "id", F.round("score", 3).alias("score")).orderBy(F.desc("score"), "id").limit(10)
    return f'{{"projects":{reports.table_json(rows, "project")},"coupling":{reports.table_json(smells.coupling(w.nodes, w.edges), "from_project", "to_project")},"shared_modules":{reports.table_json(shared, "id")},"top_hotspots":{reports.table_json(top, F.desc("score"), "id")}}}'


def check(spark: SparkSession, config: Config, limits: policy.Limits = policy.Limits(), output: str | None = None, with_contracts: bool | None = None) -> tuple[bool, DataFrame, DataFrame]:
    """Gates and rules with default weights: (all ok, report rows, policy violations).

    The report, and that of the contracts if they are checked, goes to every project's folder.
    """
    w = workspace(spark, config, weights=metrics.Weights())
    gate = policy.gates(w.metrics, w.edges, w.assignment, w.cycles, limits, {p.name: p.limits for p in config.projects}, allowlisted(F.col("id"), list(config.allowlist)) if config.allowlist else None)
    found = stage(policy.evaluate(w.nodes, w.edges, list(config.groups), list(config.rules)), "violations")
    pairs = compare_contracts(spark, config) if (with_contracts or with_contracts is None and config.contracts.get("pair")) else None
    errors = pairs.filter("severity = 'error'").count() if pairs is not None else 0
    rows = stage(policy.check_report(gate, found, len(config.rules), errors), "check")
    text = reports.check_json(rows, found, pairs)
    for p in config.projects:
        sinks.write_lines([text], os.path.join(output or config.output, p.name, "check-report.json"))
        if pairs is not None:
            sinks.write_lines(reports.contract_markdown(pairs), os.path.join(output or config.output, p.name, "contract-report.md"))
    return bool(rows.filter("project is null").first()["ok"]), rows, found


def compare_contracts(spark: SparkSession, config: Config, base: str = ".") -> DataFrame:
    """Violations of all configured pairs of a database table and an interface type."""
    fields, relations, rows = [], [], []
    for pair in config.contracts.get("pair") or []:
        name = pair["name"]
        for side, read in (("orm", lambda s: orm.orm_contract(s, pair["orm"].get("table", name))), ("ts", lambda s: orm.ts_contract(s, pair["ts"].get("export", name)))):
            text = _read(os.path.join(base, pair[side]["file"]))
            found = read(text) if text is not None else None
            if found is None:
                raise ValueError(f"contract {name!r}: nothing found for {side} in {pair[side].get('file')}")
            f, r = orm.contract_rows(name, side, found)
            fields, relations = fields + f, relations + r
        ignore = pair.get("ignore") or {}
        aliases = lambda key: [(a["orm"], a["ts"]) for a in pair.get(key) or []]  # noqa: B023, E731
        rows.append((name, ignore.get("orm") or [], ignore.get("ts") or [], aliases("field_alias"), aliases("relation_alias")))
    alias = "array<struct<orm:string,ts:string>>"
    table = lambda data, schema: spark.createDataFrame(data, schema)
    overrides = {k: orm.type_json(orm.primitive(v)) if v in ("string", "number", "boolean", "date", "unknown") else orm.type_json({"kind": "named", "value": v}) for k, v in (config.contracts.get("type_map") or {}).items()}
    return contracts.compare(
        table(fields, "pair string, side string, raw_name string, type_json string, nullable boolean, line long, seq long"),
        table(relations, "pair string, side string, raw_name string, cardinality string, line long, seq long"),
        table(rows, f"pair string, ignore_orm array<string>, ignore_ts array<string>, field_aliases {alias}, relation_aliases {alias}"),
        config.contracts.get("case_rule", "snake_camel"),
        overrides,
        config.contracts.get("unmapped_type_severity", "warning"),
    )


def mirror_index(config: Config | None) -> dict[str, str]:
    """The group of each node id that the configuration names as a mirror ("project:id", or an id)."""
    return {e.partition(":")[2] or e: group for group, ends in config.intentional_mirrors.items() for e in ends} if config else {}


def write_drift(parts: dict[str, DataFrame], folder: str, labels: tuple[str, str] | None = None) -> list[str]:
    """drift-report.json and drift-report.md in a folder."""
    return [sinks.write_lines([reports.drift_json(parts, labels)], os.path.join(folder, "drift-report.json")), sinks.write_lines(reports.drift_markdown(parts, *([labels] if labels else [])), os.path.join(folder, "drift-report.md"))]


def write_trend(project: str, parts: dict[str, DataFrame], folder: str) -> list[str]:
    """trend-report.json and trend-report.md in a folder."""
    return [sinks.write_lines([reports.trend_json(project, parts)], os.path.join(folder, "trend-report.json")), sinks.write_lines(reports.trend_markdown(project, parts), os.path.join(folder, "trend-report.md"))]


def diff(spark: SparkSession, before: str, after: str, threshold: float = drift.THRESHOLD, mirrors: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Two analysis reports (files, or folders that hold analysis.json)."""
    at = lambda p: os.path.join(p, "analysis.json") if os.path.isdir(p) else p
    return drift.diff(snapshots.read_analysis(spark, at(before)), snapshots.read_analysis(spark, at(after)), threshold, mirrors)


def compare(spark: SparkSession, left: str, right: str, labels: tuple[str, str] | None = None, threshold: float = drift.THRESHOLD, form: str = "md") -> str:
    """Two reports side by side as Markdown or (form 'json') JSON, labelled by their folders unless told otherwise."""
    name = lambda p: os.path.basename(os.path.dirname(p) if p.endswith(".json") else p.rstrip("/")) or p
    parts, labels = diff(spark, left, right, threshold), labels or (name(left), name(right))
    return reports.drift_json(parts, labels) if form == "json" else "\n".join(reports.drift_markdown(parts, labels))


def diff_live(spark: SparkSession, config: Config, baseline: str, project: str, threshold: float = drift.THRESHOLD) -> dict[str, DataFrame]:
    """A saved report against the workspace as it is now (with the configured weights)."""
    t = workspace(spark, config, only=[project]).of(project)
    members = t["communities"].select("project", "community_id", F.explode("members").alias("id"))
    return drift.diff(snapshots.read_analysis(spark, baseline, project), drift.Snapshot(t["metrics"], t["edges"], members, t["cycles"]), threshold, mirror_index(config))


def trend(spark: SparkSession, folder: str, limit: int | None = None) -> dict[str, DataFrame]:
    """The history of a project's report folder."""
    return history.trend(*snapshots.history_tables(snapshots.read_history(spark, os.path.join(folder, "history"))), limit=limit)


def pull_request(spark: SparkSession, folder: str, project: str, baseline: str | None = None) -> str:
    """A Markdown summary from a report folder, with drift against a baseline if one is given."""
    now = snapshots.read_analysis(spark, os.path.join(folder, "analysis.json"), project)
    parts = drift.diff(snapshots.read_analysis(spark, baseline, project), now) if baseline else None
    nodes = now.nodes.withColumn("is_local", F.lit(True))
    new = parts["nodes"].filter("change = 'added'") if parts else None
    found = smells.smells(now.edges, now.nodes, cycles.cycle_pairs(now.cycles), new_nodes=new)
    return "\n".join(reports.pull_request_markdown(project, query.stats(nodes, now.edges, now.members, now.cycles), parts, found))


class Tools:
    """The served tools over one analysed workspace, all projects or one."""

    def __init__(self, w: Workspace, project: str | None = None):
        self.w = w
        own = (lambda t: t.filter(F.col("project") == project)) if project else (lambda t: t)
        self.nodes, self.edges, self.metrics, self.assignment, self.cycles = map(own, (w.nodes, w.edges, w.metrics, w.assignment, w.cycles))

    def stats(self) -> DataFrame:
        return query.stats(self.nodes, self.edges, self.assignment, self.cycles)

    def search(self, pattern: str, kind: str | None = None, local_only: bool = False, sort: str = "score", min_confidence: float | None = None) -> DataFrame:
        from depweave.schemas import parse_node_kind

        return query.search(self.nodes, self.metrics, pattern, parse_node_kind(kind) if kind else None, local_only, sort, self.assignment, min_confidence)

    def explain(self, node: str) -> DataFrame:
        """An empty answer means: ask suggest()."""
        return query.explain(self.nodes, self.edges, self.metrics, self.assignment, self.cycles, node)

    def path(self, start: str, end: str) -> DataFrame:
        return query.shortest_path(self.edges, self.nodes, start, end)

    def all_paths(self, start: str, end: str, depth: int = query.PATH_DEPTH, most: int = query.MAX_PATHS) -> DataFrame:
        return query.all_paths(self.edges, start, end, depth, most)

    def dependents(self, node: str) -> DataFrame:
        return query.dependents(self.edges, node)

    def dependencies(self, node: str) -> DataFrame:
        return query.dependencies(self.edges, node)

    def suggest(self, text: str) -> DataFrame:
        return query.suggest(self.nodes, text)

    def transitive_dependents(self, node: str, depth: int = 5) -> DataFrame:
        return query.transitive_dependents(self.edges, node, depth)


COMMANDS = {"stats": 0, "search": 1, "explain": 1, "path": 2, "all_paths": 2, "dependents": 1, "dependencies": 1, "suggest": 1, "transitive_dependents": 1}


def shell_line(tools: Tools, line: str) -> DataFrame | None:
    """One line of a session: a command and its words; None for an empty line, ValueError for what is not understood."""
    words = line.split()
    if not words:
        return None
    if words[0] not in COMMANDS or len(words) - 1 < COMMANDS[words[0]]:
        raise ValueError(f"commands: {', '.join(COMMANDS)}")
    return getattr(tools, words[0])(*words[1 : COMMANDS[words[0]] + 1])


def report_age(path: str, now: float) -> int:
    """Whole days since a report says it was made, or since its file was written where it does not say (or says the future)."""
    with open(path, encoding="utf-8") as lines:
        said = re.search(r'"generated_at":"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)Z"', "".join(line for line in lines if '"generated_at"' in line))
    made = datetime.fromisoformat(said[1] + "+00:00").timestamp() if said else now + 1
    return int((now - (made if made <= now else os.path.getmtime(path))) // 86_400)


def session_brief(spark: SparkSession, root: str, projects: list[str], now: float | None = None, top: int = 10) -> str:
    """The hottest nodes over all reports of a folder, and how old they are."""
    parts, loops, ages = [], [], {}
    for p in projects:
        path = os.path.join(root, p, "analysis.json")
        if os.path.exists(path):
            s = snapshots.read_analysis(spark, path, p)
            parts.append(s.nodes.select("project", "id", "score"))
            loops.append(s.cycles)
            ages[p] = report_age(path, now or time.time())
    if not parts:
        raise ValueError(f"no reports under {root}")
    return reports.session_brief(reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, loops), ages, top)


def session_scope(tools: Tools, names: list[str]) -> str:
    """Explanations of several nodes as one JSON object."""
    out = [row["j"] for n in names for row in tools.explain(n).select(F.to_json(F.struct("*")).alias("j")).collect()]
    return '{"nodes":[' + ",".join(out) + "]}"
