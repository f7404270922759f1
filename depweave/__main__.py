"""python -m depweave COMMAND ...: the functions of depweave.api from a shell."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from depweave import api, reports, sinks
from depweave.operators.policy import Limits
from depweave.sources import config

#: Commands and their words.
COMMANDS = {
    "init": ["path"], "extract": [], "analyze": [], "report": [], "run": [], "watch": ["checkpoint"], "check": [], "search": ["pattern"], "explain": ["node"], "path": ["start", "end"], "shell": [],
    "diff": ["before", "after"], "diff-live": ["baseline", "project"], "compare": ["left", "right"], "trend": ["folder"], "pr-summary": ["folder", "project"], "consolidation": [], "suggest-stubs": [],
    "session-brief": [], "session-scope": ["nodes"],
}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="depweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name, words in COMMANDS.items():
        own = sub.add_parser(name)
        own.add_argument("--config", default="depweave.toml")
        own.add_argument("--output")
        for w in words:
            own.add_argument(w, **({"nargs": "+"} if w == "nodes" else {}))
        if name in ("extract", "analyze", "report", "run"):
            own.add_argument("--force", action="store_true")
        if name in ("report", "run", "watch"):
            own.add_argument("--formats", nargs="*")
        if name == "watch":
            own.add_argument("--once", action="store_true")
        if name == "check":
            own.add_argument("--max-cycles", type=int)
            own.add_argument("--max-hotspot-score", type=float)
        if name == "consolidation":
            own.add_argument("--min-group-size", type=int, default=2)
            own.add_argument("--ignore-allowlist", action="store_true")
            own.add_argument("--across", action="store_true")
        if name == "suggest-stubs":
            own.add_argument("--min-edges", type=int, default=2)
            own.add_argument("--project")
            own.add_argument("--apply", action="store_true")
        if name in ("consolidation", "suggest-stubs", "compare"):
            own.add_argument("--format", choices=("md", "json", *(["toml"] if name == "suggest-stubs" else [])), default="md")
    return p


def _say(lines: Iterable[str] | str) -> None:
    print(lines if isinstance(lines, str) else "\n".join(lines))


def _project_command(spark: SparkSession, a: argparse.Namespace) -> int:
    """Commands over a workspace file."""
    c = config.load(a.config)
    if a.command == "extract":
        api.extract_graphs(spark, c, a.output, a.force)
    elif a.command == "analyze":
        api.analyze_graphs(spark, c, a.output, a.force)
    elif a.command in ("report", "run"):
        api.report(spark, c, a.output, a.formats, force=a.force)
    elif a.command == "watch":
        for query in api.watch_workspace(spark, c, a.checkpoint, a.output, a.formats, a.once):
            query.awaitTermination()
    elif a.command == "check":
        ok, rows, _ = api.check(spark, c, Limits(a.max_cycles, a.max_hotspot_score), a.output)
        rows.show(truncate=False)
        return 0 if ok else 1
    elif a.command == "diff-live":
        parts = api.diff_live(spark, c, a.baseline, a.project)
        api.write_drift(parts, a.output or os.path.join(c.output, a.project))
        _say(reports.drift_markdown(parts))
    elif a.command == "consolidation":
        groups = api.consolidation(spark, c, a.output, a.min_group_size, a.ignore_allowlist, a.across)
        _say(reports.consolidation_json(groups, a.across) if a.format == "json" else reports.consolidation_markdown(groups, a.across))
    elif a.command == "suggest-stubs":
        found, seen = api.suggest_stubs(spark, c, a.output, a.min_edges, a.project)
        if a.apply:
            print("changed" if api.apply_stubs(a.config, found) else "nothing to add")
        else:
            _say(reports.stubs_json(found, seen) if a.format == "json" else reports.stubs_toml(found) if a.format == "toml" else reports.stubs_markdown(found, seen))
    elif a.command == "session-brief":
        text = api.session_brief(spark, a.output or c.output, [p.name for p in c.projects])
        sinks.write_lines([text], os.path.join(a.output or c.output, "session-brief.json"))
        print(text)
    return 0


def _tool_command(spark: SparkSession, a: argparse.Namespace) -> int:
    """Questions to the workspace as it is now, with default weights."""
    from depweave.operators.metrics import Weights

    tools = api.Tools(api.workspace(spark, config.load(a.config), weights=Weights()))
    if a.command == "session-scope":
        print(api.session_scope(tools, a.nodes))
        return 0
    if a.command == "shell":
        for line in sys.stdin:
            try:
                found = api.shell_line(tools, line)
                if found is not None:
                    found.show(truncate=False)
            except ValueError as wrong:
                print(wrong)
        return 0
    found = tools.search(a.pattern) if a.command == "search" else tools.explain(a.node) if a.command == "explain" else tools.path(a.start, a.end)
    if found.isEmpty():
        tools.suggest(getattr(a, "node", None) or getattr(a, "pattern", None) or a.start).show(truncate=False)
        return 1
    found.show(truncate=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "init":
        print(api.init(a.path))
        return 0
    spark = SparkSession.builder.appName("depweave").getOrCreate()
    if a.command == "diff":
        mirrors = api.mirror_index(config.load(a.config)) if os.path.exists(a.config) else None
        parts = api.diff(spark, a.before, a.after, mirrors=mirrors)
        if a.output:
            api.write_drift(parts, a.output)
        _say(reports.drift_markdown(parts))
    elif a.command == "compare":
        _say(api.compare(spark, a.left, a.right, form=a.format))
    elif a.command == "trend":
        parts = api.trend(spark, a.folder)
        api.write_trend(os.path.basename(os.path.abspath(a.folder)), parts, a.output or a.folder)
        _say(reports.trend_markdown(a.folder, parts))
    elif a.command == "pr-summary":
        print(api.pull_request(spark, a.folder, a.project))
    elif a.command in ("search", "explain", "path", "shell", "session-scope"):
        return _tool_command(spark, a)
    else:
        return _project_command(spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
