"""The workspace file: TOML on the driver, checked before anything runs."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from depweave.functions.text import check_regex
from depweave.operators.metrics import Thresholds, Weights
from depweave.operators.policy import Group, Limits, Rule, compiled
from depweave.sources.files import LocalPrefix

FORMATS = ("json", "csv", "md", "html", "neo4j", "graphml", "obsidian")
DEFAULT_FORMATS = ("json", "csv", "md")
LANGUAGE_WORDS = {"python": "Python", "py": "Python", "typescript": "TypeScript", "ts": "TypeScript", "go": "Go", "rust": "Rust", "rs": "Rust", "php": "Php"}


@dataclass(frozen=True)
class Project:
    name: str
    repo: str
    languages: tuple[str, ...]
    local_prefix: LocalPrefix = LocalPrefix()
    stubs: tuple[str, ...] = ()
    limits: Limits = Limits()


@dataclass(frozen=True)
class Config:
    projects: tuple[Project, ...]
    output: str = "./report"
    exclude: tuple[str, ...] = ()
    formats: tuple[str, ...] = DEFAULT_FORMATS
    weights: Weights = Weights()
    thresholds: Thresholds = Thresholds()
    stubs: tuple[str, ...] = ()
    allowlist: tuple[str, ...] = ()
    intentional_mirrors: dict[str, tuple[str, ...]] = field(default_factory=dict)
    suppress_barrel_cycles: bool = False
    workspace_reexports: bool = True
    groups: tuple[Group, ...] = ()
    rules: tuple[Rule, ...] = ()
    contracts: dict = field(default_factory=dict)


def first_given(*values):
    """Command line before file before default."""
    return next((v for v in values if v is not None), None)


def parse_weights(text: str) -> Weights:
    """Four numbers: betweenness, pagerank, in-degree, in-cycle."""
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4:
        raise ValueError("weights are four numbers: betweenness,pagerank,in_degree,in_cycle")
    return Weights(*parts)


def parse_formats(text: str) -> tuple[str, ...]:
    out = tuple(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))
    if unknown := [x for x in out if x not in FORMATS]:
        raise ValueError(f"unknown formats: {', '.join(unknown)}")
    return out


def _project(raw: dict) -> Project:
    limits = raw.get("check") or {}
    if unknown := set(limits) - {"max_cycles", "max_hotspot_score"}:
        raise ValueError(f"unknown keys in [project.check]: {', '.join(sorted(unknown))}")
    words = raw.get("lang") or []
    if not words or any(w.lower() not in LANGUAGE_WORDS for w in words):
        raise ValueError(f"project {raw.get('name')!r}: unknown or missing lang {words!r}")
    return Project(raw["name"], raw["repo"], tuple(dict.fromkeys(LANGUAGE_WORDS[w.lower()] for w in words)), LocalPrefix.of(raw.get("local_prefix")), tuple(raw.get("external_stubs") or ()), Limits(limits.get("max_cycles"), limits.get("max_hotspot_score")))


def parse(text: str) -> Config:
    """A checked Config; ValueError says what is wrong."""
    raw = tomllib.loads(text)
    settings, merge, rules = raw.get("settings") or {}, raw.get("consolidation") or {}, raw.get("policy") or {}
    projects = tuple(_project(p) for p in raw.get("project") or [])
    if not projects:
        raise ValueError("a workspace needs at least one [[project]]")
    groups = tuple(Group(g["name"], tuple(g.get("match") or ()), tuple(g.get("projects") or ()), g.get("partition_by")) for g in rules.get("group") or [])
    found = tuple(
        Rule(r["name"], tuple(r.get("from") or ()), tuple(r.get("to") or ()), r.get("kind", "deny"), tuple(r.get("except_from") or ()), tuple(r.get("except_to") or ()), bool(r.get("except_same_project")), bool(r.get("allow_same_partition")))
        for r in rules.get("rule") or []
    )
    compiled(list(groups), list(found))
    hot = settings.get("hotspots") or {}
    weights = settings.get("weights")
    return Config(
        projects,
        settings.get("output", "./report"),
        tuple(settings.get("exclude") or ()),
        tuple(settings["format"]) if settings.get("format") else DEFAULT_FORMATS,
        Weights(*weights) if weights else Weights(),
        Thresholds(hot.get("hub_threshold", Thresholds.hub), hot.get("bridge_ratio", Thresholds.bridge_ratio)),
        tuple(settings.get("external_stubs") or ()),
        tuple(check_regex(x) for x in merge.get("allowlist") or ()),
        {k: tuple(v) for k, v in (merge.get("intentional_mirrors") or {}).items()},
        bool(merge.get("suppress_barrel_cycles")),
        settings.get("workspace_reexport_graph") is not False,
        groups,
        found,
        raw.get("contract") or {},
    )


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as lines:
        return parse(lines.read())


def barrel_exclusions(config: Config, project: Project) -> list[str]:
    """The prefix as an id to keep out of cycles: only if asked for, with a prefix that the allowlist names."""
    import re

    from depweave.functions.text import anchored

    if not config.suppress_barrel_cycles:
        return []
    return [p for p in project.local_prefix.values if any(re.search(anchored(a), p) for a in config.allowlist)]
