"""Declarative import rules between groups of modules, and limit gates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions.text import glob_match, segment


@dataclass(frozen=True)
class Group:
    name: str
    match: tuple[str, ...]
    projects: tuple[str, ...] = ()
    partition_by: str | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    sources: tuple[str, ...]
    targets: tuple[str, ...]
    kind: str = "deny"
    except_sources: tuple[str, ...] = ()
    except_targets: tuple[str, ...] = ()
    except_same_project: bool = False
    allow_same_partition: bool = False


class PolicyError(ValueError):
    pass


def partition_index(text: str | None) -> int | None:
    if text is None:
        return None
    if not (m := re.fullmatch(r"segment:(\d+)", text)):
        raise PolicyError(f"unsupported partition_by {text!r}; segment:<index> is")
    return int(m[1])


def parse_selector(text: str, groups: dict[str, Group]) -> tuple[str, str]:
    kind, _, value = text.partition(":")
    if kind == "group" and value:
        if value not in groups:
            raise PolicyError(f"unknown policy group in {text!r}")
    elif kind != "project" or not value:
        raise PolicyError(f"unsupported selector {text!r}; group:<name> and project:<glob> are")
    return kind, value


def compiled(groups: list[Group], rules: list[Rule]) -> dict[str, Group]:
    """The groups by name, after all names, selectors and partitions were checked."""
    by_name: dict[str, Group] = {}
    for g in groups:
        if not g.name or not g.match:
            raise PolicyError("a policy group needs a name and patterns")
        if g.name in by_name:
            raise PolicyError(f"policy group {g.name!r} is given twice")
        partition_index(g.partition_by)
        by_name[g.name] = g
    names = set()
    for r in rules:
        if not r.name or r.name in names:
            raise PolicyError(f"policy rule name {r.name!r} is empty or given twice")
        names.add(r.name)
        if r.kind != "deny":
            raise PolicyError(f"unsupported rule kind {r.kind!r}")
        if not r.sources or not r.targets:
            raise PolicyError(f"rule {r.name!r} needs sources and targets")
        for s in (*r.sources, *r.targets, *r.except_sources, *r.except_targets):
            parse_selector(s, by_name)
    return by_name


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _selects(selector: str, groups: dict[str, Group], node: Column, project: Column) -> Column:
    kind, value = parse_selector(selector, groups)
    if kind == "project":
        return glob_match(project, value)
    g = groups[value]
    own = _any([glob_match(project, p) for p in g.projects]) if g.projects else F.lit(True)
    return own & _any([glob_match(node, p) for p in g.match])


def evaluate(nodes: DataFrame, edges: DataFrame, groups: list[Group], rules: list[Rule]) -> DataFrame:
    """Violations (rule, source_node, target_node, source_project, target_project, source_selectors, target_selectors).

    Imports edges between Module nodes count. A target belongs to all projects that hold it as a local node, else to
    the edge's own. The configured selectors are few, so they become one array literal of conditions in the plan: no
    join with the rules, and each rule is tested in the same pass over the edges.
    """
    by_name = compiled(groups, rules)
    modules = nodes.filter("kind = 'Module'").select("project", "id").distinct()
    imports = edges.filter("kind = 'Imports'").select("project", "src", "dst")
    imports = imports.join(modules.withColumnRenamed("id", "src"), ["project", "src"], "left_semi").join(modules.withColumnRenamed("id", "dst"), ["project", "dst"], "left_semi")
    owners = nodes.filter("is_local").select(F.col("id").alias("dst"), F.col("project").alias("owner")).distinct()
    owned = imports.join(owners, "dst", "left").withColumn("owner", F.coalesce("owner", "project"))

    def matches(selectors: tuple[str, ...], node: Column, project: Column) -> Column:
        return F.array_compact(F.array(*[F.when(_selects(s, by_name, node, project), F.lit(s)) for s in selectors]))

    found = []
    for r in rules:
        a, b = matches(r.sources, F.col("src"), F.col("project")), matches(r.targets, F.col("dst"), F.col("owner"))
        test = (F.size(a) > 0) & (F.size(b) > 0)
        if r.except_same_project:
            test = test & (F.col("project") != F.col("owner"))
        if r.except_sources:
            test = test & ~_any([_selects(s, by_name, F.col("src"), F.col("project")) for s in r.except_sources])
        if r.except_targets:
            test = test & ~_any([_selects(s, by_name, F.col("dst"), F.col("owner")) for s in r.except_targets])
        if r.allow_same_partition:
            shared = []
            for s in {*r.sources} & {*r.targets}:
                kind, value = parse_selector(s, by_name)
                at = partition_index(by_name[value].partition_by) if kind == "group" else None
                if at is not None:
                    same = (segment(F.col("src"), at) == segment(F.col("dst"), at)) & (F.col("src") != F.col("dst"))
                    shared.append(F.coalesce(same, F.lit(False)) & _selects(s, by_name, F.col("src"), F.col("project")) & _selects(s, by_name, F.col("dst"), F.col("owner")))
            test = test & ~_any(shared)
        found.append(F.when(test, F.struct(F.lit(r.name).alias("rule"), F.array_sort(F.array_distinct(a)).alias("source_selectors"), F.array_sort(F.array_distinct(b)).alias("target_selectors"))))
    if not found:
        return owned.limit(0).select(F.lit("").alias("rule"), F.col("src").alias("source_node"), F.col("dst").alias("target_node"), F.col("project").alias("source_project"), F.col("owner").alias("target_project"))
    hits = owned.withColumn("v", F.explode(F.array_compact(F.array(*found))))
    return hits.select("v.rule", F.col("src").alias("source_node"), F.col("dst").alias("target_node"), F.col("project").alias("source_project"), F.col("owner").alias("target_project"), "v.source_selectors", "v.target_selectors")


@dataclass(frozen=True)
class Limits:
    max_cycles: int | None = None
    max_hotspot_score: float | None = None

    def over(self, project: Limits | None) -> Limits:
        """These limits with those of a project, which win, laid over them."""
        p = project or Limits()
        return Limits(self.max_cycles if p.max_cycles is None else p.max_cycles, self.max_hotspot_score if p.max_hotspot_score is None else p.max_hotspot_score)


def gates(metrics: DataFrame, edges: DataFrame, members: DataFrame, cycles: DataFrame, limits: Limits, projects: dict[str, Limits] | None = None, allowlist: Column | None = None) -> DataFrame:
    """One row a project: counts, the highest score (allow-listed nodes left out), its node, and which limits it is above."""
    count = lambda t, n: t.groupBy("project").agg(F.count(F.lit(1)).alias(n))
    rated = metrics if allowlist is None else metrics.filter(~allowlist)
    top = rated.groupBy("project").agg(F.max("score").alias("max_hotspot_score"), F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("max_hotspot_id"))
    out = count(metrics, "nodes").join(count(edges, "edges"), "project", "left").join(count(members.select("project", "community_id").distinct(), "communities"), "project", "left").join(count(cycles, "cycles"), "project", "left").na.fill(0).join(top, "project", "left").na.fill(0.0, ["max_hotspot_score"])

    def limit(name: str, kind: str) -> Column:
        value = F.lit(getattr(limits, name)).cast(kind)
        for project, own in (projects or {}).items():
            value = F.when(F.col("project") == project, F.lit(getattr(limits.over(own), name)).cast(kind)).otherwise(value)
        return value

    out = out.withColumn("limit_cycles", limit("max_cycles", "long")).withColumn("limit_score", limit("max_hotspot_score", "double"))
    out = out.withColumn("cycles_violated", F.coalesce(F.col("cycles") > F.col("limit_cycles"), F.lit(False))).withColumn("score_violated", F.coalesce(F.col("max_hotspot_score") > F.col("limit_score"), F.lit(False)))
    return out.withColumn("ok", ~(F.col("cycles_violated") | F.col("score_violated")))


def check_report(gate_rows: DataFrame, violations: DataFrame, rules: int, contract_errors: int = 0) -> DataFrame:
    """One row a project (project, ok, violations, policy_violations, rules_evaluated) and a total row with a null project."""
    policy = violations.groupBy(F.col("source_project").alias("project")).agg(F.count(F.lit(1)).alias("policy_violations"))
    rows = gate_rows.join(policy, "project", "left").na.fill(0, ["policy_violations"])
    rows = rows.withColumn("violations", F.col("cycles_violated").cast("long") + F.col("score_violated").cast("long") + F.col("policy_violations"))
    rows = rows.select("project", (F.col("violations") == 0).alias("ok"), "violations", "policy_violations", F.lit(rules).cast("long").alias("rules_evaluated"))
    total = rows.agg((F.coalesce(F.bool_and("ok"), F.lit(True)) & F.lit(contract_errors == 0)).alias("ok"), (F.coalesce(F.sum("violations"), F.lit(0)) + contract_errors).alias("violations"), F.coalesce(F.sum("policy_violations"), F.lit(0)).alias("policy_violations"), F.lit(rules).cast("long").alias("rules_evaluated"))
    return rows.unionByName(total.select(F.lit(None).cast("string").alias("project"), "ok", "violations", "policy_violations", "rules_evaluated"))
