"""Edges worth a second look, duplicated symbols, stub candidates, coupling between projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depweave.functions.text import allowlisted, extract_prefix, leaf_symbol, stub_candidates, top_segment

HOT, FLOOR = 10, 3
PERIPHERAL, HUB = 2, 5


def top_of_each(metrics: DataFrame, n: int) -> DataFrame:
    """The rows (project, id) of the n highest scores of each project (ties by id): first in parts of a project, then of those."""
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    rank = lambda *keys: F.row_number().over(Window.partitionBy("project", *keys).orderBy(F.desc("score"), "id"))
    few = metrics.select("project", "id", "score", part.alias("part")).withColumn("r", rank("part")).filter(F.col("r") <= n)
    return few.withColumn("r", rank()).filter(F.col("r") <= n).select("project", "id")


def smells(edges: DataFrame, metrics: DataFrame, pairs: DataFrame, top: int | None = None, new_nodes: DataFrame | None = None) -> DataFrame:
    """edges with a score and reasons. metrics(project, id, score, in_degree, out_degree, community_id); pairs: cycle_pairs().

    Ambiguous 3, Inferred 2, Extracted 1; across communities 2; in a cycle 2; periphery to hub 1; touches one of the ten
    hottest nodes 1. Edges from 3 up; by score, edges at new nodes first, then by source and target.
    """
    hottest = top_of_each(metrics, HOT).select("project", "id", F.lit(True).alias("hot"))
    info = metrics.select("project", "id", (F.col("in_degree") + F.col("out_degree")).alias("degree"), F.coalesce("community_id", F.lit(0)).alias("c"))
    info = info.join(hottest, ["project", "id"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    side = lambda end, tag: info.select("project", F.col("id").alias(end), *[F.col(x).alias(f"{tag}_{x}") for x in ("degree", "c", "hot")])
    both = edges.join(side("src", "s"), ["project", "src"], "left").join(side("dst", "t"), ["project", "dst"], "left").na.fill({"s_degree": 0, "t_degree": 0, "s_c": 0, "t_c": 0, "s_hot": False, "t_hot": False})
    both = both.join(pairs.withColumn("looped", F.lit(True)), ["project", "src", "dst"], "left").withColumn("looped", F.coalesce("looped", F.lit(False)))
    bonus = F.when(F.col("confidence_kind") == "Ambiguous", 3).when(F.col("confidence_kind") == "Inferred", 2).when(F.col("confidence_kind") == "Extracted", 1).otherwise(0)
    across, hub = F.col("s_c") != F.col("t_c"), (F.least("s_degree", "t_degree") <= PERIPHERAL) & (F.greatest("s_degree", "t_degree") >= HUB)
    touches = F.col("s_hot") | F.col("t_hot")
    total = bonus + F.when(across, 2).otherwise(0) + F.when(F.col("looped"), 2).otherwise(0) + F.when(hub, 1).otherwise(0) + F.when(touches, 1).otherwise(0)
    reasons = F.array_compact(F.array(
        F.when(bonus > 0, F.concat(F.lit("low-confidence ("), F.col("confidence_kind"), F.lit(")"))),
        F.when(across, F.lit("cross-community")),
        F.when(F.col("looped"), F.lit("in-cycle")),
        F.when(hub, F.lit("peripheral→hub")),
        F.when(touches, F.concat(F.lit("touches hotspot `"), F.when(F.col("t_hot"), F.col("dst")).otherwise(F.col("src")), F.lit("`"))),
    ))
    out = both.withColumn("score", total).withColumn("reasons", reasons).filter(F.col("score") >= FLOOR)
    fresh = F.lit(False)
    if new_nodes is not None:
        new = new_nodes.select("project", "id").distinct().withColumn("n", F.lit(True))
        out = out.join(new.select("project", F.col("id").alias("src"), F.col("n").alias("s_new")), ["project", "src"], "left").join(new.select("project", F.col("id").alias("dst"), F.col("n").alias("t_new")), ["project", "dst"], "left")
        fresh = F.coalesce("s_new", F.lit(False)) | F.coalesce("t_new", F.lit(False))
    out = out.withColumn("drift_new", fresh).select("project", "src", "dst", "kind", "confidence", "confidence_kind", "score", "reasons", "drift_new")
    return out if top is None else out.orderBy(F.desc("score"), F.desc("drift_new"), "src", "dst", "kind").limit(top)


def consolidation(metrics: DataFrame, nodes: DataFrame, min_size: int = 2, patterns: list[str] | None = None, ignore_allowlist: bool = False, across: bool = False) -> DataFrame:
    """Nodes that share a leaf name: (project, leaf_name, group_size, allowlisted, members), largest groups first by size.

    `across`: groups over all projects, at least two of them, with project_count instead of project.
    """
    attributes = nodes.select("project", "id", "kind", "file_path", "line")
    rows = metrics.select("project", "id", F.col("in_degree").alias("fan_in")).join(attributes, ["project", "id"], "left").na.fill({"kind": "", "file_path": "", "line": 0}).withColumn("leaf_name", leaf_symbol(F.col("id")))
    order = F.struct((-F.col("fan_in")).alias("order"), *(["project"] if across else []), "id", "kind", "fan_in", F.col("file_path").alias("file"), "line")
    members = F.transform(F.array_sort(F.collect_list(order)), lambda m: m.dropFields("order")).alias("members")
    if across:
        out = rows.groupBy("leaf_name").agg(F.count(F.lit(1)).alias("group_size"), F.countDistinct("project").alias("project_count"), members).filter("project_count >= 2")
    else:
        out = rows.groupBy("project", "leaf_name").agg(F.count(F.lit(1)).alias("group_size"), members)
    out = out.filter(F.col("group_size") >= min_size).withColumn("allowlisted", allowlisted(F.col("leaf_name"), patterns or []))
    return out if ignore_allowlist else out.filter(~F.col("allowlisted"))


def suggest_stubs(nodes: DataFrame, links: DataFrame, stubs: DataFrame | None = None, local_prefixes: DataFrame | None = None, min_edges: int = 2) -> tuple[DataFrame, DataFrame]:
    """Prefixes of outside targets that could become stubs, and the state of all prefixes seen.

    Returns candidates(prefix, language, edge_weight, node_count, projects, example_nodes, scope) with scope 'settings'
    for two or more projects, else the project; and seen(state, prefix) with state 'covered' or 'shadowed'. The
    threshold holds for each project before projects are put together. stubs(project, prefix) are joined by the
    boundary prefixes of each target, an equi-join.
    """
    outside = links.join(nodes.select("project", F.col("id").alias("dst"), "language", "is_local"), ["project", "dst"]).filter("not is_local").select("project", "dst", "language", F.col("weight").cast("long").alias("weight"))
    shadow = nodes.filter("is_local").select(top_segment(F.col("id")).alias("prefix"))
    if local_prefixes is not None:
        shadow = shadow.unionByName(local_prefixes.filter("prefix <> ''").select("prefix"))
    shadow = shadow.filter("prefix is not null").distinct().withColumn("shadow", F.lit(True))
    if stubs is None:
        rest, covered = outside, None
    else:
        tried = outside.select("project", "dst").distinct().withColumn("prefix", F.explode(stub_candidates(F.col("dst"))))
        hit = tried.join(stubs.select("project", "prefix").distinct(), ["project", "prefix"]).groupBy("project", "dst").agg(F.max_by("prefix", F.length("prefix")).alias("stub"))
        rest = outside.join(hit, ["project", "dst"], "left_anti")
        covered = hit.select(F.lit("covered").alias("state"), F.col("stub").alias("prefix")).distinct()
    named = rest.withColumn("prefix", extract_prefix(F.col("dst"), F.col("language"))).filter("prefix is not null").join(shadow, "prefix", "left")
    shadowed = named.filter("shadow").select(F.lit("shadowed").alias("state"), "prefix").distinct()
    own = named.filter("shadow is null").groupBy("project", "prefix", "dst").agg(F.sum("weight").alias("weight"), F.min("language").alias("language"))
    project = own.groupBy("project", "prefix").agg(F.sum("weight").alias("weight"), F.collect_set("dst").alias("nodes"), F.min("language").alias("language")).filter(F.col("weight") >= min_edges)
    every = project.groupBy("prefix").agg(F.min_by("language", "project").alias("language"), F.sum("weight").alias("edge_weight"), F.array_sort(F.collect_set("project")).alias("projects"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("nodes")))).alias("nodes"))
    out = every.select("prefix", "language", "edge_weight", F.size("nodes").cast("long").alias("node_count"), "projects", F.slice("nodes", 1, 3).alias("example_nodes"), F.when(F.size("projects") >= 2, F.lit("settings")).otherwise(F.element_at("projects", 1)).alias("scope"))
    return out, shadowed if covered is None else covered.unionByName(shadowed)


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_project, to_project, edge_count, imports, defines, calls, shared_modules): edges whose target another project holds.

    All nodes count as held, placeholders too.
    """
    owners = nodes.select(F.col("project").alias("to_project"), F.col("id").alias("dst")).distinct()
    out = edges.select(F.col("project").alias("from_project"), "dst", "kind").join(owners, "dst").filter("from_project <> to_project")
    kind = lambda k: F.count_if(F.col("kind") == k).alias(k.lower())
    return out.groupBy("from_project", "to_project").agg(F.count(F.lit(1)).alias("edge_count"), kind("Imports"), kind("Defines"), kind("Calls"), F.countDistinct("dst").alias("shared_modules"))


def shared_modules(nodes: DataFrame) -> DataFrame:
    """(id, projects): ids that more than one project holds."""
    return nodes.groupBy("id").agg(F.array_sort(F.collect_set("project")).alias("projects")).filter(F.size("projects") > 1)


def workspace_summary(nodes: DataFrame, edges: DataFrame, members: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row a project and a total row (project null): nodes, edges, communities, cycles."""
    count = lambda t, n: t.groupBy("project").agg(F.count(F.lit(1)).alias(n))
    rows = count(nodes, "nodes").join(count(edges, "edges"), "project", "left").join(count(members.select("project", "community_id").distinct(), "communities"), "project", "left").join(count(cycles, "cycles"), "project", "left").na.fill(0)
    names = ("nodes", "edges", "communities", "cycles")
    return rows.rollup("project").agg(*[F.sum(n).alias(n) for n in names])
