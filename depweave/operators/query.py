"""Questions to a graph: search, neighbours, paths, reach, explanation."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depweave.functions.text import glob_match
from depweave.plans.staging import discard, stage

TRANSITIVE_DEPTH, PATH_DEPTH, MAX_PATHS = 10, 10, 20
#: Levels of a long search that are read apart; more are written together.
MERGE_LEVELS = 16


def stats(nodes: DataFrame, edges: DataFrame, assignment: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row a project: total_nodes, total_edges, local_nodes, communities, cycles."""
    n = nodes.groupBy("project").agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if("is_local").alias("local_nodes"))
    e = edges.groupBy("project").agg(F.count(F.lit(1)).alias("total_edges"))
    c = assignment.groupBy("project").agg(F.countDistinct("community_id").alias("communities"))
    y = cycles.groupBy("project").agg(F.count(F.lit(1)).alias("cycles"))
    out = reduce(lambda a, b: a.join(b, "project", "left"), (e, c, y), n)
    return out.na.fill(0).select("project", "total_nodes", "total_edges", "local_nodes", "communities", "cycles")


def search(nodes: DataFrame, metrics: DataFrame, pattern: str, kind: str | None = None, local_only: bool = False, sort: str = "score", assignment: DataFrame | None = None, min_confidence: float | None = None) -> DataFrame:
    """Nodes whose id matches a glob, with metrics; sort: 'score', 'name' or 'in_degree'. min_confidence is accepted and has no effect."""
    found = nodes.filter(glob_match(F.col("id"), pattern))
    if kind:
        found = found.filter(F.col("kind") == kind)
    if local_only:
        found = found.filter("is_local")
    known = [c for c in ("score", "in_degree", "out_degree", "in_cycle", "community_id") if c in metrics.columns]
    out = found.select("project", "id", "kind", "file_path", "is_local").join(metrics.select("project", "id", *known), ["project", "id"], "left")
    if assignment is not None:
        out = out.drop("community_id").join(assignment, ["project", "id"], "left")
    out = out.na.fill({k: v for k, v in {"score": 0.0, "in_degree": 0, "out_degree": 0, "in_cycle": False}.items() if k in known})
    order = {"score": [F.desc("score"), "id"], "name": ["id"], "in_degree": [F.desc("in_degree"), "id"]}[sort]
    return out.orderBy(*order)


def suggest(nodes: DataFrame, text: str, n: int = 3) -> DataFrame:
    """The first n ids that contain a text, whatever the case."""
    return nodes.filter(F.lower("id").contains(text.lower())).select("id").distinct().orderBy("id").limit(n)


def dependents(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("dst") == node).select("project", F.col("src").alias("id"), "kind", "confidence", "confidence_kind")


def dependencies(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("src") == node).select("project", F.col("dst").alias("id"), "kind", "confidence", "confidence_kind")


def reach(edges: DataFrame, starts: DataFrame, depth: int | None, backwards: bool = False) -> DataFrame:
    """(project, start, id, depth): the least number of hops from each start(project, id), up to `depth` (None: all); starts themselves at 0.

    Level by level: a join with the links, an anti-join with what was seen. Each level is written once.
    """
    a, b = ("dst", "src") if backwards else ("src", "dst")
    links = stage(edges.select("project", F.col(a).alias("id"), F.col(b).alias("next")).distinct(), "reach-links")
    level = stage(starts.select("project", F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("depth")).distinct(), "reach")
    seen = [level]
    for d in count(1) if depth is None else range(1, depth + 1):
        if len(seen) > MERGE_LEVELS:
            merged = stage(reduce(DataFrame.unionByName, seen), "reach")
            for x in seen[:-1]:  # the last is still the frontier
                discard(x)
            seen = [merged]
        known = reduce(DataFrame.unionByName, seen).select("project", "start", "id")
        new = level.join(links, ["project", "id"]).select("project", "start", F.col("next").alias("id")).distinct().join(known, ["project", "start", "id"], "left_anti")
        level = stage(new.withColumn("depth", F.lit(d).cast("long")), "reach")
        if level.isEmpty():
            discard(level)
            break
        seen.append(level)
    return reduce(DataFrame.unionByName, seen)


def transitive_dependents(edges: DataFrame, node: str, depth: int = TRANSITIVE_DEPTH) -> DataFrame:
    """(project, id, depth): who depends on a node within `depth` hops; the node itself is left out."""
    starts = edges.filter(F.col("dst") == node).select("project", F.lit(node).alias("id")).distinct()
    return reach(edges, starts, depth, backwards=True).filter("depth > 0").select("project", "id", "depth")


def shortest_path(edges: DataFrame, nodes: DataFrame, start: str, end: str, most: int | None = None) -> DataFrame:
    """(project, step, id, kind, weight): a path of fewest hops; the last step has no kind and weight 0. Empty if there is none.

    Paths of any length are found, or with `most` those of so many hops at most. Among equal paths the one
    through the least ids is taken (and of two kinds, the least).
    """
    known = nodes.filter(F.col("id").isin(start, end)).groupBy("project").agg(F.collect_set("id").alias("ids")).filter(F.size("ids") == len({start, end})).select("project")
    starts = known.select("project", F.lit(start).alias("id"))
    links = stage(edges.join(known, "project", "left_semi"), "path-links")
    back = stage(reach(links, known.select("project", F.lit(end).alias("id")), most, backwards=True).select("project", "id", "depth"), "path-depth")
    here = stage(starts.join(back, ["project", "id"]).select("project", F.col("depth").alias("left"), F.array(F.struct("id", F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("weight"))).alias("steps")), "path")
    hops = here.agg(F.max("left")).first()[0]
    for _ in range(hops or 0):
        ahead = here.filter("left > 0").withColumn("src", F.element_at("steps", -1)["id"]).join(links.select("project", "src", "dst", "kind", "weight"), ["project", "src"])
        good = ahead.join(back.select("project", F.col("id").alias("dst"), "depth"), ["project", "dst"]).filter("depth = left - 1")
        best = good.groupBy("project").agg(F.min_by(F.struct("steps", "dst", "kind", "weight"), F.struct("dst", "kind")).alias("b"), F.first("left").alias("left"))
        done = F.slice("b.steps", F.lit(1), F.size("b.steps") - 1)
        last = F.struct(F.element_at("b.steps", -1)["id"].alias("id"), F.col("b.kind").alias("kind"), F.col("b.weight").alias("weight"))
        tail = F.struct(F.col("b.dst").alias("id"), F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("weight"))
        new = best.select("project", (F.col("left") - 1).alias("left"), F.concat(done, F.array(last, tail)).alias("steps"))
        here = stage(here.filter("left = 0").unionByName(new), "path")
    return here.select("project", F.posexplode("steps").alias("step", "s")).select("project", "step", "s.id", "s.kind", "s.weight")


def all_paths(edges: DataFrame, start: str, end: str, depth: int = PATH_DEPTH, most: int | None = MAX_PATHS) -> DataFrame:
    """(project, nodes): paths of at most `depth` hops that meet no node twice (but may return to the end, where they stop).

    `most` is the report's cap, project by project, the shortest paths first; None gives all. A project is left alone
    when it has so many, and a path goes on only to nodes that reach the end in the hops left. With start = end the
    paths are cycles through the node.
    """
    links = stage(edges.select("project", "src", "dst").distinct(), "path-links")
    ends = links.filter(F.col("dst") == end).select("project", F.lit(end).alias("id")).distinct()
    near = stage(reach(links, ends, depth, backwards=True).select("project", F.col("id").alias("dst"), "depth"), "path-depth")
    links = stage(links.join(near, ["project", "dst"]), "path-links")
    level = stage(links.filter((F.col("src") == start) & (F.col("depth") < depth)).select("project", F.array("src", "dst").alias("nodes")), "paths")
    found = []
    for d in range(1, depth + 1):
        found.append(level.filter(F.element_at("nodes", -1) == end))
        if d == depth:
            break
        open_paths = level.filter(F.element_at("nodes", -1) != end).withColumn("src", F.element_at("nodes", -1))
        if most is not None:
            full = reduce(DataFrame.unionByName, found).groupBy("project").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most)
            open_paths = open_paths.join(full.select("project"), "project", "left_anti")
        step = open_paths.join(links, ["project", "src"]).filter(F.col("depth") < depth - d).filter(~F.array_contains("nodes", F.col("dst")) | (F.col("dst") == end))
        level = stage(step.select("project", F.concat("nodes", F.array("dst")).alias("nodes")), "paths")
        if level.isEmpty():
            break
    out = reduce(DataFrame.unionByName, found)
    if most is None:
        return out
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.size("nodes"), "nodes"))
    return out.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__rank").orderBy(F.size("nodes"), "nodes")


def explain(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, assignment: DataFrame, cycles: DataFrame, node: str, shown: int = 10) -> DataFrame:
    """One row a project that has the node: node, metrics, cycle peers, both adjacencies, how many depend on it and the first of them."""
    me = nodes.filter(F.col("id") == node).select("project", "id", "kind", "file_path", "language").join(metrics, ["project", "id"], "left").drop("community_id").join(assignment, ["project", "id"], "left")
    peers = cycles.filter(F.array_contains("nodes", node)).select("project", F.explode("nodes").alias("peer")).filter(F.col("peer") != node).groupBy("project").agg(F.array_sort(F.collect_set("peer")).alias("cycle_peers"))
    side = lambda t, name: t.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("id", "kind", "confidence", "confidence_kind"))).alias(name))
    reached = transitive_dependents(edges, node)
    total = reached.groupBy("project").agg(F.count(F.lit(1)).alias("transitive_dependent_count"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("depth", "id"))), lambda x: x["id"]), 1, shown).alias("top_transitive_dependents"))
    out = reduce(lambda a, b: a.join(b, "project", "left"), (peers, side(dependencies(edges, node), "direct_dependencies"), side(dependents(edges, node), "direct_dependents"), total), me)
    return out.withColumn("transitive_dependent_count", F.coalesce("transitive_dependent_count", F.lit(0)))
