"""What changed between two snapshots. A snapshot is a set of tables keyed by project:

nodes(project, id, score, in_degree, out_degree, community_id), edges(project, src, dst, ...),
members(project, community_id, id), cycles(project, nodes).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP, THRESHOLD = 20, 0.05


@dataclass
class Snapshot:
    nodes: DataFrame
    edges: DataFrame
    members: DataFrame
    cycles: DataFrame


def _counts(s: Snapshot, name: str) -> DataFrame:
    one = lambda t, what: t.groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("project", F.lit(what).alias("what"), "n")
    parts = one(s.nodes, "nodes").unionByName(one(s.edges, "edges")).unionByName(one(s.members.select("project", "community_id").distinct(), "communities")).unionByName(one(s.cycles, "cycles"))
    return parts.withColumnRenamed("n", name)


def summary_delta(before: Snapshot, after: Snapshot) -> DataFrame:
    """(project, what, before, after, change) for nodes, edges, communities and cycles."""
    every = before.nodes.select("project").unionByName(after.nodes.select("project")).distinct().withColumn("what", F.explode(F.array(*map(F.lit, ("nodes", "edges", "communities", "cycles")))))
    both = every.join(_counts(before, "before"), ["project", "what"], "left").join(_counts(after, "after"), ["project", "what"], "left").na.fill(0)
    return both.withColumn("change", F.col("after") - F.col("before"))


def node_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project, id, change): 'added' or 'removed'. One outer join finds both."""
    both = before.select("project", "id", F.lit(1).alias("b")).join(after.select("project", "id", F.lit(1).alias("a")), ["project", "id"], "full_outer")
    return both.filter("a is null or b is null").select("project", "id", F.when(F.col("b").isNull(), "added").otherwise("removed").alias("change"))


def degree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project, id, in_degree, out_degree): the change of nodes in both whose degrees differ."""
    both = before.alias("b").join(after.alias("a"), ["project", "id"])
    out = both.select("project", "id", (F.col("a.in_degree") - F.col("b.in_degree")).alias("in_degree"), (F.col("a.out_degree") - F.col("b.out_degree")).alias("out_degree"))
    return out.filter("in_degree <> 0 or out_degree <> 0")


def _top(nodes: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "id"))
    return nodes.withColumn("r", rank).filter(F.col("r") <= n).select("project", "id")


def hotspot_changes(before: DataFrame, after: DataFrame, threshold: float = THRESHOLD, top: int = TOP, mirrors: dict[str, str] | None = None) -> DataFrame:
    """(project, id, bucket, before, after, delta[, intentional_mirror]): rising, falling, new and removed hotspots.

    Rising and falling: nodes in both whose score moved by the threshold or more (no move counts as falling).
    New and removed: differences of the two top lists, a missing score being 0. `mirrors`: the group
    of each id that is duplicated on purpose; intentional_mirror names it, or is null.
    """
    scores = before.select("project", "id", F.col("score").alias("before")).join(after.select("project", "id", F.col("score").alias("after")), ["project", "id"], "full_outer")
    moved = scores.filter("before is not null and after is not null").withColumn("delta", F.col("after") - F.col("before")).filter(F.abs("delta") >= threshold)
    moved = moved.select("project", "id", F.when(F.col("delta") > 0, "rising").otherwise("falling").alias("bucket"), "before", "after", "delta")
    old, new = _top(before, top), _top(after, top)
    known = scores.na.fill(0.0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))
    only = lambda a, b, name: known.join(a.join(b, ["project", "id"], "left_anti"), ["project", "id"], "left_semi").select("project", "id", F.lit(name).alias("bucket"), "before", "after", "delta")
    out = moved.unionByName(only(new, old, "new")).unionByName(only(old, new, "removed"))
    if not mirrors:
        return out
    index = out.sparkSession.createDataFrame(list(mirrors.items()), "id string, intentional_mirror string")
    return out.join(index, "id", "left").select(*out.columns, "intentional_mirror")


def cycle_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project, nodes, change): 'introduced' or 'resolved', as ordered lists."""
    cut = lambda a, b, name: a.select("project", "nodes").distinct().join(b.select("project", "nodes").distinct(), ["project", "nodes"], "left_anti").withColumn("change", F.lit(name))
    return cut(after, before, "introduced").unionByName(cut(before, after, "resolved"))


def matched_communities(before: DataFrame, after: DataFrame, prefer_same: bool = True, keep_unmatched: bool = True) -> DataFrame:
    """members tables -> (project, community_id, matched): of each later community the earlier one with the largest overlap.

    Ties go to the same number, else (prefer_same) to the lowest, or to the highest. Without any overlap the number
    itself stands (keep_unmatched).
    """
    common = before.select("project", "id", F.col("community_id").alias("old")).join(after.select("project", "id", "community_id"), ["project", "id"])
    shared = common.groupBy("project", "community_id", "old").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(-F.col("n"), (F.col("old") != F.col("community_id")).cast("int"), F.col("old")) if prefer_same else F.struct(-F.col("n"), -F.col("old"))
    best = shared.groupBy("project", "community_id").agg(F.min_by("old", order).alias("matched"))
    every = after.select("project", "community_id").distinct().join(best, ["project", "community_id"], "left")
    return every.withColumn("matched", F.coalesce("matched", "community_id")) if keep_unmatched else every


def community_moves(before: DataFrame, after: DataFrame, before_members: DataFrame, after_members: DataFrame) -> DataFrame:
    """(project, id, from_community, to_community, moved) of nodes in both snapshots."""
    matched = matched_communities(before_members, after_members)
    both = before.select("project", "id", F.col("community_id").alias("from_community")).join(after.select("project", "id", F.col("community_id").alias("to_community")), ["project", "id"])
    named = both.join(matched.withColumnRenamed("community_id", "to_community"), ["project", "to_community"], "left")
    return named.select("project", "id", "from_community", "to_community", (F.coalesce("matched", "to_community") != F.col("from_community")).alias("moved"))


def diff(before: Snapshot, after: Snapshot, threshold: float = THRESHOLD, mirrors: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All parts of a drift report by name."""
    return {
        "summary_delta": summary_delta(before, after),
        "nodes": node_changes(before.nodes, after.nodes),
        "degrees": degree_changes(before.nodes, after.nodes),
        "hotspots": hotspot_changes(before.nodes, after.nodes, threshold, mirrors=mirrors),
        "cycles": cycle_changes(before.cycles, after.cycles),
        "communities": community_moves(before.nodes, after.nodes, before.members, after.members),
    }
