"""Snapshots over time: building one, points, intervals, churn.

Long form of a history: points(project, captured_at, total_nodes, ...), nodes(project, captured_at, id, score,
community_id, ...), members(project, captured_at, community_id, id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depweave.schemas import CONFIDENCE_KINDS

TOP = 20
COUNTS = ("total_nodes", "total_edges", "total_communities", "total_cycles")


def confidence_summary(edges: DataFrame, by: tuple[str, ...] = ("project",)) -> DataFrame:
    """Counts and percentages of each confidence kind, and the mean confidence (0 without edges)."""
    name = {"Extracted": "extracted", "Inferred": "inferred", "Ambiguous": "ambiguous", "ExpectedExternal": "expected_external"}
    counts = [F.count_if(F.col("confidence_kind") == k).alias(f"{name[k]}_count") for k in CONFIDENCE_KINDS]
    out = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts, F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))
    for k in CONFIDENCE_KINDS:
        out = out.withColumn(f"{name[k]}_pct", F.when(F.col("n") > 0, F.col(f"{name[k]}_count") * 100.0 / F.col("n")).otherwise(0.0))
    return out.drop("n")


def latest(points: DataFrame, limit: int | None) -> DataFrame:
    """The last `limit` snapshots of each project by time."""
    if limit is None:
        return points
    order = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("captured_at")))
    return points.withColumn("__k", order).filter(F.col("__k") <= limit).drop("__k")


def intervals(points: DataFrame) -> DataFrame:
    """Each snapshot with the one before it: from_captured_at, to_captured_at and the change of all counts."""
    w = Window.partitionBy("project").orderBy("captured_at")
    lagged = points.select("project", "captured_at", *COUNTS, F.lag("captured_at").over(w).alias("from_captured_at"), *[F.lag(c).over(w).alias(f"before_{c}") for c in COUNTS])
    changed = lagged.filter("from_captured_at is not null")
    return changed.select("project", "from_captured_at", F.col("captured_at").alias("to_captured_at"), *[x for c in COUNTS for x in (F.col(f"before_{c}"), F.col(c).alias(f"after_{c}"), (F.col(c) - F.col(f"before_{c}")).alias(f"change_{c}"))])


def _steps(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("project").orderBy("captured_at")
    return points.select("project", F.lag("captured_at").over(w).alias("from_captured_at"), F.col("captured_at").alias("to_captured_at")).filter("from_captured_at is not null")


def _pairs(points: DataFrame, table: DataFrame, columns: list[str], how: str) -> DataFrame:
    """table rows of both ends of each interval side by side, by id: columns named old_... and new_...."""
    steps = F.broadcast(_steps(points)) if points.limit(10_001).count() <= 10_000 else _steps(points)
    side = lambda end, tag: table.withColumnRenamed("captured_at", end).join(steps, ["project", end]).select("project", "from_captured_at", "to_captured_at", "id", *[F.col(c).alias(f"{tag}_{c}") for c in columns])
    return side("from_captured_at", "old").join(side("to_captured_at", "new"), ["project", "from_captured_at", "to_captured_at", "id"], how)


def hotspot_deltas(points: DataFrame, top: DataFrame) -> DataFrame:
    """top(project, captured_at, id, score) -> (project, from_captured_at, to_captured_at, id, bucket, before, after): any move counts."""
    both = _pairs(points, top, ["score"], "full_outer")
    bucket = F.when(F.col("old_score").isNull(), "new").when(F.col("new_score").isNull(), "removed").when(F.col("new_score") > F.col("old_score"), "rising").when(F.col("new_score") < F.col("old_score"), "falling")
    return both.withColumn("bucket", bucket).filter("bucket is not null").select("project", "from_captured_at", "to_captured_at", "id", "bucket", F.col("old_score").alias("before"), F.col("new_score").alias("after"))


def churn(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project, from_captured_at, to_captured_at, moved_nodes, stable_nodes, churn_pct).

    A later community is matched with the earlier one of the largest overlap (ties: the highest number).
    """
    both = _pairs(points, nodes, ["community_id"], "inner")
    keys = ["project", "from_captured_at", "to_captured_at"]
    shared = both.groupBy(*keys, "new_community_id", "old_community_id").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy(*keys, "new_community_id").agg(F.min_by("old_community_id", F.struct(-F.col("n"), -F.col("old_community_id"))).alias("matched"))
    # moved and stable nodes follow from the shared counts: no need to look at single nodes again
    out = shared.join(best, [*keys, "new_community_id"]).groupBy(*keys).agg(F.sum(F.when(F.col("matched") != F.col("old_community_id"), F.col("n")).otherwise(0)).alias("moved_nodes"), F.sum(F.when(F.col("matched") == F.col("old_community_id"), F.col("n")).otherwise(0)).alias("stable_nodes"))
    return out.withColumn("churn_pct", F.col("moved_nodes") * 100.0 / (F.col("moved_nodes") + F.col("stable_nodes")))


def snapshot(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, members: DataFrame, cycles: DataFrame, captured_at: int) -> DataFrame:
    """One row a project in the shape of a history file (see schemas.HISTORY)."""
    count = lambda t, name: t.groupBy("project").agg(F.count(F.lit(1)).alias(name))
    total = count(nodes, "total_nodes").join(count(edges, "total_edges"), "project", "left").join(count(members.select("project", "community_id").distinct(), "total_communities"), "project", "left").join(count(cycles, "total_cycles"), "project", "left").na.fill(0)
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "id"))
    top = metrics.withColumn("k", rank).filter(F.col("k") <= TOP).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("k", "id", "score"))).alias("t")).select("project", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("top_hotspots"))
    rows = metrics.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("id", "score", "community_id", "in_degree", "out_degree", "in_cycle"))).alias("nodes"))
    groups = members.groupBy("project", F.col("community_id").alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("members"), F.max("cohesion").alias("cohesion") if "cohesion" in members.columns else F.lit(0.0).alias("cohesion")).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("id", "members", "cohesion"))).alias("communities"))
    sums = confidence_summary(edges)
    sums = sums.select("project", F.struct(*[c for c in sums.columns if c != "project"]).alias("confidence_summary"))
    out = total.join(top, "project", "left").join(sums, "project", "left").join(rows, "project", "left").join(groups, "project", "left")
    return out.select(F.lit(captured_at).cast("long").alias("captured_at"), "project", F.struct(*COUNTS).alias("summary"), "top_hotspots", "confidence_summary", "nodes", "communities")


def trend(points: DataFrame, top: DataFrame, nodes: DataFrame, limit: int | None = None) -> dict[str, DataFrame]:
    """Points, intervals, hotspot deltas and churn of the last snapshots; ValueError if there is none."""
    kept = latest(points, limit)
    if kept.isEmpty():
        raise ValueError("no historical snapshots available")
    return {"points": kept, "intervals": intervals(kept), "hotspots": hotspot_deltas(kept, top), "churn": churn(kept, nodes)}
