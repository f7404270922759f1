"""Node metrics: degrees, PageRank, betweenness, the composite score and hotspot classes.

PageRank and betweenness have two programs with the same results: one task a project while a project's nodes and edges
are few enough for a task (checked project by project), and a distributed iteration on DataFrames beyond that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depweave.operators.centrality import dependencies, local_order
from depweave.operators.model import scoring_view
from depweave.plans.staging import NUMBER_ROWS, by_size, discard, numbered, per_project, stage, unpacked


@dataclass(frozen=True)
class Weights:
    betweenness: float = 0.4
    pagerank: float = 0.2
    in_degree: float = 0.2
    in_cycle: float = 0.2


@dataclass(frozen=True)
class Thresholds:
    hub: int = 50
    bridge_ratio: float = 3000.0


DAMPING, MAX_ROUNDS, TOLERANCE = 0.85, 100, 1e-6
#: States (source and node) that a task of betweenness holds at once, 40 bytes each.
STATES = 4_000_000
#: Sources times edges of one task of betweenness; a project has 8 tasks or more, unless they are short, and at most 256.
TASK_WORK, TASK_SOURCES = 4_000_000_000, 192


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, id, in_degree, out_degree) of all nodes: incident records, one for each kind, whatever their weight.

    Both directions are counted in one shuffle.
    """
    ends = edges.select("project", F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    counts = ends.groupBy("project", F.col("e.id").alias("id")).agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    return nodes.select("project", "id").join(counts, ["project", "id"], "left").select("project", "id", F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"))


def normalize(table: DataFrame, columns: list[str]) -> DataFrame:
    """norm_<column> for each column: one small aggregate a project, joined back, so no project is sorted as a whole."""
    ends = table.groupBy("project").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    both = table.join(F.broadcast(ends), "project") if ends.limit(10_001).count() <= 10_000 else table.join(ends, "project")
    for c in columns:
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        both = both.withColumn(f"norm_{c}", F.when(span > 0, (F.col(c) - F.col(f"lo_{c}")) / span).otherwise(F.lit(0.0))).drop(f"lo_{c}", f"hi_{c}")
    return both


def classify(in_degree: Column, betweenness: Column, thresholds: Thresholds = Thresholds()) -> Column:
    hub = in_degree > thresholds.hub
    bridge = betweenness / F.greatest(in_degree, F.lit(1)) > thresholds.bridge_ratio
    return F.when(hub & ~bridge, "hub").when(bridge & ~hub, "bridge").otherwise("mixed")


def _positions(ids: pd.Series, edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ids and the edge ends as their positions."""
    order = np.unique(ids.to_numpy(dtype=object).astype(str)) if len(ids) else np.zeros(0, dtype=object)
    find = lambda c: np.searchsorted(order, edges[c].to_numpy(dtype=object).astype(str))
    return order, find("src") if len(edges) else np.zeros(0, int), find("dst") if len(edges) else np.zeros(0, int)


def pagerank_kernel(src: np.ndarray, dst: np.ndarray, n: int, damping: float, rounds: int, tolerance: float) -> np.ndarray:
    out = np.bincount(src, minlength=n).astype(float)
    rank, idle = np.full(n, 1.0 / max(n, 1)), out == 0
    share = np.divide(1.0, out, out=np.zeros(n), where=~idle)
    for _ in range(rounds):
        new = (1 - damping) / n + damping * (np.bincount(dst, weights=(rank * share)[src], minlength=n) + rank[idle].sum() / n)
        moved = np.abs(new - rank).sum()
        rank = new
        if moved < tolerance:
            break
    return rank


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE, distributed: bool | None = None) -> DataFrame:
    """(project, id, pagerank). Parallel edges count, weights do not; idle nodes spread their rank over all nodes."""
    def kernel(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids, src, dst = _positions(v["id"], e)
        return pd.DataFrame({"project": v["project"].iloc[0] if len(v) else None, "id": ids, "pagerank": pagerank_kernel(src, dst, len(ids), damping, rounds, tolerance)})

    small = lambda v, e: per_project(v, e, kernel, "project string, id string, pagerank double")
    middle = lambda v, e: _pagerank_by_number(v, e, damping, rounds, tolerance)
    rest = lambda v, e: _pagerank_by_rounds(v, e, damping, rounds, tolerance)
    large = lambda v, e: by_size(v, e, middle, rest, distributed, NUMBER_ROWS)
    return by_size(nodes.select("project", "id"), edges.select("project", "src", "dst"), small, large, distributed)


def _pagerank_by_number(nodes: DataFrame, edges: DataFrame, damping: float, rounds: int, tolerance: float) -> DataFrame:
    """One task a project too, which gets the edges as numbers; without edges all nodes have the same rank."""
    numbers, packed = numbered(nodes, edges)
    size = numbers.groupBy("project").agg(F.count(F.lit(1)).alias("n"))

    def kernel(parts: pd.DataFrame) -> pd.DataFrame:
        src, dst = unpacked(parts["data"])
        rank = pagerank_kernel(src, dst, int(parts["n"].iloc[0]), damping, rounds, tolerance)
        return pd.DataFrame({"project": parts["project"].iloc[0], "k": np.arange(len(rank)), "r": rank})

    ranks = packed.join(size, "project").groupBy("project").applyInPandas(kernel, "project string, k int, r double")
    return numbers.join(size, "project").join(ranks, ["project", "k"], "left").select("project", "id", F.coalesce("r", 1.0 / F.col("n")).alias("pagerank"))


def _pagerank_by_rounds(nodes: DataFrame, edges: DataFrame, damping: float, rounds: int, tolerance: float) -> DataFrame:
    out = edges.groupBy("project", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    size = nodes.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    fixed = stage(nodes.join(out, ["project", "id"], "left").join(size, "project"), "pagerank-nodes")
    links = stage(edges.repartition("project", "src"), "pagerank-edges")
    rank = stage(fixed.select("project", "id", "out", "n", (1.0 / F.col("n")).alias("r"), F.lit(0.0).alias("d")), "pagerank-0")
    for _ in range(rounds):
        given = links.join(rank.filter("out is not null").select("project", F.col("id").alias("src"), (F.col("r") / F.col("out")).alias("g")), ["project", "src"]).groupBy("project", F.col("dst").alias("id")).agg(F.sum("g").alias("g"))
        idle = rank.filter("out is null").groupBy("project").agg(F.sum("r").alias("i"))
        new = rank.join(given, ["project", "id"], "left").join(idle, "project", "left")
        value = (1 - damping) / F.col("n") + damping * (F.coalesce("g", F.lit(0.0)) + F.coalesce("i", F.lit(0.0)) / F.col("n"))
        old, rank = rank, stage(new.select("project", "id", "out", "n", value.alias("r"), F.abs(value - F.col("r")).alias("d")), "pagerank")
        discard(old)
        if tolerance > 0 and (rank.groupBy("project").agg(F.sum("d").alias("d")).agg(F.max("d")).first()[0] or 0) < tolerance:
            break
    return rank.select("project", "id", F.col("r").alias("pagerank"))


def sampled_sources(nodes: DataFrame, sources: int | None = None) -> DataFrame:
    """(project, id, scale): all nodes of a project, or the `sources` with the least hash and the factor for the rest."""
    if sources is None:
        return nodes.select("project", "id", F.lit(1.0).alias("scale"))
    size = nodes.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    least = nodes.select("project", F.xxhash64("id", F.lit(42)).alias("h"), "id")
    rank = F.row_number().over(Window.partitionBy("project").orderBy("h", "id"))
    return least.withColumn("k", rank).filter(F.col("k") <= sources).join(size, "project").select("project", "id", (F.col("n") / F.least("n", F.lit(sources))).alias("scale"))


def betweenness(nodes: DataFrame, edges: DataFrame, sources: int | None = None, batch: int | None = None, distributed: bool | None = None) -> DataFrame:
    """(project, id, betweenness): directed, by hops, not normalised; over all sources unless a number of them is given.

    Batches of sources run in parallel; each task holds the edges of one project as numbers (how many is checked). Larger
    projects go level by level through joins instead.
    """
    small = lambda v, e: _betweenness_by_batches(v, e, sampled_sources(v, sources), batch)
    large = lambda v, e: _betweenness_by_levels(v, e, sampled_sources(v, sources))
    return by_size(nodes.select("project", "id"), edges.select("project", "src", "dst"), small, large, distributed, NUMBER_ROWS)


def _betweenness_by_batches(nodes: DataFrame, edges: DataFrame, start: DataFrame, batch: int | None) -> DataFrame:
    ends = edges.select("project", F.explode(F.array("src", "dst")).alias("id"))
    numbers, packed = numbered(nodes.unionByName(ends), edges)

    def place(parts: pd.DataFrame) -> pd.DataFrame:
        src, dst = unpacked(parts["data"])
        order = local_order(src, dst, int(max(src.max(), dst.max())) + 1)
        return pd.DataFrame({"project": parts["project"].iloc[0], "k": order, "at": np.arange(len(order)), "m": len(src)})

    # sources that lie close together go to one task; nodes without edges are no sources
    placed = packed.groupBy("project").applyInPandas(place, "project string, k int, at int, m long")
    own = start.join(numbers, ["project", "id"]).join(placed, ["project", "k"])
    n = F.count(F.lit(1)).over(Window.partitionBy("project"))
    size = F.lit(batch) if batch else F.greatest(F.least(F.ceil(TASK_WORK / F.col("m")), F.greatest(F.lit(TASK_SOURCES), F.ceil(n / 8))), F.ceil(n / 256))
    at = F.floor((F.row_number().over(Window.partitionBy("project").orderBy("at")) - 1) / size)
    work = own.withColumn("batch", at).groupBy("project", "batch").agg(F.collect_list("k").alias("sources"), F.max("scale").alias("scale"))
    work = stage(work, "bc-work")
    parts = packed.join(work.select("project", F.col("batch").alias("part")), "project")
    tasks = min(2_000, 4 * work.count() + 1)  # given, so that small batches are not put into one task again

    def run(key: tuple, own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(edges):
            return pd.DataFrame({"project": np.zeros(0, object), "k": np.zeros(0, int), "betweenness": np.zeros(0)})
        src, dst = unpacked(edges["data"])
        sources = np.array(own["sources"].iloc[0], np.int64)
        sums = dependencies(src, dst, int(max(src.max(), dst.max(), sources.max())) + 1, sources, STATES) * own["scale"].iloc[0]
        some = np.flatnonzero(sums)
        return pd.DataFrame({"project": key[0], "k": some, "betweenness": sums[some]})

    both = work.repartition(tasks, "project", "batch").groupBy("project", "batch").cogroup(parts.repartition(tasks, "project", "part").groupBy("project", "part"))
    found = both.applyInPandas(run, "project string, k int, betweenness double")
    sums = found.groupBy("project", "k").agg(F.sum("betweenness").alias("b")).join(numbers, ["project", "k"])
    return nodes.join(sums.select("project", "id", "b"), ["project", "id"], "left").select("project", "id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def _betweenness_by_levels(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """The same sums by joins: path counts forward level by level, dependencies back. States: (project, source, id).

    `paths` counts them in units of the level before, `sigma` in units of the level's own, or they would leave the range
    of a double on long ways.
    """
    links = edges.groupBy("project", "src", "dst").agg(F.count(F.lit(1)).alias("m"))
    key = ["project", "source", "id"]
    seen = stage(start.select("project", F.col("id").alias("source"), "id", F.lit(0).alias("dist"), F.lit(1.0).alias("sigma"), F.lit(1.0).alias("paths")), "bc-seen")
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.max("paths").over(Window.partitionBy("project", "source")))))
    level, depth = seen, 0
    while True:
        out = level.withColumnRenamed("id", "src").join(links, ["project", "src"]).select("project", "source", F.col("dst").alias("id"), (F.col("sigma") * F.col("m")).alias("s"))
        new = out.join(seen.select(*key), key, "left_anti").groupBy(*key).agg(F.sum("s").alias("paths"))
        depth += 1
        level = stage(new.select(*key, F.lit(depth).alias("dist"), (F.col("paths") / unit).alias("sigma"), "paths"), "bc-level")
        if level.isEmpty():
            break
        seen = stage(seen.unionByName(level), "bc-seen")
    delta = stage(seen.filter(F.col("dist") == depth - 1).select(*key, "dist", "sigma", "paths", F.lit(0.0).alias("delta")), "bc-delta")
    done = [delta]
    for d in range(depth - 2, -1, -1):
        upper = seen.filter(F.col("dist") == d)
        into = done[-1].select("project", "source", F.col("id").alias("dst"), ((1 + F.col("delta")) / F.col("paths")).alias("q"))
        given = upper.select("project", "source", F.col("id").alias("src"), "sigma").join(links, ["project", "src"]).join(into, ["project", "source", "dst"])
        sums = given.groupBy("project", "source", F.col("src").alias("id")).agg(F.sum(F.col("sigma") * F.col("m") * F.col("q")).alias("delta"))
        done.append(stage(upper.join(sums, key, "left").select(*key, "dist", "sigma", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta")), "bc-delta"))
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    sums = every.filter("id <> source").groupBy("project", "id").agg(F.sum("delta").alias("b"))
    scale = start.groupBy("project").agg(F.max("scale").alias("scale"))
    return nodes.join(sums, ["project", "id"], "left").join(scale, "project", "left").select("project", "id", (F.coalesce("b", F.lit(0.0)) * F.coalesce("scale", F.lit(1.0))).alias("betweenness"))


def score(table: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """table(project, id, betweenness, pagerank, in_degree, in_cycle, ...) plus the composite score."""
    both = normalize(table, ["betweenness", "pagerank", "in_degree"])
    total = weights.betweenness * F.col("norm_betweenness") + weights.pagerank * F.col("norm_pagerank") + weights.in_degree * F.col("norm_in_degree")
    return both.withColumn("score", total + F.when(F.col("in_cycle"), F.lit(weights.in_cycle)).otherwise(F.lit(0.0))).drop("norm_betweenness", "norm_pagerank", "norm_in_degree")


def compute_metrics(nodes: DataFrame, edges: DataFrame, weights: Weights = Weights(), thresholds: Thresholds = Thresholds(), rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """All node metrics on the scoring view: (project, id, betweenness, pagerank, in_degree, out_degree, in_cycle, score, hotspot_type)."""
    from depweave.operators.cycles import in_cycle

    view = scoring_view(edges)
    table = degrees(nodes, view).join(pagerank(nodes, view, rounds=rounds, tolerance=tolerance), ["project", "id"]).join(betweenness(nodes, view), ["project", "id"]).join(in_cycle(nodes, view), ["project", "id"])
    scored = score(stage(table, "metrics"), weights).withColumn("hotspot_type", classify(F.col("in_degree"), F.col("betweenness"), thresholds))
    return scored.select("project", "id", "betweenness", "pagerank", "in_degree", "out_degree", "in_cycle", "score", "hotspot_type")


def top_hotspots(metrics: DataFrame, n: int = 20) -> DataFrame:
    """The n highest scores, over all projects; ties by id."""
    return metrics.orderBy(F.desc("score"), "id").limit(n)


def ranked_hotspots(metrics: DataFrame, n: int = 20) -> DataFrame:
    """The n highest scores of each project, with a rank from 1."""
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "id"))
    return metrics.withColumn("rank", rank).filter(F.col("rank") <= n)
