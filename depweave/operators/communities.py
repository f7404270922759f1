"""Communities: greedy modularity moves with repairs, and label propagation.

Both depend on node order (by id) and run as one task a project where a task can hold it. A larger project goes through
the same steps (moves by weight, single nodes joined, oversized communities divided) as rounds on DataFrames, in which
half of the nodes, by a hash, decide at once; its communities need not be those of the sequential order.

Modularity moves on a whole graph use half the usual total weight as their constant (so small communities are
favoured); the moves inside an oversized community use the usual one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depweave.operators.query import reach
from depweave.plans.staging import by_size, discard, per_project, stage

SWEEPS, LABEL_SWEEPS = 20, 50
SPLIT_SHARE, SPLIT_LEAST = 0.25, 10
EPS = 1e-12

Links = list[dict[int, float]]


def greedy_moves(label: list[int], links: Links, m: float, refine: bool = False, sweeps: int = SWEEPS) -> None:
    """Move nodes, in order, to the neighbouring community of the largest gain until a sweep moves none.

    With `refine` a community is open only to nodes tied to it more strongly than by chance, and gains must be positive.
    """
    degree = [sum(x.values()) for x in links]
    total: Counter = Counter()
    for u, c in enumerate(label):
        total[c] += degree[u]
    for _ in range(sweeps if m else 0):
        moved = False
        for u, near in enumerate(links):
            here, weight = label[u], {}
            for v, w in near.items():
                weight[label[v]] = weight.get(label[v], 0.0) + w
            total[here] -= degree[u]
            best, target = 0.0, here
            for c in sorted(weight):
                if c == here or refine and weight[c] <= degree[u] * total[c] / (2 * m) + 1e-9:
                    continue
                gain = weight[c] / m - total[c] * degree[u] / (2 * m * m)
                tie = abs(gain - best) <= EPS and gain > (EPS if refine else 0.0) and c < target
                if gain > best + EPS or tie:
                    best, target = gain, c
            if refine and best <= EPS:
                target = here
            total[target] += degree[u]
            if target != here:
                label[u], moved = target, True
        if not moved:
            return


def spread_labels(links: Links, sweeps: int = LABEL_SWEEPS) -> list[int]:
    """Each node, in order, takes the label most of its neighbours have (the lowest of those)."""
    label = list(range(len(links)))
    for _ in range(sweeps):
        moved = False
        for u, near in enumerate(links):
            if near:
                counts = Counter(label[v] for v in near)
                new = min(counts, key=lambda c: (-counts[c], c))
                moved, label[u] = moved or new != label[u], new
        if not moved:
            break
    return label


def bisect(links: Links) -> list[int]:
    """Two halves by degree: grown from the node of least degree along its strongest ties."""
    degree = [sum(x.values()) for x in links]
    seed = min(range(len(links)), key=lambda u: (degree[u], u))
    inside, weight, held = {seed}, dict(links[seed]), degree[seed]
    while held < sum(degree) / 2:
        outside = [u for u in range(len(links)) if u not in inside]
        tied = [u for u in outside if weight.get(u, 0.0) > 0]
        new = min(tied, key=lambda u: (-weight[u], u)) if tied else next((u for u in outside if degree[u] > 0), None)
        if new is None:
            break
        inside.add(new)
        held += degree[new]
        for v, w in links[new].items():
            weight[v] = weight.get(v, 0.0) + w
    if len(inside) == len(links):
        inside = {seed}
    return [0 if u in inside else 1 for u in range(len(links))]


def adopt_singletons(label: list[int], links: Links) -> None:
    """Single nodes join their strongest neighbour (ties: lowest label); those without any become one community."""
    size = Counter(label)
    for u, near in enumerate(links):
        if size[label[u]] == 1 and near:
            new = min(((-w, label[v]) for v, w in near.items()), default=(0.0, label[u]))
            if new[0] < 0 and new[1] != label[u]:
                size[label[u]] -= 1
                size[new[1]] += 1
                label[u] = new[1]
    single = [u for u in range(len(links)) if size[label[u]] == 1]
    for u in single[1:]:
        label[u] = label[single[0]]


def split_large(label: list[int], links: Links) -> None:
    """Communities above a quarter of the graph (and ten nodes) are divided once, by the first program that divides them."""
    n = len(links)
    limit = max(int(n * SPLIT_SHARE + 0.5), SPLIT_LEAST)
    groups: dict[int, list[int]] = {}
    for u, c in enumerate(label):
        groups.setdefault(c, []).append(u)
    fresh = max(label, default=0) + 1
    for c, members in sorted(((c, x) for c, x in groups.items() if len(x) > limit), key=lambda x: x[1][0]):
        at = {u: i for i, u in enumerate(members)}
        inner = [{at[v]: w for v, w in links[u].items() if v in at} for u in members]
        m = sum(sum(x.values()) for x in inner) / 2
        if not m:
            continue
        part = list(range(len(members)))
        greedy_moves(part, inner, m)
        if len(set(part)) == 1:
            part = spread_labels(inner)
        if len(set(part)) == 1:
            part = list(range(len(members)))
            greedy_moves(part, inner, m, refine=True)
        if len(set(part)) == 1:
            part = bisect(inner)
        names = {part[0]: c}
        for p in sorted(set(part) - {part[0]}):
            names[p], fresh = fresh, fresh + 1
        for u, p in zip(members, part, strict=True):
            label[u] = names[p]


def _links(v: pd.DataFrame, e: pd.DataFrame, weighted: bool) -> tuple[np.ndarray, Links, float]:
    from depweave.operators.metrics import _positions

    ids, src, dst = _positions(pd.concat([v["id"], e["src"], e["dst"]]), e)
    links: Links = [{} for _ in ids]
    total = 0.0
    for a, b, w in zip(src.tolist(), dst.tolist(), e["weight"].tolist() if weighted else [1.0] * len(e), strict=True):
        if a != b:
            if weighted:
                links[a][b] = links[a].get(b, 0.0) + w
                links[b][a] = links[b].get(a, 0.0) + w
                total += w
            else:
                links[a][b] = links[b][a] = 1.0
    return ids, links, total


def _numbered(members: DataFrame) -> DataFrame:
    """(project, id, label) -> (project, id, community_id): communities numbered by their least member, from 0."""
    least = members.groupBy("project", "label").agg(F.min("id").alias("least"))
    order = least.withColumn("community_id", (F.dense_rank().over(Window.partitionBy("project").orderBy("least")) - 1).cast("long"))
    return members.join(order, ["project", "label"]).select("project", "id", "community_id")


def detect(nodes: DataFrame, edges: DataFrame, method: str = "modularity") -> DataFrame:
    """(project, id, community_id). method: 'modularity' (edge weights count) or 'labels'. All edges count, also to externals."""

    def kernel(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"project": [], "id": [], "label": []})
        ids, links, total = _links(v, e, method == "modularity")
        if method == "labels":
            label = spread_labels(links)
            split_large(label, links)
        else:
            label = list(range(len(ids)))
            if total:
                greedy_moves(label, links, total / 2)
                adopt_singletons(label, links)
                split_large(label, links)
        return pd.DataFrame({"project": v["project"].iloc[0], "id": ids, "label": np.asarray(label, np.int64)})

    small = lambda v, e: per_project(v, e, kernel, "project string, id string, label long").withColumn("label", F.col("label").cast("string"))
    large = lambda v, e: detect_distributed(v, e, method)
    return _numbered(by_size(nodes.select("project", "id"), edges.select("project", "src", "dst", "weight"), small, large))


def _both_ways(edges: DataFrame, weighted: bool) -> DataFrame:
    """(project, src, dst, w), each tie in both directions, without loops."""
    ties = edges.filter("src <> dst").select("project", "src", "dst", (F.col("weight") if weighted else F.lit(1)).cast("double").alias("w"))
    both = ties.unionByName(ties.select("project", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("project", "src", "dst").agg((F.sum("w") if weighted else F.max("w")).alias("w"))


def _rounds(labels: DataFrame, best, most: int) -> DataFrame:
    """best(labels) -> (project, id, new), applied to half of the nodes a round until no node of either half wants to move."""
    quiet = 0
    for number in range(2 * most):
        turn = F.pmod(F.xxhash64("id", F.lit(number // 2)), F.lit(2)) == number % 2
        given = labels.join(best(labels), ["project", "id"], "left")
        new = F.when(turn, F.coalesce("new", "label")).otherwise(F.col("label"))
        now = stage(given.select(*labels.columns[:-1], new.alias("label"), (new != F.col("label")).alias("moved")), "labels")
        quiet = quiet + 1 if now.filter("moved").isEmpty() else 0
        old, labels = labels, now.drop("moved")
        discard(old)
        if quiet == 2:
            break
    return labels


def _moves_distributed(nodes: DataFrame, links: DataFrame, total: float | Column, rounds: int = SWEEPS) -> DataFrame:
    """(project, id, label): modularity moves from single nodes on; total: what part of the links' weight is the constant m."""
    degree = links.groupBy("project", F.col("src").alias("id")).agg(F.sum("w").alias("degree"))
    size = links.groupBy("project").agg((F.sum("w") * total).alias("m"))
    state = nodes.join(degree, ["project", "id"], "left").join(size, "project", "left")
    labels = stage(state.select("project", "id", F.coalesce("degree", F.lit(0.0)).alias("degree"), "m", F.col("id").alias("label")), "labels")

    def best(labels: DataFrame) -> DataFrame:
        tied = links.join(labels.select("project", F.col("id").alias("dst"), "label"), ["project", "dst"]).groupBy("project", F.col("src").alias("id"), "label").agg(F.sum("w").alias("k"))
        own = labels.select("project", "id", "label", F.lit(0.0).alias("k")).join(links.select("project", F.col("src").alias("id")).distinct(), ["project", "id"], "left_semi")
        options = tied.unionByName(own).groupBy("project", "id", "label").agg(F.sum("k").alias("k"))
        held = labels.groupBy("project", "label").agg(F.sum("degree").alias("held"))
        rows = options.join(held, ["project", "label"]).join(labels.select("project", "id", "degree", "m", F.col("label").alias("here")), ["project", "id"])
        others = F.col("held") - F.when(F.col("label") == F.col("here"), F.col("degree")).otherwise(F.lit(0.0))
        gain = F.round(F.col("k") / F.col("m") - others * F.col("degree") / (2 * F.col("m") * F.col("m")), 12)
        order = F.struct(-gain, F.when(F.col("label") == F.col("here"), 0).otherwise(1), F.col("label"))
        return rows.groupBy("project", "id").agg(F.min_by("label", order).alias("new"))

    return _rounds(labels, best, rounds).select("project", "id", "label")


def _labels_distributed(nodes: DataFrame, links: DataFrame, rounds: int = LABEL_SWEEPS) -> DataFrame:
    """(project, id, label): the commonest label around, the lowest of those; a node keeps its own if that is one of them."""
    labels = stage(nodes.select("project", "id", F.col("id").alias("label")), "labels")

    def best(labels: DataFrame) -> DataFrame:
        votes = links.join(labels.select("project", F.col("id").alias("dst"), "label"), ["project", "dst"]).groupBy("project", F.col("src").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
        rows = votes.join(labels.select("project", "id", F.col("label").alias("here")), ["project", "id"])
        return rows.groupBy("project", "id").agg(F.min_by("label", F.struct(-F.col("n"), F.when(F.col("label") == F.col("here"), 0).otherwise(1), F.col("label"))).alias("new"))

    return _rounds(labels, best, rounds).select("project", "id", "label")


def _adopt_distributed(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Single nodes join their strongest neighbour's community (two that choose each other become one); those without any are one community."""
    single = labels.join(labels.groupBy("project", "label").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("project", "label"), ["project", "label"], "left_semi").select("project", "id")
    near = links.withColumnRenamed("src", "id").join(single, ["project", "id"]).join(labels.withColumnRenamed("id", "dst"), ["project", "dst"])
    chosen = near.groupBy("project", "id").agg(F.min_by(F.struct("dst", "label"), F.struct(-F.col("w"), F.col("label"))).alias("c"))
    back = chosen.select("project", F.col("id").alias("other"), F.col("c.dst").alias("their"))
    pairs = chosen.join(back, (chosen["project"] == back["project"]) & (F.col("c.dst") == F.col("other")), "left").drop(back["project"])
    mutual = F.col("their") == F.col("id")
    given = pairs.select("project", "id", F.when(mutual, F.least("id", "other")).otherwise(F.col("c.label")).alias("new"), F.lit(True).alias("tied"))
    out = labels.join(single.withColumn("alone", F.lit(True)), ["project", "id"], "left").join(given, ["project", "id"], "left")
    return stage(out.select("project", "id", F.when(F.col("tied"), F.col("new")).when(F.col("alone"), F.lit("")).otherwise(F.col("label")).alias("label")), "labels")


def _bisect_distributed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(project, id, label): two parts by hops from the node of least degree, cut where they hold half of the degree."""
    degree = nodes.join(links.groupBy("project", F.col("src").alias("id")).agg(F.sum("w").alias("d")), ["project", "id"], "left").na.fill(0.0, ["d"])
    seed = degree.groupBy("project").agg(F.min_by("id", F.struct("d", "id")).alias("id"))
    levels = degree.join(reach(links, seed, None).select("project", "id", "depth"), ["project", "id"], "left")
    held = levels.groupBy("project", "depth").agg(F.sum("d").alias("d"))
    upto = held.withColumn("upto", F.sum("d").over(Window.partitionBy("project").orderBy(F.asc_nulls_last("depth")))).withColumn("all", F.sum("d").over(Window.partitionBy("project")))
    inside = upto.filter((F.col("depth") == 0) | (F.col("upto") <= F.col("all") / 2)).select("project", "depth", F.lit("0").alias("inside"))
    return levels.join(inside, ["project", "depth"], "left").select("project", "id", F.coalesce("inside", F.lit("1")).alias("label"))


def _split_distributed(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Communities above a quarter of their graph (and ten nodes) are divided once, by the first program that divides them."""
    size = labels.groupBy("project", "label").agg(F.count(F.lit(1)).alias("n"))
    whole = size.groupBy("project").agg(F.sum("n").alias("all"))
    large = size.join(whole, "project").filter(F.col("n") > F.greatest(F.floor(F.col("all") * SPLIT_SHARE + 0.5), F.lit(SPLIT_LEAST))).select("project", "label")
    key = F.to_json(F.struct("project", "label"))
    members = stage(labels.join(large, ["project", "label"]).select("project", "label", key.alias("key"), "id"), "split-nodes")
    if members.isEmpty():
        return labels
    at = lambda c: members.select("project", F.col("key").alias(f"k_{c}"), F.col("id").alias(c))
    inner = links.join(at("src"), ["project", "src"]).join(at("dst"), ["project", "dst"]).filter("k_src = k_dst")
    inner = stage(inner.select(F.col("k_src").alias("project"), "src", "dst", "w"), "split-links")
    left = members.select(F.col("key").alias("project"), "id").join(inner.select("project").distinct(), "project", "left_semi")
    done = []
    for divide in (lambda v, e: _moves_distributed(v, e, 0.5), _labels_distributed, _bisect_distributed):
        part = stage(divide(left, inner.join(left.select("project").distinct(), "project", "left_semi")), "split-labels")
        divided = part.groupBy("project").agg(F.countDistinct("label").alias("parts")).filter("parts > 1").select("project")
        done.append(part.join(divided, "project", "left_semi"))
        left = stage(left.join(divided, "project", "left_anti"), "split-left")
        if left.isEmpty():
            break
    parts = done[0]
    for x in done[1:]:
        parts = parts.unionByName(x)
    named = members.join(parts.select(F.col("project").alias("key"), "id", F.col("label").alias("part")), ["key", "id"])
    fresh = named.select("project", "id", F.concat("key", F.lit("|"), F.col("part")).alias("fresh"))
    return labels.join(fresh, ["project", "id"], "left").select("project", "id", F.coalesce("fresh", "label").alias("label"))


def detect_distributed(nodes: DataFrame, edges: DataFrame, method: str = "modularity") -> DataFrame:
    """(project, id, label) by rounds on DataFrames: the steps of detect()'s kernel for projects of any size."""
    links = stage(_both_ways(edges, method == "modularity"), "community-links")
    if method == "labels":
        return _split_distributed(_labels_distributed(nodes, links), links)
    labels = _moves_distributed(nodes, links, 0.25)
    return _split_distributed(_adopt_distributed(labels, links), links)


def communities(assignment: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, community_id, members, cohesion) of an assignment (project, id, community_id)."""
    members = assignment.groupBy("project", "community_id").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return members.join(cohesion(assignment, edges), ["project", "community_id"]).select("project", "community_id", "members", "cohesion")


def cohesion(assignment: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, community_id, cohesion): distinct tied pairs over possible pairs inside; 1 for one member."""
    pairs = edges.filter("src <> dst").select("project", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    of = lambda c, n: assignment.select("project", F.col("id").alias(c), F.col("community_id").alias(n))
    inner = pairs.join(of("a", "community_id"), ["project", "a"]).join(of("b", "other"), ["project", "b"]).filter("community_id = other").groupBy("project", "community_id").agg(F.count(F.lit(1)).alias("pairs"))
    size = assignment.groupBy("project", "community_id").agg(F.count(F.lit(1)).alias("n"))
    share = F.coalesce("pairs", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2)
    return size.join(inner, ["project", "community_id"], "left").select("project", "community_id", F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(share).alias("cohesion"))
