"""Strongly connected components and simple cycles."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depweave.functions.text import canonical_rotation
from depweave.operators.metrics import _positions
from depweave.plans.staging import NUMBER_ROWS, by_size, discard, numbered, per_project, stage, unpacked

MAX_CYCLES = 500


def scc_labels(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """For each node the least node of its component: a depth-first search with an explicit stack."""
    order = np.argsort(src, kind="stable")
    ends, first = memoryview(np.ascontiguousarray(dst[order])), memoryview(np.searchsorted(src[order], np.arange(n + 1)))
    labels, low, number = np.full(n, -1), [0] * n, [-1] * n
    label = memoryview(labels)
    path: list[int] = []
    count = 0
    for root in range(n):
        if number[root] >= 0:
            continue
        work = [(root, first[root])]
        number[root] = low[root] = count
        count += 1
        path.append(root)
        while work:
            u, at = work[-1]
            if at < first[u + 1]:
                work[-1] = (u, at + 1)
                v = ends[at]
                if number[v] < 0:
                    number[v] = low[v] = count
                    count += 1
                    path.append(v)
                    work.append((v, first[v]))
                elif label[v] < 0:
                    low[u] = min(low[u], number[v])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[u])
            if low[u] == number[u]:
                own = []
                while not own or own[-1] != u:
                    own.append(path.pop())
                labels[own] = min(own)
    return labels


def components(nodes: DataFrame, edges: DataFrame, distributed: bool | None = None) -> DataFrame:
    """(project, id, scc_id): the least id of each node's strongly connected component, single nodes included."""
    nodes, edges = nodes.select("project", "id").distinct(), edges.select("project", "src", "dst").filter("src <> dst")

    def kernel(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids, src, dst = _positions(pd.concat([v["id"], e["src"], e["dst"]]), e)
        out = pd.DataFrame({"id": ids, "scc_id": ids[scc_labels(src, dst, len(ids))] if len(ids) else ids})
        return out.assign(project=v["project"].iloc[0] if len(v) else None)[["project", "id", "scc_id"]]

    small = lambda v, e: v.join(per_project(v, e, kernel, "project string, id string, scc_id string"), ["project", "id"])
    large = lambda v, e: by_size(v, e, _components_by_number, _components_by_colour, distributed, NUMBER_ROWS)
    return by_size(nodes, edges, small, large, distributed)


def _components_by_number(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One task a project too, which gets the edges as numbers and gives the members of components of two or more."""
    ends = edges.select("project", F.explode(F.array("src", "dst")).alias("id"))
    numbers, packed = numbered(nodes.unionByName(ends), edges)

    def kernel(parts: pd.DataFrame) -> pd.DataFrame:
        src, dst = unpacked(parts["data"])
        label = scc_labels(src, dst, int(max(src.max(), dst.max())) + 1)
        inside = np.flatnonzero(np.bincount(label)[label] > 1)
        return pd.DataFrame({"project": parts["project"].iloc[0], "k": inside, "c": label[inside]})

    inside = packed.groupBy("project").applyInPandas(kernel, "project string, k int, c int")
    named = inside.join(numbers.select("project", F.col("k").alias("c"), F.col("id").alias("scc_id")), ["project", "c"]).join(numbers, ["project", "k"])
    return nodes.join(stage(named.select("project", "id", "scc_id"), "scc-named"), ["project", "id"], "left").select("project", "id", F.coalesce("scc_id", "id").alias("scc_id"))


def _spread(colours: DataFrame, links: DataFrame) -> DataFrame:
    """Every node takes the least colour that reaches it along links(project, src, dst), round by round until none changes."""
    while True:
        given = links.join(colours.select("project", F.col("id").alias("src"), "c"), ["project", "src"]).groupBy("project", F.col("dst").alias("id")).agg(F.min("c").alias("g"))
        new = stage(colours.join(given, ["project", "id"], "left").select("project", "id", F.least("c", F.coalesce("g", "c")).alias("c"), (F.col("g") < F.col("c")).alias("moved")), "scc-colour")
        discard(colours)
        if new.filter("moved").isEmpty():
            return new.select("project", "id", "c")
        colours = new


def _components_by_colour(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Forward colours by least id; what reaches a colour's own node backwards, inside the colour, is its component. Repeat on the rest."""
    left, links, done = stage(nodes, "scc-left"), stage(edges.distinct(), "scc-links"), []
    while not left.isEmpty():
        sources, sinks = links.select("project", F.col("dst").alias("id")).distinct(), links.select("project", F.col("src").alias("id")).distinct()
        inner = left.join(sources, ["project", "id"], "left_semi").join(sinks, ["project", "id"], "left_semi")
        single = left.join(inner, ["project", "id"], "left_anti")
        done.append(stage(single.select("project", "id", F.col("id").alias("scc_id")), "scc-done"))
        inner = stage(inner, "scc-inner")
        pair = lambda t, v: links.join(t.withColumnRenamed("id", "src").withColumnRenamed(v, "cs"), ["project", "src"]).join(t.withColumnRenamed("id", "dst").withColumnRenamed(v, "cd"), ["project", "dst"])
        links = stage(links.join(inner.withColumnRenamed("id", "src"), ["project", "src"], "left_semi").join(inner.withColumnRenamed("id", "dst"), ["project", "dst"], "left_semi"), "scc-links")
        colour = stage(_spread(inner.withColumn("c", F.col("id")), links), "scc-colours")
        back = stage(pair(colour, "c").filter("cs = cd").select("project", F.col("dst").alias("src"), F.col("src").alias("dst")), "scc-back")
        # a colour's own node spreads '0', all others hold '1' until it reaches them
        mark = _spread(colour.select("project", "id", F.when(F.col("id") == F.col("c"), "0").otherwise("1").alias("c")), back)
        found = stage(mark.filter("c = '0'").select("project", "id").join(colour, ["project", "id"]).select("project", "id", F.col("c").alias("scc_id")), "scc-done")
        done.append(found)
        left = stage(inner.join(found, ["project", "id"], "left_anti"), "scc-left")
        links = stage(links.join(left.withColumnRenamed("id", "src"), ["project", "src"], "left_semi").join(left.withColumnRenamed("id", "dst"), ["project", "dst"], "left_semi"), "scc-links")
    out = nodes.sparkSession.createDataFrame([], "project string, id string, scc_id string")
    for x in done:
        out = out.unionByName(x)
    return out


def find_sccs(nodes: DataFrame, edges: DataFrame, excluding: list[str] | None = None, distributed: bool | None = None) -> DataFrame:
    """(project, scc_id, nodes): components of two or more nodes, members sorted. A loop on one node is no component.

    `excluding`: ids that are taken out with their edges first.
    """
    if excluding:
        nodes = nodes.filter(~F.col("id").isin(excluding))
        edges = edges.filter(~F.col("src").isin(excluding) & ~F.col("dst").isin(excluding))
    sizes = components(nodes, edges, distributed).groupBy("project", "scc_id").agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    return sizes.filter(F.size("nodes") > 1)


def two_cycle_pairs(edges: DataFrame) -> DataFrame:
    """(project, src, dst): both directions of the pairs of nodes that depend on each other; one join, no components."""
    pairs = edges.select("project", "src", "dst").filter("src <> dst").distinct()
    return pairs.join(pairs.select("project", F.col("dst").alias("src"), F.col("src").alias("dst")), ["project", "src", "dst"], "left_semi")


def in_cycle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, id, in_cycle): in a component of two or more."""
    labels = components(nodes, edges)
    large = labels.groupBy("project", "scc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return labels.join(large, ["project", "scc_id"], "left").select("project", "id", F.col("n").isNotNull().alias("in_cycle"))


def bounded_cycles(nodes: DataFrame, edges: DataFrame, max_length: int | None, excluding: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(project, nodes): all simple cycles of 2 to max_length nodes (None: any), each turned so that its least id is first.

    Paths grow inside one component, from its node and through larger ids only, so each cycle is found once. With
    `most`, a project is left alone as soon as it has so many cycles, and the shortest of them are given.
    """
    if excluding:
        nodes = nodes.filter(~F.col("id").isin(excluding))
        edges = edges.filter(~F.col("src").isin(excluding) & ~F.col("dst").isin(excluding))
    if max_length == 2:
        return two_cycle_pairs(edges).filter("src < dst").select("project", F.array("src", "dst").alias("nodes"))
    label = components(nodes, edges)
    pairs = edges.select("project", "src", "dst").filter("src <> dst").distinct()
    inside = pairs.join(label.withColumnRenamed("id", "src"), ["project", "src"]).join(label.select("project", F.col("id").alias("dst"), F.col("scc_id").alias("other")), ["project", "dst"])
    links = stage(inside.filter("scc_id = other").select("project", "src", "dst"), "cycle-links")
    paths = stage(links.filter("src < dst").select("project", F.array("src", "dst").alias("nodes")), "cycle-paths")
    out = links.select("project", F.array("src").alias("nodes")).limit(0)
    found = out.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    for size in count(2):
        last = paths.select("project", "nodes", F.element_at("nodes", 1).alias("dst"), F.element_at("nodes", -1).alias("src"))
        closed = stage(last.join(links, ["project", "src", "dst"], "left_semi").select("project", "nodes"), "cycles")
        out = out.unionByName(closed)
        if size == max_length:
            break
        step = last.select("project", "nodes", "src", F.col("dst").alias("first"))
        if most is not None:
            found = stage(found.unionByName(closed.groupBy("project").agg(F.count(F.lit(1)).alias("n"))).groupBy("project").agg(F.sum("n").alias("n")), "cycle-counts")
            step = step.join(found.filter(F.col("n") >= most).select("project"), "project", "left_anti")
        step = step.join(links, ["project", "src"]).filter("dst > first").filter(~F.array_contains("nodes", F.col("dst")))
        old, paths = paths, stage(step.select("project", F.concat("nodes", F.array("dst")).alias("nodes")), "cycle-paths")
        discard(old)
        if paths.isEmpty():
            break
    if most is None:
        return out
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.size("nodes"), "nodes"))
    return out.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__rank")


def simple_cycles_kernel(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, most: int) -> list[list[str]]:
    """Up to `most` simple cycles: depth first from each node, through larger nodes only, by explicit stack."""
    label = scc_labels(src, dst, len(ids))
    after: dict[int, list[int]] = {}
    for u, v in sorted(set(zip(src.tolist(), dst.tolist(), strict=True))):
        if u != v and label[u] == label[v]:
            after.setdefault(u, []).append(v)
    out: list[list[str]] = []
    for start in sorted(after):
        path, on, work = [start], {start}, [iter(after[start])]
        while work:
            if len(out) >= most:
                return out
            v = next(work[-1], None)
            if v is None:
                work.pop()
                on.discard(path.pop())
            elif v == start:
                out.append([str(ids[i]) for i in path])
            elif v > start and v not in on:
                path.append(v)
                on.add(v)
                work.append(iter(after.get(v, ())))
    return out


def simple_cycles(nodes: DataFrame, edges: DataFrame, most: int = MAX_CYCLES, excluding: list[str] | None = None) -> DataFrame:
    """(project, nodes): simple cycles of two or more nodes of any length, at most `most` a project (the report's cap).

    The search is exponential by nature and stops at the cap, project by project: depth first where a task can hold the
    project, by growing lengths (the shortest cycles first) where it cannot.
    """
    if excluding:
        nodes = nodes.filter(~F.col("id").isin(excluding))
        edges = edges.filter(~F.col("src").isin(excluding) & ~F.col("dst").isin(excluding))

    def kernel(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids, src, dst = _positions(pd.concat([v["id"], e["src"], e["dst"]]), e)
        return pd.DataFrame([(v["project"].iloc[0], c) for c in simple_cycles_kernel(ids, src, dst, most)], columns=["project", "nodes"])

    small = lambda v, e: per_project(v, e, kernel, "project string, nodes array<string>").withColumn("nodes", canonical_rotation(F.col("nodes")))
    large = lambda v, e: bounded_cycles(v, e, None, most=most)
    return by_size(nodes.select("project", "id"), edges.select("project", "src", "dst").filter("src <> dst").distinct(), small, large)


def report_cycles(nodes: DataFrame, edges: DataFrame, most: int = MAX_CYCLES, excluding: list[str] | None = None) -> DataFrame:
    """Simple cycles under the cap, or for projects without any the member lists of their components."""
    found = simple_cycles(nodes, edges, most, excluding)
    groups = find_sccs(nodes, edges, excluding).select("project", "nodes")
    return found.unionByName(groups.join(found.select("project").distinct(), "project", "left_anti"))


def cycle_pairs(cycles: DataFrame) -> DataFrame:
    """(project, src, dst): neighbours in a cycle's list, the last and the first too."""
    after = F.col("nodes")[((F.col("pos") + 1) % F.size("nodes")).cast("int")]
    return cycles.select("project", "nodes", F.posexplode("nodes").alias("pos", "src")).select("project", "src", after.alias("dst")).distinct()
