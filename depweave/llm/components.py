"""Connected components of an edge table by alternating star contractions, on DataFrame operations only.

Few edges between numbers go to one task instead (linked).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import arrow_batch, discard, schema_of, stage

#: Edges of two longs that one task may hold; more take the rounds.
FEW_EDGES = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node seen there."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u > v holds in every row here: all smaller neighbours of u, and u, are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """edges(u, v) of one comparable type -> members(node, root), root the least node of the component.

    Only nodes with an edge to another node appear. Null ends, self-loops and repeated edges are ignored; an empty
    table gives an empty result. Each round writes its edges to the shared folder, so nothing is recomputed when an
    executor is lost and the plan does not grow; the driver sees two numbers a round. Both stars aggregate before
    they shuffle and join back, so that one node with very many edges is a skewed join that AQE splits.
    """
    state = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = None
    for _ in range(max_rounds):
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before, last = now, state
        state = stage(_small_star(_large_star(state)), label)
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def linked(edges: DataFrame, label: str = "components", few: int | None = None) -> DataFrame:
    """connected_components of edges(u long, v long), without rounds if there are at most `few` (FEW_EDGES).

    Rounds write a table each: on a few edges that is all they cost, and a process for every file written.
    """
    if edges.count() > (FEW_EDGES if few is None else few):
        return connected_components(edges, label)
    schema = schema_of("node long, root long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[c.to_numpy() for c in batch.columns] for batch in batches]
        nodes, root = roots_of(*(np.concatenate([np.empty(0, np.int64), *(x[k] for x in ends)]) for k in (0, 1)))
        yield arrow_batch({"node": pa.array(nodes), "root": pa.array(root)}, schema)

    return edges.filter("u <> v").select("u", "v").repartition(1).mapInArrow(run, schema)


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges, rising, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = low[apart], high[apart]
        np.minimum.at(root, b, a)
        while (root != (up := root[root])).any():
            root = up
    return nodes, nodes[root]
