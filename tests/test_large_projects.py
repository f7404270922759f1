"""Projects beyond the first kernel's size: the same results, and no round for each step of a long way."""

import random

import pytest

from depweave.operators import cycles, metrics
from depweave.plans import staging


def refuse(*_, **__):
    raise AssertionError("not needed here")


@pytest.fixture(scope="module")
def graph(spark):
    """Two projects: long rings tied together one way, single nodes, repeated edges and a loop."""
    rng = random.Random(3)
    rows = []
    for project in ("p", "q"):
        for ring in range(12):
            ids = [f"{ring}.{i}" for i in range(rng.choice((1, 2, 3, 40)))]
            rows += [(project, a, b) for a, b in zip(ids, ids[1:] + ids[:1], strict=True)]
            if ring:
                rows.append((project, f"{rng.randrange(ring)}.0", f"{ring}.0"))
        rows += [(project, "9.0", "alone"), (project, "alone", "alone"), (project, "0.0", "1.0"), (project, "0.0", "1.0")]
    edges = spark.createDataFrame(rows, "project string, src string, dst string")
    nodes = edges.selectExpr("project", "explode(array(src, dst)) id").distinct().unionByName(spark.createDataFrame([("q", "idle"), ("r", "only")], "project string, id string"))
    return nodes.localCheckpoint(), edges.localCheckpoint()


def rows(table):
    return sorted(map(tuple, table.collect()))


def test_components_by_number(graph, monkeypatch):
    expected = rows(cycles.components(*graph, distributed=False))
    assert expected == rows(cycles.components(*graph, distributed=True))
    monkeypatch.setattr(staging, "KERNEL_ROWS", 0)
    monkeypatch.setattr(cycles, "_components_by_colour", refuse)
    assert rows(cycles.components(*graph)) == expected
    assert {r["id"] for r in cycles.in_cycle(*graph).filter("in_cycle").collect()} == {i for p, i, c in expected if sum(x[::2] == (p, c) for x in expected) > 1}


def test_pairs_need_no_components(graph, monkeypatch):
    monkeypatch.setattr(cycles, "components", refuse)
    found = {(r["project"], *r["nodes"]) for r in cycles.bounded_cycles(*graph, 2).collect()}
    pairs = {tuple(r) for r in graph[1].collect()}
    assert found == {(p, a, b) for p, a, b in pairs if a < b and (p, b, a) in pairs} and found


def near(a, b):
    return len(a) == len(b) and all(x[:2] == y[:2] and x[2] == pytest.approx(y[2], abs=1e-9) for x, y in zip(a, b, strict=True))


def test_betweenness_by_number(graph, monkeypatch):
    expected = rows(metrics.betweenness(*graph, sources=20, batch=7, distributed=True))
    monkeypatch.setattr(staging, "KERNEL_ROWS", 0)
    monkeypatch.setattr(metrics, "_betweenness_by_levels", refuse)
    monkeypatch.setattr(metrics, "STATES", 500)
    assert near(rows(metrics.betweenness(*graph, sources=20, batch=7)), expected) and any(x[2] for x in expected)


def test_pagerank_by_number(graph, monkeypatch):
    expected = rows(metrics.pagerank(*graph, distributed=False))
    monkeypatch.setattr(staging, "KERNEL_ROWS", 0)
    monkeypatch.setattr(metrics, "_pagerank_by_rounds", refuse)
    assert near(rows(metrics.pagerank(*graph)), expected)
