"""Few links are connected in one task, and texts come to workers in small batches: the near-copies stage stays small."""

import random

import numpy as np
import pytest

from depweave.llm import components, nearcopies

CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def brute_roots(edges):
    root = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def graphs():
    rng = random.Random(3)
    for n, m in ((2, 1), (30, 15), (60, 60), (200, 150)):
        ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
        yield [tuple(rng.sample(ids, 2)) for _ in range(m)]
    yield [(k, k + 1) for k in range(300)]
    yield [(999, k) for k in range(50)] + [(1000 - k, 1001 + k) for k in range(1, 50)]


def test_roots_are_the_least_of_each_component():
    for edges in graphs():
        u, v = np.array(edges, np.int64).T
        nodes, root = components.roots_of(u, v)
        assert dict(zip(nodes.tolist(), root.tolist(), strict=True)) == brute_roots(edges)


@pytest.mark.parametrize("few", [None, 0])
def test_both_ways_give_the_same(spark, few):
    edges = [(5, -7), (5, 9), (9, 5), (1, 2), (2, 1), (3, 3), (None, 4), (4, None), (-7, 11)]
    found = components.linked(spark.createDataFrame(edges, "u long, v long").repartition(3), few=few).collect()
    assert sorted((r["node"], r["root"]) for r in found) == [(-7, -7), (1, 1), (2, 1), (5, -7), (9, -7), (11, -7)]
    assert components.linked(spark.createDataFrame([], "u long, v long"), few=few).count() == 0


def copies():
    words = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join([*words[:-3], f"x{k}", *words[-2:]])) for k in range(30)]
    return [*rows, (100, " ".join(words[::-1])), (101, "other"), (102, None)]


def test_few_links_take_no_rounds(spark, monkeypatch):
    written, write = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df, label: written.append(label) or write(df, label))
    docs = spark.createDataFrame(copies(), "doc_id long, text string")
    found = {r["doc"]: r["component"] for r in nearcopies.near_copies(docs).collect()}
    assert found == {**dict.fromkeys(range(30), 0), 100: 100, 101: 101, 102: 102}
    assert written == []
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    assert {r["doc"]: r["component"] for r in nearcopies.near_copies(docs).collect()} == found and written


def test_workers_get_few_texts_at_once(spark, monkeypatch):
    before, seen, write = spark.conf.get(CONF), [], nearcopies.stage
    monkeypatch.setattr(nearcopies, "stage", lambda df, label: seen.append(int(spark.conf.get(CONF))) or write(df, label))
    docs = spark.createDataFrame(copies(), "doc_id long, text string")
    nearcopies.near_copies(docs)
    assert max(seen) <= nearcopies.TEXTS and spark.conf.get(CONF) == before
    monkeypatch.setattr(nearcopies, "lists_of", lambda firsts: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        nearcopies.near_copies(docs)
    assert spark.conf.get(CONF) == before
