"""Hand graphs: star, chain, cycle, DAG; and brute force on small random graphs, for both programs of each operator."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from depweave.operators import communities, cycles, metrics, model, query
from depweave.plans import staging

STAR, CHAIN, RING, DAG = "b>a c>a d>a e>a", "a>b b>c c>d", "a>b b>c c>a", "a>b b>c"


def as_dict(df, value, key="id"):
    return {r[key]: r[value] for r in df.collect()}


@pytest.mark.parametrize("distributed", [False, True])
def test_pagerank_star(make_graph, distributed):
    got = as_dict(metrics.pagerank(*make_graph(STAR), rounds=30, distributed=distributed), "pagerank")
    assert max(got, key=got.get) == "a"
    assert sum(got.values()) == pytest.approx(1)


@pytest.mark.parametrize("distributed", [False, True])
def test_betweenness_chain(make_graph, distributed):
    assert as_dict(metrics.betweenness(*make_graph(CHAIN), distributed=distributed), "betweenness") == {"a": 0, "b": 2, "c": 2, "d": 0}


def test_programs_agree(spark, make_graph):
    rng = random.Random(3)
    text = " ".join(f"n{rng.randrange(12):02}>n{rng.randrange(12):02}" for _ in range(40))
    nodes, edges = make_graph(text)
    edges = edges.unionByName(edges.limit(9).withColumn("kind", F.lit("Calls")))
    one, two = (as_dict(metrics.betweenness(nodes, edges, distributed=d), "betweenness") for d in (False, True))
    assert one == pytest.approx(two)
    one, two = (as_dict(metrics.pagerank(nodes, edges, rounds=12, tolerance=0, distributed=d), "pagerank") for d in (False, True))
    assert one == pytest.approx(two)
    one, two = (as_dict(cycles.components(nodes, edges, distributed=d), "scc_id") for d in (False, True))
    assert one == two


def test_sccs(make_graph):
    assert [r["nodes"] for r in cycles.find_sccs(*make_graph(RING)).collect()] == [["a", "b", "c"]]
    assert cycles.find_sccs(*make_graph(DAG)).count() == 0
    assert cycles.find_sccs(*make_graph("a>a")).count() == 0
    barrel = make_graph("a>x x>a b>x x>b")
    assert cycles.find_sccs(*barrel).first()["nodes"] == ["a", "b", "x"]
    assert cycles.find_sccs(*barrel, excluding=["x"]).count() == 0


def test_simple_cycles_brute_force(make_graph):
    rng = random.Random(5)
    pairs = {(rng.randrange(6), rng.randrange(6)) for _ in range(14)}
    nodes, edges = make_graph(" ".join(f"{a}>{b}" for a, b in sorted(pairs)))
    want = set()
    for n in range(2, 7):
        for p in itertools.permutations(range(6), n):
            if p[0] == min(p) and all((p[i], p[(i + 1) % n]) in pairs for i in range(n)):
                want.add(tuple(map(str, p)))
    assert {tuple(r["nodes"]) for r in cycles.simple_cycles(nodes, edges).collect()} == want
    assert {tuple(r["nodes"]) for r in cycles.bounded_cycles(nodes, edges, 6).collect()} == want
    assert cycles.simple_cycles(nodes, edges, most=1).count() == min(1, len(want))


def test_report_falls_back_to_components(make_graph):
    assert cycles.report_cycles(*make_graph(DAG)).count() == 0
    assert [r["nodes"] for r in cycles.report_cycles(*make_graph("b>c c>a a>b")).collect()] == [["a", "b", "c"]]


def test_score_and_classes(spark, make_graph):
    nodes, edges = make_graph(STAR)
    got = {r["id"]: r for r in metrics.compute_metrics(nodes, edges, thresholds=metrics.Thresholds(3, 10)).collect()}
    assert max(got, key=lambda k: got[k]["score"]) == "a" and got["a"]["hotspot_type"] == "hub" and got["a"]["in_degree"] == 4
    flat = metrics.normalize(spark.createDataFrame([("p", "a", 2.0), ("p", "b", 2.0)], "project string, id string, x double"), ["x"])
    assert {r["norm_x"] for r in flat.collect()} == {0.0}


def test_external_edges_do_not_score(make_graph):
    nodes, edges = make_graph(STAR)
    assert {r["score"] for r in metrics.compute_metrics(nodes, edges.withColumn("confidence_kind", F.lit("ExpectedExternal"))).collect()} == {0.0}


def test_merge_rules(spark):
    raw = spark.createDataFrame([("p", "a", "b", "Imports", 9, 0.5, "Ambiguous", 1), ("p", "a", "b", "Imports", 3, 0.9, "Inferred", 2), ("p", "a", "b", "Imports", 4, 0.9, "Extracted", 3), ("p", "a", "b", "Calls", 5, 1.0, "Extracted", 4)], "project string, src string, dst string, kind string, line long, confidence double, confidence_kind string, seq long")
    got = {r["kind"]: r for r in model.merge_edges(raw).collect()}
    assert (got["Imports"]["weight"], got["Imports"]["line"], got["Imports"]["confidence"], got["Imports"]["confidence_kind"]) == (3, 9, 0.9, "Inferred")
    assert got["Calls"]["weight"] == 1
    states = model.edge_state(raw.filter("seq <> 2")).unionByName(model.edge_state(raw.filter("seq = 2")))
    assert sorted(map(str, model.merge_states(states).collect())) == sorted(map(str, model.merge_edges(raw).collect()))


@pytest.mark.parametrize("text,n,want", [("a>b", "ab", 1.0), ("c>d", "ab", 0.0), ("a>b b>c c>a", "abc", 1.0), ("a>b b>a", "abc", 1 / 3), ("a>b", "a", 1.0)])
def test_cohesion(spark, make_graph, text, n, want):
    _, edges = make_graph(text)
    members = spark.createDataFrame([("p", x, 0) for x in n], "project string, id string, community_id long")
    assert communities.cohesion(members, edges).first()["cohesion"] == pytest.approx(want)


@pytest.mark.parametrize("method", ["modularity", "labels"])
def test_communities_cover_and_are_numbered(make_graph, method):
    text = "a1>a2 a2>a3 a3>a1 b1>b2 b2>b3 b3>b1 a1>b1"
    nodes, edges = make_graph(text, more_nodes=["z1", "z2"])
    runs = [sorted(map(tuple, communities.detect(nodes, e, method).select("id", "community_id").collect())) for e in (edges, edges.repartition(3))]
    assert runs[0] == runs[1]
    of = dict(runs[0])
    assert len(of) == 8 and sorted(set(of.values())) == list(range(len(set(of.values()))))
    assert of["a1"] == of["a2"] == of["a3"]
    if method == "modularity":
        assert of["b1"] == of["b2"] != of["a1"]
        assert of["z1"] == of["z2"]


def test_large_community_is_split(make_graph):
    ring = " ".join(f"r{i:02}>r{(i + 1) % 24:02}" for i in range(24))
    nodes, edges = make_graph(ring)
    assert communities.detect(nodes, edges, "labels").select("community_id").distinct().count() >= 2


def clusters(k, size, seed, prefix="n"):
    """k complete groups of nodes and a few edges between them, as text, and the group of each node."""
    rng = random.Random(seed)
    names = [[f"{prefix}{g}_{i:02}" for i in range(size)] for g in range(k)]
    pairs = [(a, b) for own in names for a in own for b in own if a < b]
    pairs += [(rng.choice(names[g]), rng.choice(names[(g + 1) % k])) for g in range(k)]
    return " ".join(f"{a}>{b}" for a, b in pairs), {x: g for g, own in enumerate(names) for x in own}


def modularity(pairs, of):
    """Share of edges inside communities, less what chance would give."""
    m, degree, inside = len(pairs), {}, sum(of[a] == of[b] for a, b in pairs)
    for pair in pairs:
        for x in pair:
            degree[of[x]] = degree.get(of[x], 0) + 1
    return inside / m - sum(d * d for d in degree.values()) / (4 * m * m)


@pytest.mark.parametrize("method", ["modularity", "labels"])
def test_distributed_communities(make_graph, monkeypatch, method):
    """Clear groups come out as they are, single nodes as one, and the modularity is not below the kernel's."""
    text, group = clusters(8, 4, 4)
    nodes, edges = make_graph(text, more_nodes=["z1", "z2"])
    small = as_dict(communities.detect(nodes, edges, method), "community_id")
    monkeypatch.setattr(staging, "KERNEL_ROWS", 0)
    runs = [as_dict(communities.detect(nodes, e, method), "community_id") for e in (edges, edges.repartition(3))]
    assert runs[0] == runs[1] and runs[0].keys() == small.keys()
    of = runs[0]
    assert all((of[a] == of[b]) == (group[a] == group[b]) for a in group for b in group)
    pairs = [p.split(">") for p in text.split()]
    assert modularity(pairs, of) >= modularity(pairs, small)
    if method == "modularity":
        assert of["z1"] == of["z2"] not in {of[x] for x in group}


def test_distributed_moves_split_and_adopt(make_graph, monkeypatch):
    monkeypatch.setattr(staging, "KERNEL_ROWS", 0)
    clique = " ".join(f"c{i:02}>c{j:02}" for i in range(14) for j in range(i))  # one community above a quarter: divided
    for method in ("modularity", "labels"):
        of = as_dict(communities.detect(*make_graph(clique), method), "community_id")
        assert len(set(of.values())) >= 2 and len(of) == 14
    of = as_dict(communities.detect(*make_graph("a>b", more_nodes=["x", "y"])), "community_id")
    assert of["a"] == of["b"] != of["x"] == of["y"]


def test_a_large_project_changes_nothing_for_a_small_one(spark, make_graph, monkeypatch):
    text, _ = clusters(2, 4, 1)
    small = make_graph(text, project="small")
    big = make_graph(clusters(4, 12, 2, "b")[0], project="big")
    alone = {f: sorted(map(tuple, f(*small).collect())) for f in (communities.detect, cycles.components, metrics.pagerank)}
    nodes, edges = small[0].unionByName(big[0]), small[1].unionByName(big[1])
    monkeypatch.setattr(staging, "KERNEL_ROWS", 60)
    for f, want in alone.items():
        both = f(nodes, edges)
        assert sorted(tuple(r) for r in both.filter("project = 'small'").select(*f(*small).columns).collect()) == want
        assert both.select("project").distinct().count() == 2


def test_cycles_beyond_the_kernel(spark, make_graph, monkeypatch):
    """Long cycles are found, and the cap holds project by project."""
    ring = " ".join(f"r{i:02}>r{(i + 1) % 12:02}" for i in range(12))
    pairs = " ".join(f"{a}>{b}" for a in "abcd" for b in "abcd" if a != b)
    nodes, edges = (x.unionByName(y) for x, y in zip(make_graph(ring, project="ring"), make_graph(pairs, project="dense"), strict=True))
    monkeypatch.setattr(staging, "KERNEL_ROWS", 0)
    got = cycles.report_cycles(nodes, edges, most=5).collect()
    assert [r["nodes"] for r in got if r["project"] == "ring"] == [[f"r{i:02}" for i in range(12)]]
    dense = sorted(r["nodes"] for r in got if r["project"] == "dense")
    assert dense == [["a", "b"], ["a", "c"], ["a", "d"], ["b", "c"], ["b", "d"]]
    assert cycles.simple_cycles(nodes, edges).filter("project = 'dense'").count() == 20


def test_all_paths_are_capped_by_project(make_graph):
    mesh = " ".join(f"{a}>{b}" for a in "abcdefg" for b in "abcdefg" if a != b)
    nodes, edges = make_graph(mesh)
    other = edges.withColumn("project", F.lit("q"))
    got = query.all_paths(edges.unionByName(other), "a", "g", 10, 20).groupBy("project").count().collect()
    assert {r["project"]: r["count"] for r in got} == {"p": 20, "q": 20}
    assert query.all_paths(edges, "a", "g", 3, None).count() == 1 + 5 + 20


def test_paths(spark, make_graph):
    nodes, edges = make_graph("a>b b>d a>c c>d d>e e>a")
    got = [(r["id"], r["kind"], r["weight"]) for r in query.shortest_path(edges, nodes, "a", "e").orderBy("step").collect()]
    assert got == [("a", "Imports", 1), ("b", "Imports", 1), ("d", "Imports", 1), ("e", None, 0)]
    assert [r["id"] for r in query.shortest_path(edges, nodes, "a", "a").collect()] == ["a"]
    assert query.shortest_path(edges, nodes, "a", "nowhere").count() == 0
    assert {tuple(r["nodes"]) for r in query.all_paths(edges, "a", "d", 4).collect()} == {("a", "b", "d"), ("a", "c", "d")}
    assert {tuple(r["nodes"]) for r in query.all_paths(edges, "a", "a", 5).collect()} == {("a", "b", "d", "e", "a"), ("a", "c", "d", "e", "a")}
    assert as_dict(query.transitive_dependents(edges, "d", 2), "depth") == {"b": 1, "c": 1, "a": 2}


def test_search_and_explain(spark, make_graph):
    nodes, edges = make_graph("app.x>app.y app.y>app.x lib.é>app.x")
    table = metrics.compute_metrics(nodes, edges)
    ids = lambda p, **k: [r["id"] for r in query.search(nodes, table, p, sort="name", **k).collect()]
    assert ids("app.*") == ["app.x", "app.y"] and ids("lib.?") == [] and ids("lib.??") == ["lib.é"] and ids("*", kind="Class") == []
    parts = communities.detect(nodes, edges)
    row = query.explain(nodes, edges, table, parts, cycles.report_cycles(nodes, edges), "app.x").first()
    assert row["cycle_peers"] == ["app.y"] and [d["id"] for d in row["direct_dependents"]] == ["app.y", "lib.é"] and row["transitive_dependent_count"] == 2
    assert query.suggest(nodes, "APP").count() == 2
