"""Paths and re-export walks have no bound on their length."""

from depweave.operators import extract, query


def test_path_of_more_than_100_hops(make_graph):
    names = [f"n{k:03}" for k in range(103)]
    nodes, edges = make_graph(" ".join(f"{a}>{b}" for a, b in zip(names, names[1:])))
    got = query.shortest_path(edges, nodes, names[0], names[-1]).orderBy("step").collect()
    assert [r["id"] for r in got] == names


def test_reexports_of_more_than_64_hops(spark):
    names = [f"m{k:03}" for k in range(68)]
    named = spark.createDataFrame([("p", a, "x", "p", b, "x", True) for a, b in zip(names, names[1:])], "project string, module string, name string, to_project string, to_module string, to_name string, to_local boolean")
    stars = spark.createDataFrame([], "project string, module string, ord struct<path: string, k: int>, to_project string, to_module string")
    starts = spark.createDataFrame([("p", names[0], "x")], "project string, module string, name string")
    known = spark.createDataFrame([("p", n) for n in names], "project string, id string")
    got = extract.walk_reexports(starts, named, stars, known).collect()
    assert [(r["state"], r["to_module"], r["to_name"], len(r["alternatives"])) for r in got] == [("canonical", names[-1], "x", 67)]
