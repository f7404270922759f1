"""From a workspace file to reports and back: commands, sinks, streams, expressions, rules."""

import json
import os
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from depweave import api, reports, sinks
from depweave.functions import text
from depweave.operators import cycles, drift, metrics, policy, smells
from depweave.sources import config, snapshots
from depweave.streaming import watch


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")

    def write(name, content):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)

    write("one/app/__init__.py", "")
    write("one/app/a.py", "from app import b\nimport numpy\n\nclass Token: ...\n")
    write("one/app/b.py", "from app import a\n\ndef go():\n    pass\n")
    write("two/app/__init__.py", "")
    write("two/app/a.py", "import numpy\nimport app.c\n\nclass Token: ...\n")
    write("two/app/c.py", "import requests, requests.api\n")
    write("schema.ts", "export const users = pgTable('users', { id: uuid('id').notNull() });\n")
    write("types.ts", "export interface User { id: number }\n")
    write("ws.toml", f"""
[settings]
output = "{root}/report"
format = ["json", "csv", "md", "html", "neo4j", "graphml", "obsidian"]
external_stubs = ["numpy"]
[[project]]
name = "one"
repo = "{root}/one"
lang = ["python"]
local_prefix = "app"
[project.check]
max_cycles = 0
[[project]]
name = "two"
repo = "{root}/two"
lang = ["python"]
local_prefix = "app"
[consolidation]
allowlist = ["Tok.*"]
[policy]
[[policy.group]]
name = "a"
match = ["app.a"]
[[policy.group]]
name = "rest"
match = ["app.*"]
[[policy.rule]]
name = "a-alone"
from = ["group:a"]
to = ["group:rest"]
[[contract.pair]]
name = "users"
orm = {{ file = "{root}/schema.ts", table = "users" }}
ts = {{ file = "{root}/types.ts", export = "User" }}
""")  # fmt: skip
    return root


@pytest.fixture(scope="module")
def done(spark, tree):
    return api.run(spark, config.load(str(tree / "ws.toml")), now=1_700_000_000_000_000_000)


def test_reports_are_whole(spark, tree, done):
    folder = tree / "report/one"
    graph, analysis = json.loads((folder / "graph.json").read_text()), json.loads((folder / "analysis.json").read_text())
    ids = {n["id"] for n in graph["nodes"]}
    assert {"app", "app.a", "app.a.Token", "app.b", "app.b.go", "numpy"} <= ids and graph["directed"] is True
    assert analysis["summary"]["total_nodes"] == len(ids) == len(analysis["nodes"]) and analysis["allowlisted_symbols"] == ["app.a.Token"]
    assert {e["in_cycle"] for e in analysis["edges"] if {e["source"], e["target"]} == {"app.a", "app.b"}} == {True}
    assert analysis["summary"]["top_hotspots"][0][1] >= analysis["summary"]["top_hotspots"][-1][1]
    lines = (folder / "graph_nodes.csv").read_text().splitlines()
    assert lines[0].split(",") == list(sinks.NODE_CSV) and len(lines) == len(ids) + 1
    ET.parse(folder / "graph.graphml")
    assert "CREATE (:Module" in (folder / "graph.cypher").read_text() and "# Architecture report: one" in (folder / "architecture_report.md").read_text()
    assert "</script>" in (folder / "architecture_graph.html").read_text() and "[[app.b]]" in (folder / "obsidian_vault/app.a.md").read_text()
    summary = json.loads((tree / "report/workspace-summary.json").read_text())
    assert {m["id"] for m in summary["shared_modules"]} >= {"app", "app.a", "numpy"} and len(summary["projects"]) == 3


def test_history_and_trend(spark, tree, done):
    folder = tree / "report/one"
    assert snapshots.is_history_text((folder / "history/1700000000000000000.json").read_text())
    api.run(spark, config.load(str(tree / "ws.toml")), formats=["json"], now=1_700_000_001_000_000_000)
    parts = api.trend(spark, str(folder))
    assert [r["captured_at"] for r in parts["points"].orderBy("captured_at").collect()] == [1_700_000_000_000_000_000, 1_700_000_001_000_000_000]
    assert parts["churn"].first()["moved_nodes"] == 0 and parts["hotspots"].count() == 0
    assert "# Trend: one" in "\n".join(reports.trend_markdown("one", parts)) and json.loads(reports.trend_json("one", parts))["project"] == "one"
    with pytest.raises(ValueError):
        snapshots.read_analysis(spark, str(folder / "history/1700000000000000000.json"))


def test_diff_and_compare(spark, tree, done):
    parts = api.diff(spark, str(tree / "report/one"), str(tree / "report/two"))
    assert {r["id"] for r in parts["nodes"].filter("change = 'added'").collect()} == {"app.c", "requests", "requests.api"}
    assert parts["cycles"].filter("change = 'resolved'").first()["nodes"] == ["app.a", "app.b"]
    text = api.compare(spark, str(tree / "report/one"), str(tree / "report/two"))
    assert text.startswith("# Drift: one → two") and "- app.a → app.b" in text
    assert json.loads(reports.drift_json(parts, ("l", "r")))["labels"] == {"left": "l", "right": "r"}
    assert "## Architecture: two" in api.pull_request(spark, str(tree / "report/two"), "two", str(tree / "report/one/analysis.json"))
    live = api.diff_live(spark, config.load(str(tree / "ws.toml")), str(tree / "report/one/analysis.json"), "one")
    assert live["nodes"].count() == 0


def test_check(spark, tree, done):
    ok, rows, found = api.check(spark, config.load(str(tree / "ws.toml")))
    by = {r["project"]: r for r in rows.collect()}
    assert not ok and by["one"]["violations"] == 1 and {(r["source_node"], r["target_node"]) for r in found.collect()} == {("app.a", "app.c")}
    report = json.loads((tree / "report/two/check-report.json").read_text())
    assert report["ok"] is False and report["contracts"][0]["violation"] == "TypeMismatch"


def test_tools(spark, done):
    t = api.Tools(done, "one")
    assert t.stats().first()["cycles"] == 1
    assert [r["id"] for r in t.search("app.?", sort="name").collect()] == ["app.a", "app.b"]
    assert api.shell_line(t, "path app.a app.b").count() == 2 and api.shell_line(t, "  ") is None and t.explain("nothing").count() == 0
    assert {r["id"] for r in t.dependents("app.b").collect()} == {"app.a"} and t.transitive_dependents("numpy").count() == 2
    with pytest.raises(ValueError):
        api.shell_line(t, "path app.a")
    assert json.loads(api.session_scope(t, ["app.a", "app.b"]))["nodes"][0]["cycle_peers"] == ["app.b"]


def test_session_brief(spark, tree, done):
    brief = json.loads(api.session_brief(spark, str(tree / "report"), ["one", "two", "gone"]))
    assert brief["baseline_age_days"] == 0 and brief["cycles"][0]["cycle"] == "app.a → app.b"
    with pytest.raises(ValueError):
        api.session_brief(spark, str(tree / "report"), ["gone"])


def test_prune(tmp_path):
    for name, files in {"old": ["graph.json"], "mine": ["graph.json", "notes.txt"], "kept": ["graph.json"], "empty": []}.items():
        (tmp_path / name).mkdir()
        for f in files:
            (tmp_path / name / f).write_text("")
    assert sinks.prune(str(tmp_path), ["kept"]) == ["old"] and sorted(os.listdir(tmp_path)) == ["empty", "kept", "mine"]


def test_stub_suggestions(spark, done):
    out, seen = smells.suggest_stubs(done.nodes, done.edges, spark.createDataFrame([("one", "numpy"), ("two", "numpy")], "project string, prefix string"), min_edges=1)
    assert [(r["prefix"], r["scope"], r["edge_weight"]) for r in out.collect()] == [("requests", "two", 2)] and [r["prefix"] for r in seen.filter("state = 'covered'").collect()] == ["numpy"]
    assert "external_stubs" in reports.stubs_toml(out) and "`requests`" in "\n".join(reports.stubs_markdown(out, seen))
    file = '[settings]\noutput = "x"\n\n[[project]]\nname = "two"\nexternal_stubs = ["a"]\n'
    once = reports.apply_stubs(file, {"settings": ["s"], "two": ["requests", "a"]})
    assert 'external_stubs = ["s"]' in once and '["a", "requests"]' in once and reports.apply_stubs(once, {"settings": ["s"], "two": ["requests"]}) == once


def test_consolidation_report(spark, done):
    found = smells.consolidation(done.metrics, done.nodes, 2, across=True)
    assert {r["leaf_name"]: r["project_count"] for r in found.collect()}["Token"] == 2
    assert "**Token** × 2" in "\n".join(reports.consolidation_markdown(found, across=True))


def test_watch(spark, tmp_path):
    changes = tmp_path / "changes"
    schema = "path string"
    spark.createDataFrame([("/w/one/a.py",), ("/w/one/b.py",), ("/w/two/x.md",), ("/w/two/node_modules/y.py",), ("/w/out/z.py",)], schema).write.parquet(str(changes))
    seen = []
    stream = spark.readStream.schema(schema).parquet(str(changes))
    watch.watch(stream, {"one": "/w/one", "two": "/w/two", "out": "/w/out"}, seen.append, str(tmp_path / "cp"), ["Python"], output="/w/out", once=True).awaitTermination()
    assert seen == [["one"]]


def test_text_expressions(spark):
    one = lambda column, **values: spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]
    x = F.col("x")
    prefix = {("a::b::c", "Rust"): "a", ("a.b", "Python"): "a", ("@s/p/q", "TypeScript"): "@s/p", ("@s", "TypeScript"): "@s", ("p/q", "TypeScript"): "p", ("github.com/a/b/c", "Go"): "github.com/a/b", ("fmt.Println", "Go"): "fmt", ("net/http", "Go"): "net", (" ", "Go"): None, ("z.z", "C"): "z.z"}
    for (value, language), want in prefix.items():
        assert one(text.extract_prefix(x, F.col("l")), x=value, l=language) == want
    assert [one(text.top_segment(x), x=v) for v in ("a::b.c", "a/b", "a.b/c", "abc", " ")] == ["a", "a", "a", "abc", None]
    assert [one(text.snake_to_camel(x), x=v) for v in ("created_at", "_x", "a__b", "plain", "a_")] == ["createdAt", "X", "aB", "plain", "a"]
    assert one(text.canonical_rotation(x), x=["c", "a", "b"]) == ["a", "b", "c"]
    assert [one(text.glob_match(x, p), x="app.a.b") for p in ("app.*", "*.b", "app.?.b", "app", "a?p.*b", "*c")] == [True, True, True, False, True, False]
    assert one(text.stub_candidates(x), x="a::b/c.d") == ["a", "a::b", "a::b/c", "a::b/c.d"]
    assert one(text.cypher_escape(x), x="a'b\\") == "a\\'b\\\\" and one(text.xml_escape(x), x="<a&\"'>") == "&lt;a&amp;&quot;&apos;&gt;"
    assert one(text.iso_utc(x), x=0) == "1970-01-01T00:00:00Z" and text.anchored("a|b") == "^a|b$"
    assert one(text.age_days(x, F.lit("2024-01-03T00:00:00Z").cast("timestamp")), x="2024-01-01T12:00:00Z") == 1


def test_policy_checks_its_rules():
    group = policy.Group("g", ("a.*",))
    for groups, rules in (([group, group], []), ([policy.Group("", ("a",))], []), ([group], [policy.Rule("r", ("group:x",), ("group:g",))]), ([group], [policy.Rule("r", ("g",), ("group:g",))]), ([group], [policy.Rule("r", (), ("group:g",))]), ([policy.Group("g", ("a",), (), "seg")], [])):
        with pytest.raises(policy.PolicyError):
            policy.compiled(groups, rules)


def test_partition_exemption(make_graph):
    nodes, edges = make_graph("f.x.a>f.x.b f.x.a>f.y.c f.x.a>f.x.a")
    group = policy.Group("f", ("f.*",), partition_by="segment:1")
    found = policy.evaluate(nodes, edges, [group], [policy.Rule("r", ("group:f",), ("group:f",), allow_same_partition=True)])
    assert {(r["source_node"], r["target_node"]) for r in found.collect()} == {("f.x.a", "f.y.c"), ("f.x.a", "f.x.a")}


def test_unmoved_scores_count_as_falling_at_threshold_zero(spark):
    a = spark.createDataFrame([("p", "x", 0.5), ("p", "y", 0.1)], "project string, id string, score double")
    got = {r["id"]: r["bucket"] for r in drift.hotspot_changes(a, a, threshold=0.0).collect()}
    assert got == {"x": "falling", "y": "falling"}


def test_weights_and_formats():
    assert config.parse_weights("1,0,0,0") == metrics.Weights(1, 0, 0, 0) and config.parse_formats("md, json") == ("md", "json") and config.first_given(None, 0, 1) == 0
    for bad in (lambda: config.parse_weights("1,2"), lambda: config.parse_formats("pdf"), lambda: config.parse("")):
        with pytest.raises(ValueError):
            bad()


def test_edge_flags_follow_the_cycle_list(spark):
    pairs = cycles.cycle_pairs(spark.createDataFrame([("p", ["a", "b", "c"])], "project string, nodes array<string>"))
    assert {(r["src"], r["dst"]) for r in pairs.collect()} == {("a", "b"), ("b", "c"), ("c", "a")}
