"""Commands from a shell: what each writes, the cache, stubs put into the workspace file, mirrors, watching."""

import json
import os

import pytest

from depweave import __main__, api
from depweave.sources import config, files
from depweave.streaming import watch


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    root = tmp_path_factory.mktemp("cmd")

    def write(name, content):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)

    write("one/app/__init__.py", "")
    write("one/app/a.py", "import requests\nimport requests.api\nfrom app import b\n\nclass Token: ...\n")
    write("one/app/b.py", "import requests\nfrom app import a\n\nclass Token: ...\n")
    write("ws.toml", f"""
[settings]
output = "{root}/report"
format = ["json"]
[[project]]
name = "one"
repo = "{root}/one"
lang = ["python"]
local_prefix = "app"
[consolidation.intentional_mirrors]
tokens = ["one:app.a", "app.b"]
""")
    return root


def run(place, capsys, *words):
    capsys.readouterr()
    code = __main__.main([words[0], "--config", str(place / "ws.toml"), *words[1:]])
    return code, capsys.readouterr().out


def test_extract_writes_the_graph_and_the_cache(spark, place, capsys, monkeypatch):
    assert run(place, capsys, "extract")[0] == 0
    assert sorted(os.listdir(place / "report/one")) == [".extract-cache", "graph.json"]
    graph = json.loads((place / "report/one/graph.json").read_text())
    assert {n["id"] for n in graph["nodes"]} >= {"app", "app.a", "app.b", "app.a.Token"} and graph["links"]
    seen = []
    real = files.split_cached

    def split(*words):
        out = real(*words)
        seen.append([r["path"] for r in out[0].collect()])
        return out

    monkeypatch.setattr(files, "split_cached", split)
    first = (place / "report/one/graph.json").read_text()
    (place / "one/app/b.py").write_text((place / "one/app/b.py").read_text() + "# changed\n")
    run(place, capsys, "extract")
    assert seen == [["app/b.py"]]
    assert (place / "report/one/graph.json").read_text() == first
    assert spark.read.parquet(str(place / "report/one/.extract-cache")).count() == 3


def test_reports_and_what_is_read_from_them(spark, place, capsys):
    run(place, capsys, "analyze")
    analysis = json.loads((place / "report/one/analysis.json").read_text())
    assert "allowlisted_symbols" not in analysis and analysis["generated_at"].endswith("Z") and not (place / "report/one/history").exists()
    assert {"graph_nodes.csv", "graph_edges.csv"} <= set(os.listdir(place / "report/one"))
    groups = json.loads(run(place, capsys, "consolidation", "--format", "json")[1])["candidates"]
    assert [(g["leaf_name"], g["group_size"]) for g in groups] == [("Token", 2)]
    assert "**Token** × 2" in run(place, capsys, "consolidation")[1]
    found = json.loads(run(place, capsys, "suggest-stubs", "--format", "json")[1])["candidates"]
    assert [c["prefix"] for c in found] == ["requests"] and found[0]["edge_weight"] >= 2
    assert 'external_stubs = ["requests"]' in run(place, capsys, "suggest-stubs", "--format", "toml")[1]
    before = (place / "ws.toml").read_text()
    assert run(place, capsys, "suggest-stubs", "--apply")[1].strip() == "changed"
    assert config.load(str(place / "ws.toml")).projects[0].stubs == ("requests",) and not (place / "ws.toml.part").exists()
    assert json.loads(run(place, capsys, "suggest-stubs", "--format", "json")[1])["candidates"] == []
    (place / "ws.toml").write_text(before)
    brief = json.loads(run(place, capsys, "session-brief")[1])
    assert brief["baseline_age_days"] == 0 and (place / "report/session-brief.json").exists()
    assert api.report_age(str(place / "report/one/analysis.json"), 4e9) > 20_000
    with pytest.raises(ValueError):
        api.suggest_stubs(spark, config.load(str(place / "ws.toml")), only="gone")


def test_drift_names_mirrors_and_writes_its_files(spark, place, capsys, tmp_path):
    text = json.loads((place / "report/one/analysis.json").read_text())
    for n in text["nodes"]:
        n["score"] = n["score"] / 2 if n["id"] == "app.a" else n["score"]
    (tmp_path / "old.json").write_text(json.dumps(text))
    out = run(place, capsys, "diff", str(tmp_path / "old.json"), str(place / "report/one"), "--output", str(tmp_path))[1]
    assert "- `app.a`" in out.split("## Intentional mirrors")[1].split("##")[0] and "tokens" in out
    assert json.loads((tmp_path / "drift-report.json").read_text())["hotspots"] and (tmp_path / "drift-report.md").exists()
    assert api.mirror_index(config.load(str(place / "ws.toml"))) == {"app.a": "tokens", "app.b": "tokens"}


def test_file_changes_reach_their_projects(spark, place, tmp_path):
    rebuilt = []
    changes = watch.file_changes(spark, str(place / "one"))
    query = watch.watch(changes, {"one": str(place / "one")}, rebuilt.append, str(tmp_path / "cp"), ["Python"], once=True)
    query.awaitTermination(120)
    assert rebuilt == [["one"]]


def test_paths_of_several_projects_belong_to_the_first(spark):
    from depweave.operators import extract

    rows = [("b", "src/x.ts", "src.x"), ("a", "src/x.ts", "src.x")]
    parsed = spark.createDataFrame(rows, "project string, path string, module_name string")
    got = extract.file_owners(parsed, {"b": extract.Context("r"), "a": extract.Context("r")}).filter("id = 'r/src/x.ts'").first()
    assert (got["owner"], got["others"]) == ("b", ["a"])
