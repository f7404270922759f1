"""Parsers on small sources, and whole trees through discovery, resolution and re-exports."""

import json

import pytest

from depweave.operators import contracts, extract
from depweave.sources import config, files, manifests, orm, parsers


def links(p, kind=None):
    return [(e[1], e[3], e[4], e[5]) for e in p.edges if kind in (None, e[2])]


def test_python():
    p = parsers.parse("Python", "app.main", b"import os, a.b as ab\nfrom .svc import run, Stop as S\nfrom x import *\n\nclass K:\n    def m(self):\n        run()\n        other()\ndef f():\n    S()\n    ab()\n")
    assert [n[:2] for n in p.nodes] == [("app.main", "Module"), ("app.main.K", "Class"), ("app.main.f", "Function")]
    assert [x[0] for x in links(p, "Imports")] == ["os", "a.b", ".svc", "x"]
    assert links(p, "Calls") == [(".svc.run", 2, 1.0, "Extracted"), (".svc.Stop", 2, 1.0, "Extracted"), (".svc.run", 7, 0.9, "Extracted"), (".svc.Stop", 10, 0.9, "Extracted"), ("a.b", 11, 0.9, "Extracted")]


def test_python_that_cannot_be_read():
    assert [n[0] for n in parsers.parse("Python", "m", b"def (:\n").nodes] == ["m"]


def test_typescript():
    src = b"""// import x from 'no'
import def, { a as b, c } from './lib';
import * as ns from "pkg";
import './side';
import type { T } from './types';
export { Course as C, D } from './course';
export * from './all';
export function go() { b(1); def(); obj.c(); }
export default class K { m() { ns(); } }
const { r } = require('req');
const s = "import y from 'no'";
interface I { x: string }
"""
    p = parsers.parse("TypeScript", "src.index", src)
    assert [(i["raw_target"], i["specs"], i["is_type_only"]) for i in p.named_imports] == [("./lib", ["default", "a", "c"], False), ("./types", ["T"], True)]
    assert [x[0] for x in links(p, "Imports")] == ["pkg", "./side", "./course", "./all", "req"]
    assert [(n[0].split(".")[-1], n[1]) for n in p.nodes[1:]] == [("C", "Function"), ("D", "Function"), ("go", "Function"), ("K", "Class")]
    assert [(r["is_star"], r["specs"]) for r in p.reexports] == [(False, [("Course", "C"), ("D", "D")]), (True, [])]
    assert [x[0] for x in links(p, "Calls")] == ["b", "def", "ns"]


def test_go():
    src = b'package h\nimport (\n\tf "fmt"\n\t"m/pkg/util" // "no"\n)\ntype S struct{ x int }\ntype I interface{ M() }\ntype (\n\tA int\n)\nfunc New() *S { return make2() }\nfunc (s *S) Run(x int) { helper(x); s.other() }\n'
    p = parsers.parse("Go", "h", src)
    assert [x[0] for x in links(p, "Imports")] == ["fmt", "m/pkg/util"]
    assert {(n[0], n[1]) for n in p.nodes[1:]} == {("h.S", "Class"), ("h.I", "Trait"), ("h.A", "Class"), ("h.New", "Function"), ("h.S.Run", "Method")}
    assert {(x[0], x[2], x[3]) for x in links(p, "Calls")} == {("make2", 0.7, "Inferred"), ("helper", 0.7, "Inferred")}


def test_rust():
    src = b"""use std::collections::{HashMap, hash_map::Entry as E, self};
pub use crate::types::Node;
use super::walk::*;
mod inner;
pub struct S;
enum Kind { A, B(u8), C { x: i32 } }
trait T { fn t(&self); }
const MAX: usize = 3;
impl<T> S { pub fn new() -> Self { let local = 1; local(); helper(); Node::make(1); println!("x"); } }
impl T for S { fn t(&self) {} }
fn free() { use a::b; b(); }
"""
    p = parsers.parse("Rust", "src.lib", src)
    assert {x[0] for x in links(p, "Imports")} == {"std::collections::HashMap", "std::collections::hash_map::Entry", "std::collections::self", "crate::types::Node", "super::walk", "inner", "a::b"}
    assert {(n[0].removeprefix("src.lib."), n[1]) for n in p.nodes[1:]} == {("S", "Class"), ("Kind", "Enum"), ("Kind.A", "Class"), ("Kind.B", "Class"), ("Kind.C", "Class"), ("T", "Trait"), ("MAX", "Class"), ("S.new", "Method"), ("S.t", "Method"), ("free", "Function")}
    assert {(x[0], x[2]) for x in links(p, "Calls")} == {("helper", 0.7), ("Node::make", 0.7), ("println", 0.6), ("b", 0.7)}
    assert p.use_aliases["E"] == "std::collections::hash_map::Entry" and p.use_aliases["Node"] == "crate::types::Node"
    assert [(r["raw_target"], r["specs"]) for r in p.reexports] == [("crate::types", [("Node", "Node")])]


def test_php():
    src = b"""<?php
namespace App\\Http;
use App\\Models\\User;
use App\\{Svc\\Mail, Log as L};
use function App\\util\\go;
interface Able {}
trait Tr { public function t() { x(); } }
final class Home extends Base { public function run() { go(); $this->no(); new User(); } }
function helper() { strlen("a"); }
"""
    p = parsers.parse("Php", "App.Http.Home", src)
    assert [x[0] for x in links(p, "Imports")] == ["App.Models", "App.Svc", "App", "App.util"]
    assert {(n[0].removeprefix("App.Http.Home."), n[1]) for n in p.nodes[1:]} == {("Able", "Trait"), ("Tr", "Trait"), ("Tr.t", "Method"), ("Home", "Class"), ("Home.run", "Method"), ("helper", "Function")}
    assert [x[0] for x in links(p, "Calls") if x[2] == 0.7] == ["x", "go", "strlen"]


@pytest.fixture
def tree(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)

    return tmp_path, write


def graph(spark, root, languages, project="p", ctx=None, prefix="", stubs=None):
    found = files.discover(spark, project, str(root), languages, prefix)
    nodes, edges = extract.build_graph(extract.parse_files(found), {project: ctx or extract.Context(prefix=prefix)}, stubs)
    return {r["id"]: r for r in nodes.collect()}, {(r["src"], r["dst"], r["kind"]): r for r in edges.collect()}


def test_python_tree(spark, tree):
    root, write = tree
    write("app/__init__.py", "")
    write("app/main.py", "from app.services.llm import ask\nfrom .models import user\nimport os\n\ndef main():\n    ask()\n")
    write("app/services/llm.py", "def ask():\n    pass\n")
    write("app/models/__init__.py", "")
    write("app/models/user.py", "class User: ...\n")
    write("app/main_test.py", "import app\n")
    write("node_modules/x.py", "import app\n")
    nodes, edges = graph(spark, root, ["Python"], prefix="app", stubs=spark.createDataFrame([("p", "os")], "project string, prefix string"))
    assert {k for k, v in nodes.items() if v["is_local"]} == {"app", "app.main", "app.main.main", "app.services.llm", "app.services.llm.ask", "app.models", "app.models.user", "app.models.user.User"}
    call = edges[("app.main", "app.services.llm.ask", "Calls")]
    assert call["weight"] == 2 and call["confidence"] == 1.0 and call["confidence_kind"] == "Extracted"
    assert edges[("app.main", "app.models", "Imports")]["confidence_kind"] == "Inferred" and edges[("app.main", "app.models", "Imports")]["confidence"] == 0.9
    assert edges[("app.main", "os", "Imports")]["confidence_kind"] == "ExpectedExternal" and edges[("app.main", "os", "Imports")]["confidence"] == 0.5
    assert not nodes["os"]["is_local"]


def test_barrels_collapse(spark, tree):
    root, write = tree
    write("src/consumer.ts", "import { Course } from './domain';\nexport function use() { Course(); }\n")
    write("src/domain/index.ts", "export { Course } from './entities';\n")
    write("src/domain/entities/index.ts", "export { Course } from './course';\n")
    write("src/domain/entities/course.ts", "export class Course {}\n")
    nodes, edges = graph(spark, root, ["TypeScript"])
    assert "src.domain.Course" not in nodes and "src.domain.entities.Course" not in nodes
    assert set(nodes["src.domain.entities.course.Course"]["alternative_paths"]) == {"src.domain.Course", "src.domain.entities.Course"}
    assert ("src.consumer", "src.domain.entities.course", "Imports") in edges


def test_aliases_lead_into_other_projects(spark, tree):
    root, write = tree
    write("apps/web/src/page.ts", "import { api } from '@core/api';\nimport { x } from '@/lib/x';\nimport { gone } from '@/missing';\n")
    write("apps/web/src/lib/x.ts", "export function x() {}\n")
    write("packages/core/src/api.ts", "export function api() {}\n")
    parts = [extract.parse_files(files.discover(spark, p, str(root / r), ["TypeScript"])) for p, r in (("web", "apps/web"), ("core", "packages/core"))]
    aliases = {"": [("@core/*", "../../packages/core/src/*"), ("@/*", "src/*")]}
    ctx = {"web": extract.Context("apps/web", aliases=aliases), "core": extract.Context("packages/core")}
    _, edges = extract.build_graph(parts[0].unionByName(parts[1]), ctx)
    got = {(r["src"], r["dst"]): r["confidence_kind"] for r in edges.filter("kind = 'Imports'").collect()}
    assert got == {("src.page", "src.api"): "Inferred", ("src.page", "src.lib.x"): "Inferred", ("src.page", "src.missing"): "Ambiguous"}
    _, edges = extract.build_graph(parts[0].unionByName(parts[1]), ctx, across=False)  # each project by itself
    got = {(r["src"], r["dst"]): r["confidence_kind"] for r in edges.filter("kind = 'Imports'").collect()}
    assert "Inferred" not in [v for (_, dst), v in got.items() if "api" in dst] and got["src.page", "src.lib.x"] == "Inferred"


def test_rust_and_go_names(spark, tree):
    root, write = tree
    write("src/lib.rs", "mod handler;\nuse crate::handler::run;\npub fn start() { run(); handler::stop(); here(); }\nfn here() {}\n")
    write("src/handler.rs", "pub fn run() {}\npub fn stop() {}\n")
    _, edges = graph(spark, root, ["Rust"], prefix="src")
    assert ("src", "src.handler.run", "Calls") in edges and ("src", "src.handler.stop", "Calls") in edges and ("src", "src.here", "Calls") in edges
    write("go/cmd/main.go", 'package main\nimport "ex.com/m/pkg/util"\nfunc main() { local() }\nfunc local() {}\n')
    write("go/pkg/util/u.go", "package util\nfunc U() {}\n")
    nodes, edges = graph(spark, root / "go", ["Go"], ctx=extract.Context(go_module="ex.com/m"))
    assert ("cmd", "pkg.util", "Imports") in edges and ("cmd", "cmd.local", "Calls") in edges


def test_reexport_cycle_ends(spark, tree):
    root, write = tree
    write("a.ts", "export { X } from './b';\n")
    write("b.ts", "export { X } from './a';\n")
    write("c.ts", "import { X } from './a';\n")
    _, edges = graph(spark, root, ["TypeScript"])
    assert ("c", "a", "Imports") in edges


def test_cache(spark, tree):
    root, write = tree
    write("m.py", "import os\n")
    write("n.py", "import sys\n")
    found = files.discover(spark, "p", str(root), ["Python"])
    cache = spark.createDataFrame(extract.parse_files(found).collect(), extract.PARSED).selectExpr("*", "1 version", "'' prefix_key")
    write("n.py", "import re\n")
    again = files.discover(spark, "p", str(root), ["Python"])
    todo, held = files.split_cached(again, cache)
    assert [r["path"] for r in todo.collect()] == ["n.py"] and [r["path"] for r in held.collect()] == ["m.py"]
    assert files.split_cached(again, cache, prefix_key="app")[0].count() == 2
    assert files.cache_stats(again, cache).first().asDict() == {"project": "p", "hits": 1, "misses": 1, "evicted": 0}


def test_prefix_detection(spark, tree):
    root, write = tree
    for i in range(7):
        write(f"src/f{i}.py", "")
    for i in range(3):
        write(f"lib/f{i}.py", "")
    assert files.detect_prefix(files.discover(spark, "p", str(root), ["Python"])).first()["prefix"] == "src"


def test_manifests():
    text = '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*", "no/*"], "one": ["x.ts"],},}}'
    assert manifests.tsconfig_aliases(text) == [("@/*", "src/*"), ("one", "x.ts")]
    assert manifests.match_alias("@/a/b", "@/*", "src/*") == "src/a/b" and manifests.match_alias("one", "one", "x.ts") == "x.ts" and manifests.match_alias("q", "@/*", "src/*") is None
    assert manifests.go_module("// x\nmodule ex.com/m\n") == "ex.com/m"
    assert manifests.psr4_mappings(json.dumps({"autoload": {"psr-4": {"App\\": "src/"}}, "autoload-dev": {"psr-4": {"T\\": ["t", "u"]}}})) == [("App\\", "src/"), ("T\\", "t/")]


def test_module_names(spark):
    rows = [("app/__init__.py", "Python"), ("src/index.ts", "TypeScript"), ("main.go", "Go"), ("pkg/a/x.go", "Go"), ("src/lib.rs", "Rust"), ("src/Http/Home.php", "Php"), ("application/x.py", "Python")]
    df = spark.createDataFrame(rows, "path string, language string")
    from pyspark.sql import functions as F

    name = files.module_name(F.col("path"), F.col("language"), "app")
    got = [r[0] for r in df.select(F.when(F.col("language") == "Php", files.psr4_module(F.col("path"), [("App\\", "src/"), ("Web\\", "src/Http/")], name)).otherwise(name)).collect()]
    assert got == ["app", "app.src", "app", "app.pkg.a", "app.src", "Web.Home", "application.x"]


def test_config():
    text = """
[settings]
output = "out"
weights = [0.1, 0.2, 0.3, 0.4]
[[project]]
name = "p"
repo = "."
lang = ["py", "typescript"]
local_prefix = ["app", "lib"]
[project.check]
max_cycles = 0
[consolidation]
allowlist = ["Token.*"]
[policy]
[[policy.group]]
name = "g"
match = ["app.*"]
partition_by = "segment:1"
[[policy.rule]]
name = "r"
from = ["group:g"]
to = ["project:*"]
"""
    c = config.parse(text)
    assert c.projects[0].languages == ("Python", "TypeScript") and c.projects[0].local_prefix.cache_key == "multi:app|lib" and c.projects[0].limits.max_cycles == 0
    assert c.weights.in_cycle == 0.4 and c.rules[0].name == "r"
    for bad in (text.replace("max_cycles", "max_cycle"), text.replace("group:g", "group:h"), text.replace("Token.*", "(?=x)"), text.replace('"py"', '"cobol"'), text.replace("segment:1", "first")):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_contract_sources(spark):
    schema = """
export const users = pgTable('users', {
  id: uuid('id').primaryKey(),
  fullName: text('full_name').notNull(),
  tags: tsvector('tags').notNull(),
  createdAt: timestamp('created_at').defaultNow(),
});
export const usersRelations = relations(users, ({ one, many }) => ({ posts: many(posts), boss: one(users, { fields: [users.id] }) }));
"""
    types = "export interface User { id: string; fullName: number | null; tags: string[]; createdAt?: Date; posts: Post[]; extra: 'a' | 'b' }"
    a, b = orm.orm_contract(schema, "users"), orm.ts_contract(types, "User")
    assert [(f["raw_name"], f["type"]["value"], f["nullable"]) for f in a["fields"]] == [("id", "string", True), ("fullName", "string", False), ("tags", "tsvector", False), ("createdAt", "date", True)]
    assert [(r["raw_name"], r["cardinality"]) for r in a["relations"]] == [("posts", "many"), ("boss", "one")]
    assert [(f["raw_name"], f["nullable"]) for f in b["fields"]] == [("id", False), ("fullName", True), ("tags", False), ("createdAt", True), ("posts", False), ("extra", False)]
    assert [r["cardinality"] for r in orm.as_relations(b, {"Post"})["relations"]] == ["many"]
    (f1, r1), (f2, r2) = orm.contract_rows("user", "orm", a), orm.contract_rows("user", "ts", b)
    fields = spark.createDataFrame(f1 + f2, "pair string, side string, raw_name string, type_json string, nullable boolean, line long, seq long")
    rels = spark.createDataFrame(r1 + r2, "pair string, side string, raw_name string, cardinality string, line long, seq long")
    alias = "array<struct<orm:string,ts:string>>"
    cfg = spark.createDataFrame([("user", [], ["extra"], [], [])], f"pair string, ignore_orm array<string>, ignore_ts array<string>, field_aliases {alias}, relation_aliases {alias}")
    got = {(r["violation"], r["name"], r["severity"]) for r in contracts.compare(fields, rels, cfg).collect()}
    assert got == {("NullabilityMismatch", "id", "error"), ("NullabilityMismatch", "fullName", "error"), ("TypeMismatch", "fullName", "error"), ("UnmappedOrmType", "tags", "warning"), ("FieldMissingOnOrm", "posts", "error"), ("RelationMissingOnTs", "posts", "error"), ("RelationMissingOnTs", "boss", "error")}
