"""Queries over source code, file names and report lines made from the driver's tables, with the SQL that gives the same rows.

Each row of `part` becomes source files by a template in which {k} is its key and {a}, {b} are the key modulo 5 and 3.
The SQL fills templates of the expected records with the same numbers, so every file is checked record by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave import sinks
from depweave.catalog import BASE, GROUPS, RULES, case, flow, scored
from depweave.functions import text
from depweave.operators import extract, history, policy, query
from depweave.plans import graphs
from depweave.sources import files
from depweave.streaming import watch

KEYS = "(select distinct p_partkey k, p_partkey % 5 a, p_partkey % 3 b, p_partkey + 1 n from part) t"


def _filled(template: Column | str) -> Column:
    """A template with the numbers of the row put in."""
    out = F.lit(template) if isinstance(template, str) else template
    for name in "kabn":
        out = F.replace(out, F.lit("{" + name + "}"), F.col(name).cast("string"))
    return out


def _filled_sql(value: str) -> str:
    for name in "kabn":
        value = f"replace({value}, '{{{name}}}', {name}::varchar)"
    return value


def _quoted(value) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def code(spark: SparkSession, sf_dir: str, language: str, sources: dict[str, tuple[str, str]], project: str = "p") -> DataFrame:
    """files() rows: for each key of part, the sources {path template: (module template, text template)}."""
    keys = graphs.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).distinct()
    keys = keys.select("k", (F.col("k") % 5).alias("a"), (F.col("k") % 3).alias("b"), (F.col("k") + 1).alias("n"))
    table = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(m).alias("module"), F.lit(t).alias("text")) for p, (m, t) in sources.items()]))
    rows = keys.withColumn("f", table).select(_filled(F.col("f.path")).alias("path"), _filled(F.col("f.module")).alias("module_name"), _filled(F.col("f.text")).alias("content"))
    rows = rows.dropDuplicates(["path"]).withColumn("content", F.col("content").cast("binary"))
    return rows.select(F.lit(project).alias("project"), "path", F.lit(language).alias("language"), "module_name", files.is_package(F.col("path")).alias("is_package"), "content", F.sha2("content", 256).alias("sha256"))


def records(parsed: DataFrame) -> DataFrame:
    """All nodes and edges of parsed files: (module, a, b, kind, line, confidence, how); nodes have an empty b."""
    nodes = parsed.select("module_name", F.explode("nodes").alias("x")).select(F.col("module_name").alias("module"), F.col("x.id").alias("a"), F.lit("").alias("b"), "x.kind", "x.line", F.lit(1.0).alias("confidence"), F.lit("").alias("how"))
    edges = parsed.select("module_name", F.explode("edges").alias("x")).select(F.col("module_name").alias("module"), F.col("x.src").alias("a"), F.col("x.dst").alias("b"), "x.kind", "x.line", "x.confidence", F.col("x.confidence_kind").alias("how"))
    return nodes.unionByName(edges)


def _records_sql(module: str, nodes: list[tuple], edges: list[tuple]) -> str:
    """nodes (name or '', kind, line): defined below the module; edges (dst, kind, line, confidence, how)."""
    rows = [(module + ("." + n if n else ""), "", kind, line, 1.0, "") for n, kind, line in nodes]
    rows += [(module, f"{module}.{n}", "Defines", line, 1.0, "Extracted") for n, kind, line in nodes if n]
    rows += [(module, dst, kind, line, c, how) for dst, kind, line, c, how in edges]
    values = ", ".join("(" + ", ".join(_quoted(x) for x in r) + ")" for r in rows)
    return f"select {_filled_sql(_quoted(module))} module, {_filled_sql('a_')} a, {_filled_sql('b_')} b, kind, cast(line as bigint) line, cast(confidence as double) confidence, how from {KEYS}, (values {values}) v(a_, b_, kind, line, confidence, how)"


PYTHON = """import os, app.m{a} as mm
from .svc{b} import run{k}, Stop as S
from x{a} import *

class K{k}:
    def m(self):
        run{k}()
        other()

def f{k}():
    S()
    mm()
"""
_E = ("Extracted",)


@case(_records_sql("app.p{k}", [("", "Module", 1), ("K{k}", "Class", 5), ("f{k}", "Function", 10)], [("os", "Imports", 1, 1.0, *_E), ("app.m{a}", "Imports", 1, 1.0, *_E), (".svc{b}", "Imports", 2, 1.0, *_E), ("x{a}", "Imports", 3, 1.0, *_E), (".svc{b}.run{k}", "Calls", 2, 1.0, *_E), (".svc{b}.Stop", "Calls", 2, 1.0, *_E), (".svc{b}.run{k}", "Calls", 7, 0.9, *_E), (".svc{b}.Stop", "Calls", 11, 0.9, *_E), ("app.m{a}", "Calls", 12, 0.9, *_E)]))
def extract_python(spark, sf_dir):
    return records(extract.parse_files(code(spark, sf_dir, "Python", {"app/p{k}.py": ("app.p{k}", PYTHON)})))


TYPESCRIPT = """import def, { a as b, c } from './lib{a}';
import * as ns from "pkg{b}";
import './side';
export function go{k}() { b(1); def(); obj.c(); }
export default class K{k} { m() { ns(); } }
const { r } = require('req{a}');
// import x from 'no'
"""


@case(_records_sql("src.p{k}", [("", "Module", 1), ("go{k}", "Function", 4), ("K{k}", "Class", 5)], [("pkg{b}", "Imports", 2, 1.0, *_E), ("./side", "Imports", 3, 1.0, *_E), ("req{a}", "Imports", 6, 1.0, *_E), ("b", "Calls", 4, 0.9, *_E), ("def", "Calls", 4, 0.9, *_E), ("ns", "Calls", 5, 0.9, *_E)]))
def extract_typescript(spark, sf_dir):
    return records(extract.parse_files(code(spark, sf_dir, "TypeScript", {"src/p{k}.ts": ("src.p{k}", TYPESCRIPT)})))


REEXPORTS = """import { x{a}, y } from './lib{a}';
import type { T } from './types';
export { Course{k} as C, D } from './course{b}';
export * from './all';
"""


@case(f"""select {_filled_sql("'src.i{k}'")} module, {_filled_sql("t_")} target, kind, {_filled_sql("n_")} as names, cast(line as bigint) line from {KEYS},
(values ('./course{{b}}', 'export', 'Course{{k}}>C,D>D', 3), ('./all', 'star', '', 4), ('./lib{{a}}', 'import', 'x{{a}},y', 1), ('./types', 'type', 'T', 2)) v(t_, kind, n_, line)""")
def extract_reexports(spark, sf_dir):
    """Re-exports and named imports of TypeScript files."""
    parsed = extract.parse_files(code(spark, sf_dir, "TypeScript", {"src/i{k}.ts": ("src.i{k}", REEXPORTS)}))
    out = parsed.select("module_name", F.explode("reexports").alias("r")).select(F.col("module_name").alias("module"), F.col("r.raw_target").alias("target"), F.when(F.col("r.is_star"), "star").otherwise("export").alias("kind"), F.array_join(F.transform("r.specs", lambda s: F.concat(s["exported"], F.lit(">"), s["local"])), ",").alias("names"), "r.line")
    named = parsed.select("module_name", F.explode("named_imports").alias("r")).select(F.col("module_name").alias("module"), F.col("r.raw_target").alias("target"), F.when(F.col("r.is_type_only"), "type").otherwise("import").alias("kind"), F.array_join("r.specs", ",").alias("names"), "r.line")
    return out.unionByName(named)


GO = """package h
import (
\tf "fmt{a}"
\t"m/pkg/util{b}" // "no"
)
type S{k} struct{ x int }
type I interface{ M() }
func New{k}() *S { return make{k}() }
func (s *S{k}) Run(x int) { helper(x); s.other() }
"""


@case(_records_sql("h{k}", [("", "Module", 1), ("S{k}", "Class", 6), ("I", "Trait", 7), ("New{k}", "Function", 8), ("S{k}.Run", "Method", 9)], [("fmt{a}", "Imports", 3, 1.0, *_E), ("m/pkg/util{b}", "Imports", 4, 1.0, *_E), ("make{k}", "Calls", 8, 0.7, "Inferred"), ("helper", "Calls", 9, 0.7, "Inferred")]))
def extract_go(spark, sf_dir):
    return records(extract.parse_files(code(spark, sf_dir, "Go", {"h{k}/x.go": ("h{k}", GO)})))


RUST = """use std::collections{a}::HashMap;
use super::walk{b}::*;
mod inner;
pub struct S{k};
enum Kind { A, B(u8) }
trait T { fn t(&self); }
const MAX: usize = 3;
impl S{k} { pub fn new() -> Self { helper{a}(); println!("x"); } }
fn free{k}() { Node::make(1); }
"""


@case(_records_sql("src.p{k}", [("", "Module", 1), ("S{k}", "Class", 4), ("Kind", "Enum", 5), ("Kind.A", "Class", 5), ("Kind.B", "Class", 5), ("T", "Trait", 6), ("MAX", "Class", 7), ("S{k}.new", "Method", 8), ("free{k}", "Function", 9)], [("std::collections{a}::HashMap", "Imports", 1, 1.0, *_E), ("super::walk{b}", "Imports", 2, 1.0, *_E), ("inner", "Imports", 3, 1.0, *_E), ("helper{a}", "Calls", 8, 0.7, "Inferred"), ("println", "Calls", 8, 0.6, "Inferred"), ("Node::make", "Calls", 9, 0.7, "Inferred")]))
def extract_rust(spark, sf_dir):
    return records(extract.parse_files(code(spark, sf_dir, "Rust", {"src/p{k}.rs": ("src.p{k}", RUST)})))


PHP = """<?php
namespace App\\Http;
use App\\Models{a}\\User;
use function App\\util{b}\\go;
interface Able{k} {}
final class Home{k} extends Base { public function run() { go(); $this->no(); } }
function helper{k}() { strlen("a"); }
"""


@case(_records_sql("App.Http.H{k}", [("", "Module", 1), ("Able{k}", "Trait", 5), ("Home{k}", "Class", 6), ("Home{k}.run", "Method", 6), ("helper{k}", "Function", 7)], [("App.Models{a}", "Imports", 3, 1.0, *_E), ("App.util{b}", "Imports", 4, 1.0, *_E), ("App.Models{a}.User", "Calls", 3, 1.0, *_E), ("App.util{b}.go", "Calls", 4, 1.0, *_E), ("go", "Calls", 6, 0.7, "Inferred"), ("strlen", "Calls", 7, 0.7, "Inferred")]))
def extract_php(spark, sf_dir):
    return records(extract.parse_files(code(spark, sf_dir, "Php", {"src/Http/H{k}.php": ("App.Http.H{k}", PHP)})))


# --- resolution --------------------------------------------------------------------------------------------------


def _imports(edges: DataFrame, kinds: tuple[str, ...] = ("Imports", "Calls")) -> DataFrame:
    return edges.filter(F.col("kind").isin(*kinds)).select("src", "dst", "kind", "weight", "confidence", "confidence_kind")


#: Keys, and whether the next one exists.
_NEXT = f"select t.*, x.k is not null has from {KEYS} left join (select distinct p_partkey k from part) x on x.k = t.n"


@case(f"""with t as ({_NEXT})
select 'app.p' || k src, 'app.p' || n dst, 'Imports' kind, 1::bigint weight, case when has then 1.0 else 0.5 end::double confidence, case when has then 'Extracted' else 'Ambiguous' end confidence_kind from t
union all select 'app.p' || k, 'app.p' || n || '.f' || n, 'Calls', 2, case when has then 1.0 else 0.5 end, case when has then 'Extracted' else 'Ambiguous' end from t
union all select 'app.p' || k, 'os', 'Imports', 1, 0.5, 'ExpectedExternal' from t
union all select 'app.p' || k, 'app.q' || a, 'Imports', 1, 0.5, 'Ambiguous' from t union all select 'app.p' || k, 'app.q' || a || '.z', 'Calls', 1, 0.5, 'Ambiguous' from t""")
def resolve_python(spark, sf_dir):
    """A chain of modules: known targets, relative ones that are not there, a stub, and the last without a successor."""
    source = "from app.p{n} import f{n}\nimport os\nfrom .q{a} import z\n\ndef f{k}():\n    f{n}()\n"
    parsed = extract.parse_files(code(spark, sf_dir, "Python", {"app/p{k}.py": ("app.p{k}", source)}))
    stubs = spark.createDataFrame([("p", "os")], "project string, prefix string")
    return _imports(extract.build_graph(parsed, {"p": extract.Context(prefix="app")}, stubs)[1])


@case(f"select 'src.d' || k || '.e.C' || k id, 'src.d' || k || '.C' || k alternatives, 'src.c' || k importer, 'src.d' || k || '.e' target, 'Imports' kind from {KEYS}")
def resolve_reexports(spark, sf_dir):
    """Barrels: a class is known by the module that defines it, its other names are kept, importers point at that module."""
    sources = {
        "src/c{k}.ts": ("src.c{k}", "import { C{k} } from './d{k}';\nexport function use{k}() {}\n"),
        "src/d{k}/index.ts": ("src.d{k}", "export { C{k} } from './e';\n"),
        "src/d{k}/e.ts": ("src.d{k}.e", "export class C{k} {}\n"),
    }
    parsed = extract.parse_files(code(spark, sf_dir, "TypeScript", sources))
    nodes, edges = extract.build_graph(parsed, {"p": extract.Context()}, None, "TypeScript")
    named = nodes.filter(F.size("alternative_paths") > 0).select("id", F.array_join("alternative_paths", ",").alias("alternatives"), F.regexp_extract("id", r"^(.*)\.[^.]+$", 1).alias("target"))
    asked = edges.filter("kind = 'Imports' and src like 'src.c%'").select(F.col("src").alias("importer"), F.col("dst").alias("target"), "kind")
    return named.join(asked, "target").select("id", "alternatives", "importer", "target", "kind")


@case(f"select 'src.p' || k src, 'src.lib.x' || k dst, 0.85::double confidence, 'Inferred' confidence_kind from {KEYS} union all select 'src.p' || k, 'src.gone' || a, 0.5, 'Ambiguous' from {KEYS}")
def resolve_aliases(spark, sf_dir):
    """Path aliases of a TypeScript project: one that leads to a file, one that does not."""
    sources = {"src/p{k}.ts": ("src.p{k}", "import { x } from '@/lib/x{k}';\nimport { gone } from '@/gone{a}';\n"), "src/lib/x{k}.ts": ("src.lib.x{k}", "export function x() {}\n")}
    parsed = extract.parse_files(code(spark, sf_dir, "TypeScript", sources))
    edges = extract.build_graph(parsed, {"p": extract.Context(aliases={"": [("@/*", "src/*")]})}, None, "TypeScript")[1]
    return edges.filter("kind = 'Imports' and src like 'src.p%'").select("src", "dst", "confidence", "confidence_kind")


@case(f"""with t as ({_NEXT}) select 'src.p' || k src, 'src.p' || n || '.run' || n dst, case when has then 'local' else 'outside' end place from t union all select 'src.p' || k, 'src.p' || k || '.here' || k, 'local' from t""")
def resolve_rust(spark, sf_dir):
    """Calls through a use alias of the crate, and of a function of the file itself."""
    source = "use crate::p{n}::run{n};\npub fn run{k}() { run{n}(); here{k}(); }\nfn here{k}() {}\n"
    parsed = extract.parse_files(code(spark, sf_dir, "Rust", {"src/p{k}.rs": ("src.p{k}", source)}))
    nodes, edges = extract.build_graph(parsed, {"p": extract.Context(prefix="src")}, None, "Rust")
    known = nodes.filter("is_local").select(F.col("id").alias("dst"), F.lit("local").alias("place"))
    return edges.filter("kind = 'Calls'").select("src", "dst").join(known, "dst", "left").select("src", "dst", F.coalesce("place", F.lit("outside")).alias("place"))


@case(f"""with t as ({_NEXT}) select 'pkg.p' || k src, 'pkg.p' || n dst, 'Imports' kind, case when has then 0.9 else 0.5 end::double confidence from t union all select 'pkg.p' || k, 'pkg.p' || k || '.local' || k, 'Calls', 0.7 from t""")
def resolve_go(spark, sf_dir):
    """Imports below the module's path, and calls inside a package."""
    source = 'package p{k}\nimport "ex.com/m/pkg/p{n}"\nfunc U{k}() { local{k}() }\nfunc local{k}() {}\n'
    parsed = extract.parse_files(code(spark, sf_dir, "Go", {"pkg/p{k}/x.go": ("pkg.p{k}", source)}))
    edges = extract.build_graph(parsed, {"p": extract.Context(go_module="ex.com/m")}, None, "Go")[1]
    return edges.filter("kind in ('Imports', 'Calls')").select("src", "dst", "kind", "confidence")


# --- files -------------------------------------------------------------------------------------------------------

_PATHS = "(select distinct p_partkey k, p_partkey % 5 a, case p_partkey % 9 when 0 then 'src/m' || p_partkey || '.py' when 1 then 'src/a/__init__.py' when 2 then 'src/t' || p_partkey || '.test.ts' when 3 then 'node_modules/x' || p_partkey || '.ts' when 4 then 'lib/x' || p_partkey || '.rs' when 5 then 'x' || p_partkey || '.txt' when 6 then 'app/y' || p_partkey || '/index.ts' when 7 then 'app/test_' || p_partkey || '.py' else 'cmd/z' || p_partkey || '.go' end path from part) t"


def _paths(spark, sf_dir) -> DataFrame:
    return spark.sql("select * from " + _PATHS.replace("from part", "from {part}"), part=graphs.read(spark, sf_dir, "part"))


@case(f"""select k, path, case regexp_extract(path, '[.]([a-z]+)$', 1) when 'py' then 'Python' when 'ts' then 'TypeScript' when 'rs' then 'Rust' when 'go' then 'Go' end as language, k % 9 = 2 is_test, k % 9 in (1, 6) is_package,
  case k % 9 when 0 then 'src.m' || k when 1 then 'src.a' when 2 then 'src.t' || k || '.test' when 3 then 'node_modules.x' || k when 4 then 'lib.x' || k when 5 then 'x' || k when 6 then 'app.y' || k when 7 then 'app.test_' || k else 'cmd' end module_name from {_PATHS}""")
def file_names(spark, sf_dir):
    """Language, test and package files, module names."""
    path = F.col("path")
    t = _paths(spark, sf_dir)
    return t.select("k", "path", files.language_of(path).alias("language"), files.is_test_file(path).alias("is_test"), files.is_package(path).alias("is_package"), files.module_name(path, files.language_of(path)).alias("module_name"))


@case(f"select k, k % 9 in (0, 1, 2, 6, 7) rebuild from {_PATHS}")
def watch_filter(spark, sf_dir):
    """The changes that a rebuild answers: source files of the languages outside excluded folders."""
    return _paths(spark, sf_dir).select("k", watch.should_rebuild(F.col("path"), ["Python", "TypeScript"]).alias("rebuild"))


@case(f"select distinct case when starts_with(path, 'src/') then 'one' when starts_with(path, 'app/') then 'two' end project from {_PATHS} where starts_with(path, 'src/') or starts_with(path, 'app/')")
def watch_projects(spark, sf_dir):
    return watch.affected_projects(_paths(spark, sf_dir), {"one": "src", "two": "app/"})


@case(f"select 'p' project, case when instr(path, '/') > 0 then split_part(path, '/', 1) else '' end root, count(*) n from {_PATHS} group by 2")
def file_roots(spark, sf_dir):
    return files.root_counts(_paths(spark, sf_dir).withColumn("project", F.lit("p")))


@case(f"""with q as (select 'p' || a project, path from {_PATHS}), r as (select project, case when instr(path, '/') > 0 then split_part(path, '/', 1) else '' end root, count(*) n from q group by 1, 2),
z as (select project, sum(n) t, max(n) filter (root = 'src') s, max(n) filter (root = 'app') x, list_reverse_sort(list(n) filter (root <> '' and n >= 10)) big from r group by 1)
select project, case when coalesce(s, 0) > 0.6 * t then 'src' when coalesce(x, 0) > 0.6 * t then 'app' else '' end prefix, coalesce(len(big) >= 2 and big[1] < 3 * big[2], false) ambiguous from z""")
def prefix_detection(spark, sf_dir):
    return files.detect_prefix(_paths(spark, sf_dir).withColumn("project", F.concat(F.lit("p"), F.col("a").cast("string"))))


_CACHED = "(select distinct p_partkey k from part) t"


@case(f"select 'p' project, count(*) filter (k % 4 <> 0 and k % 3 <> 0) hits, count(*) filter (k % 3 = 0 or k % 4 = 0) - count(*) filter (k % 7 = 0 and (k % 3 = 0 or k % 4 = 0)) misses, 0::bigint + count(*) filter (k % 7 = 0) evicted from {_CACHED} where k % 7 <> 0 or true".replace("count(*) filter (k % 4 <> 0 and k % 3 <> 0)", "count(*) filter (k % 7 <> 0 and k % 4 <> 0 and k % 3 <> 0)").replace("(k % 7 = 0) evicted", "(k % 7 = 0 and k % 3 <> 0) evicted"))
def cache_statistics(spark, sf_dir):
    """Files against cached parses: those of k % 3 = 0 were never cached, of k % 4 = 0 have changed, of k % 7 = 0 are gone."""
    k = graphs.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).distinct()
    row = lambda digest: [F.lit("p").alias("project"), F.concat(F.lit("m"), F.col("k").cast("string"), F.lit(".py")).alias("path"), digest.alias("sha256")]
    now = k.filter("k % 7 <> 0").select(*row(F.when(F.col("k") % 4 == 0, "new").otherwise("old")))
    return files.cache_stats(now, k.filter("k % 3 <> 0").select(*row(F.lit("old"))))


@case(f"select 'm' || k || '.py' path, case when k % 4 = 0 or k % 3 = 0 then 'parse' else 'held' end as state from {_CACHED} where k % 7 <> 0")
def cache_split(spark, sf_dir):
    """Which files are parsed again, and which earlier parses are taken; parses of another version or prefix do not count."""
    k = graphs.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).distinct()
    row = lambda digest: [F.lit("p").alias("project"), F.concat(F.lit("m"), F.col("k").cast("string"), F.lit(".py")).alias("path"), digest.alias("sha256")]
    now = k.filter("k % 7 <> 0").select(*row(F.when(F.col("k") % 4 == 0, "new").otherwise("old")))
    right = k.filter("k % 3 <> 0").select(*row(F.lit("old")), F.lit(files.CACHE_VERSION).alias("version"), F.lit("").alias("prefix_key"))
    wrong = k.filter("k % 3 = 0").select(*row(F.lit("old")), F.lit(files.CACHE_VERSION).alias("version"), F.lit("app").alias("prefix_key"))
    todo, held = files.split_cached(now, right.unionByName(wrong))
    return todo.select("path", F.lit("parse").alias("state")).unionByName(held.select("path", F.lit("held").alias("state")))


# --- text --------------------------------------------------------------------------------------------------------


@case("""select distinct 'a''b\\c/' || p_name || ' & <x> "q"' as raw, replace(replace('a''b\\c/' || p_name || ' & <x> "q"', '\\', '\\\\'), '''', '\\''') cypher,
  replace(replace(replace(replace(replace('a''b\\c/' || p_name || ' & <x> "q"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') xml, replace('a''b\\c/' || p_name || ' & <x> "q"', '/', '_') link from part""")
def text_escapes(spark, sf_dir):
    raw = F.concat(F.lit("a'b\\c/"), F.col("p_name"), F.lit(' & <x> "q"'))
    return graphs.read(spark, sf_dir, "part").select(raw.alias("raw")).distinct().select("raw", text.cypher_escape(F.col("raw")).alias("cypher"), text.xml_escape(F.col("raw")).alias("xml"), text.wikilink_target(F.col("raw")).alias("link"))


@case("""select event_id, strftime(make_timestamp(cast(floor(epoch(ts)) as bigint) * 1000000), '%Y-%m-%dT%H:%M:%SZ') iso, case when ts <= timestamp '2024-01-20 12:00:00' then cast(floor((epoch(timestamp '2024-01-20 12:00:00') - floor(epoch(ts))) / 86400) as bigint) end age_days,
  case event_type when 'view' then 'red' when 'click' then 'yellow' else 'green' end style from events""")
def times_and_styles(spark, sf_dir):
    """ISO times from epochs, ages in days (none in the future), styles by score."""
    score = F.when(F.col("event_type") == "view", 0.6).when(F.col("event_type") == "click", 0.3).otherwise(0.29)
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    t = graphs.read(spark, sf_dir, "events").select("event_id", F.unix_timestamp("ts").alias("s"), (F.col("ts") <= now).alias("past"), score.alias("score"))
    t = t.withColumn("iso", text.iso_utc(F.col("s")))
    age = F.when(F.col("past"), text.age_days(F.col("iso"), now))  # the text has whole seconds, the time itself may lie in the second after now
    return t.select("event_id", "iso", age.alias("age_days"), text.score_style(F.col("score")).alias("style"))


# --- reports -----------------------------------------------------------------------------------------------------

_RANK = "case kind when 'Imports' then 0 when 'Defines' then 1 else 2 end"


@case(f"with {BASE} select project, row_number() over (partition by project order by src, dst, {_RANK}) n, concat_ws(',', src, dst, kind, weight, line, printf('%.2f', confidence), confidence_kind) line from e")
def csv_edge_lines(spark, sf_dir):
    """The lines of graph_edges.csv, numbered in their order."""
    return sinks.numbered(sinks.edge_csv_lines(flow(spark, sf_dir)[1]))


@case(f"""with {BASE} select n.project, row_number() over (partition by n.project order by n.id) n, printf('CREATE (:%s {{id: ''%s'', file: ''%s'', language: ''%s'', score: %.6f, community: %d}});', n.kind, n.id, n.file_path, n.language, m.score, m.community_id) line
from m_n n join m on m.project = n.project and m.id = n.id""")
def cypher_node_lines(spark, sf_dir):
    nodes, edges = flow(spark, sf_dir)
    return sinks.numbered(sinks.cypher_node_lines(nodes, scored(nodes, edges)))


@case(f"with {BASE} select project, row_number() over (partition by project order by src, dst, {_RANK}) n, printf('MATCH (a {{id: ''%s''}}), (b {{id: ''%s''}}) CREATE (a)-[:%s {{weight: %d, confidence: %.2f, confidence_kind: ''%s''}}]->(b);', src, dst, upper(kind), weight, confidence, confidence_kind) line from e")
def cypher_edge_lines(spark, sf_dir):
    return sinks.numbered(sinks.cypher_edge_lines(flow(spark, sf_dir)[1]))


@case(f"""with {BASE} select n.project, row_number() over (partition by n.project order by n.id) n, printf('    <node id="%s"><data key="kind">%s</data><data key="file_path">%s</data><data key="score">%.6f</data><data key="community">%d</data></node>', n.id, n.kind, n.file_path, m.score, m.community_id) line
from m_n n join m on m.project = n.project and m.id = n.id""")
def graphml_node_lines(spark, sf_dir):
    nodes, edges = flow(spark, sf_dir)
    return sinks.numbered(sinks.graphml_node_lines(nodes, scored(nodes, edges)))


@case(f"""with {BASE} select project, row_number() over (partition by project order by src, dst, {_RANK}) n, printf('source="%s" target="%s"><data key="edge_kind">%s</data><data key="weight">%d</data><data key="confidence">%.2f</data></edge>', src, dst, kind, weight, confidence) line from e""")
def graphml_edge_lines(spark, sf_dir):
    return sinks.numbered(sinks.graphml_edge_lines(flow(spark, sf_dir)[1]))


@case(f"""with {BASE} select project, row_number() over (partition by project order by src, dst, {_RANK}) n, '{{"source":"' || src || '","target":"' || dst || '","kind":"' || kind || '","weight":' || weight || ',"line":' || line || ',"confidence":' || confidence::varchar || ',"confidence_kind":"' || confidence_kind || '"}}' line from e""")
def json_link_lines(spark, sf_dir):
    """The links of graph.json, numbered in their order."""
    return sinks.numbered(sinks.link_lines(flow(spark, sf_dir)[1]))


@case(f"""with {BASE} select project, row_number() over (partition by project order by id) n, '{{"id":"' || id || '","kind":"' || kind || '","file_path":"' || file_path || '","language":"' || language || '","line":' || line || ',"is_local":' || is_local::varchar || '}}' line from m_n""")
def json_node_lines(spark, sf_dir):
    return sinks.numbered(sinks.node_lines(flow(spark, sf_dir)[0]))


@case(f"""with {BASE}, o as (select project, src id, string_agg('- [[' || dst || ']] (' || kind || ')', chr(10) order by dst, kind) t from e group by 1, 2),
i as (select project, dst id, string_agg('- [[' || src || ']] (' || kind || ')', chr(10) order by src, kind) t from e group by 1, 2)
select n.project, n.id name, printf('# %s\n\nkind: %s\nfile: %s\nscore: %.3f\ncommunity: %d\n\n## Uses\n\n', n.id, n.kind, n.file_path, m.score, m.community_id) || coalesce(o.t, '') || chr(10) || chr(10) || '## Used by' || chr(10) || chr(10) || coalesce(i.t, '') as text
from m_n n join m on m.project = n.project and m.id = n.id left join o on o.project = n.project and o.id = n.id left join i on i.project = n.project and i.id = n.id""")
def vault_notes(spark, sf_dir):
    """The notes of the vault, one a node."""
    nodes, edges = flow(spark, sf_dir)
    return sinks.vault_notes(nodes, edges, scored(nodes, edges)).select("project", "name", "text")


@case(f"""with {BASE}, z as (select project, count(*) nodes, count(distinct community_id) c from m group by 1), s as (select project, sum(case when confidence_kind = 'Ambiguous' then 1 else 0 end) amb, avg(confidence) c, count(*) n from e group by 1),
k as (select *, row_number() over (partition by project order by score desc, id) r from m)
select z.project, 99::bigint captured_at, nodes total_nodes, s.n total_edges, z.c total_communities, round(s.c, 6) mean_confidence, (select string_agg(id || ' ' || printf('%.4f', score), ',' order by r) from k where k.project = z.project and r <= 20) top from z join s on s.project = z.project""")
def history_snapshot(spark, sf_dir):
    """A snapshot of each project in the shape of a history file: counts, confidence, the first twenty nodes."""
    nodes, edges = flow(spark, sf_dir)
    table = scored(nodes, edges).withColumn("in_cycle", F.lit(False))
    none = spark.createDataFrame([], "project string, nodes array<string>")
    snap = history.snapshot(nodes, edges, table, table.select("project", "id", "community_id"), none, 99)
    top = F.array_join(F.transform("top_hotspots", lambda h: F.concat(h["id"], F.lit(" "), F.format_string("%.4f", h["score"]))), ",")
    return snap.select("project", "captured_at", "summary.total_nodes", "summary.total_edges", "summary.total_communities", F.round("confidence_summary.mean_confidence", 6).alias("mean_confidence"), top.alias("top"))


@case(f"""with {BASE}, i as (select e.project, e.src, e.dst from e join m_n s on s.project = e.project and s.id = e.src and s.kind = 'Module' join m_n t on t.project = e.project and t.id = e.dst and t.kind = 'Module' where e.kind = 'Imports'),
ow as (select distinct id, project owner from m_n where is_local), x as (select i.*, coalesce(ow.owner, i.project) owner, cast(substr(split_part(src, '.', 2), 2) as int) % 2 = 0 se, cast(substr(split_part(dst, '.', 2), 2) as int) % 2 = 0 de from i left join ow on ow.id = i.dst),
v as (select project from x where se and not de and owner = 'web' union all select project from x where se and (de or owner = 'app') and not (de and split_part(src, '.', 3) = split_part(dst, '.', 3) and src <> dst) union all select project from x where owner = 'app' and project <> owner),
g as (select project, max(score) > 0.9e0 bad from m group by 1), r as (select g.project, bad, (select count(*) from v where v.project = g.project) n from g)
select project, not bad and n = 0 ok, n + bad::bigint violations, n policy_violations, {len(RULES)}::bigint rules_evaluated from r union all select null, bool_and(not bad and n = 0) and false, cast(sum(n + bad::bigint) as bigint) + 2, cast(sum(n) as bigint), {len(RULES)} from r""")
def check_report(spark, sf_dir):
    """The rows of the check report: gates, rules and two contract errors, project by project and in total."""
    nodes, edges = flow(spark, sf_dir)
    table = scored(nodes, edges)
    gate = policy.gates(table, edges, table, spark.createDataFrame([], "project string, nodes array<string>"), policy.Limits(None, 0.9))
    return policy.check_report(gate, policy.evaluate(nodes, edges, GROUPS, RULES), len(RULES), 2)


@case(f"""with {BASE}, f as (select e.project, e.src, e.dst, e.kind, e.confidence, e.confidence_kind from e), me as (select * from m where id = 'app.m1.x0.u1')
select me.project, me.id, me.in_degree, me.out_degree, (select string_agg(dst || ':' || kind, ',' order by dst, kind) from f where f.project = me.project and f.src = me.id) dependencies, (select string_agg(src || ':' || kind, ',' order by src, kind) from f where f.project = me.project and f.dst = me.id) dependents from me""")
def explain_node(spark, sf_dir):
    """The tool that explains a node: its metrics and both adjacencies."""
    nodes, edges = flow(spark, sf_dir)
    table = scored(nodes, edges)
    none = spark.createDataFrame([], "project string, nodes array<string>")
    out = query.explain(nodes, edges, table, table.select("project", "id", "community_id"), none, "app.m1.x0.u1")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["id"], F.lit(":"), x["kind"])), ",")
    return out.select("project", "id", "in_degree", "out_degree", shown("direct_dependencies").alias("dependencies"), shown("direct_dependents").alias("dependents"))
