"""From files to a graph: parse, resolve names, follow re-exports, merge.

Files are parsed where they lie, a task at a time. Everything after that is joins keyed by project: each raw import
becomes an ordered list of candidate ids (pure string work), and the first candidate that is known, or that needs no
check, is its target.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.operators.model import complete, merge_edges, merge_nodes, resolved_confidence, with_alternative_paths
from depweave.plans.staging import stage
from depweave.sources.manifests import match_alias, nearest
from depweave.sources.parsers import parse

PARSED = (
    "project string, path string, sha256 string, language string, module_name string, is_package boolean, "
    "nodes array<struct<id:string,kind:string,line:long>>, "
    "edges array<struct<src:string,dst:string,kind:string,line:long,confidence:double,confidence_kind:string>>, "
    "reexports array<struct<from_module:string,raw_target:string,line:long,is_star:boolean,specs:array<struct<exported:string,local:string>>>>, "
    "named_imports array<struct<from_module:string,raw_target:string,line:long,specs:array<string>,is_type_only:boolean>>, "
    "use_aliases map<string,string>"
)
ALIAS_DEPTH = 4
#: Endings that an import may carry.
TS_ENDINGS = (".mjs", ".cjs", ".mts", ".cts", ".jsx", ".tsx", ".js", ".ts")


@dataclass(frozen=True)
class Context:
    """What resolution needs to know about a project. aliases: folder of a path-alias file -> [(alias, target)]."""

    root: str = ""
    prefix: str = ""
    go_module: str | None = None
    aliases: dict[str, list[tuple[str, str]]] = field(default_factory=dict)


def parse_files(files: DataFrame) -> DataFrame:
    """files with content -> one row a file in the shape of PARSED."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f in pdf.itertuples(index=False):
                p = parse(f.language, f.module_name, bytes(f.content))
                rows.append({
                    "project": f.project, "path": f.path, "sha256": f.sha256, "language": f.language, "module_name": f.module_name, "is_package": f.is_package,
                    "nodes": [dict(zip(("id", "kind", "line"), n, strict=True)) for n in p.nodes],
                    "edges": [dict(zip(("src", "dst", "kind", "line", "confidence", "confidence_kind"), e, strict=True)) for e in p.edges],
                    "reexports": [r | {"specs": [{"exported": a, "local": b} for a, b in r["specs"]]} for r in p.reexports],
                    "named_imports": p.named_imports, "use_aliases": p.use_aliases,
                })
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in re.split(r", (?=\w+ )", PARSED)])

    return files.mapInPandas(run, PARSED)


def _relative(parts: list[str], tail: str) -> str:
    return ".".join([*parts, tail]) if tail else ".".join(parts)


def candidates(raw: str, module: str, is_package: bool, folder: str, use: dict[str, str], ctx: Context, depth: int = ALIAS_DEPTH) -> list[tuple[str, str, float]]:
    """Ordered (how, id, confidence) for a raw import. how: 'sure' needs no check, 'known' must be a known id, 'path' a known file, 'suffix' the only known id with that ending."""
    here = module.split(".") if module else []
    if raw.startswith(".") and not raw.startswith(("./", "../")):
        dots = len(raw) - len(raw.lstrip("."))
        up = dots - 1 + (not is_package)
        return [("sure", _relative(here[: max(len(here) - up, 0)], raw[dots:]), 0.9)]
    for alias, target in nearest(folder, ctx.aliases) or []:
        if (found := match_alias(raw, alias, target)) is not None:
            base = next(f for f in _above(folder) if f in ctx.aliases)
            path = posixpath.normpath(posixpath.join(ctx.root, base, found))
            inside = posixpath.relpath(path, ctx.root or ".")
            return [("path", path, 0.85), ("sure", raw if inside.startswith("..") else inside.replace("/", "."), 0.85)]
    if raw.startswith(("./", "../")):
        parts, rest = (here if is_package else here[:-1]), raw
        while rest.startswith(("./", "../")):
            if rest.startswith("../"):
                parts = parts[:-1]
            rest = rest[rest.index("/") + 1 :]
        rest = next((rest[: -len(e)] for e in TS_ENDINGS if rest.endswith(e)), rest)
        return [("sure", _relative(parts, rest.replace("/", ".")), 0.9)]
    if ctx.go_module and raw.startswith(ctx.go_module) and (rest := raw[len(ctx.go_module) :].removeprefix("/")):
        dotted = rest.replace("/", ".")
        return [("known", dotted, 0.9), ("suffix", dotted, 0.9), ("sure", dotted, 0.9)]
    if raw.startswith("crate::"):
        dotted = raw[7:].replace("::", ".")
        return [("sure", dotted if not ctx.prefix or dotted.startswith(ctx.prefix) else f"{ctx.prefix}.{dotted}", 0.9)]
    if raw.startswith(("super::", "self::")):
        rest = raw.removeprefix("self::")
        while rest.startswith("super::"):
            here, rest = here[:-1], rest[7:]
        return [("sure", _relative(here, rest.replace("::", ".")), 0.9)]
    if "\\" in raw:
        return [("sure", raw.lstrip("\\").replace("\\", "."), 1.0)]
    out = [("known", raw, 1.0)]
    if raw and module and not set(raw) & set("./\\"):
        out.append(("known", f"{module}.{raw.replace('::', '.')}", 1.0))
    if depth:
        head, mark, tail = raw.partition("::")
        full = use.get(raw)
        if full and full != raw:
            return out + candidates(full, module, is_package, folder, use, ctx, depth - 1)
        base = use.get(head) if mark else None
        if base and base != head and not base.startswith(head + "::"):
            return out + candidates(f"{base}::{tail}", module, is_package, folder, use, ctx, depth - 1)
    return [*out, ("sure", raw, 1.0)]


def _above(folder: str) -> Iterator[str]:
    while True:
        yield folder
        if not folder:
            return
        folder = posixpath.dirname(folder)


def file_owners(parsed: DataFrame, contexts: dict[str, Context]) -> DataFrame:
    """(id, target, owner, others): each path, with its ending, without it and as a package, and the module it is.

    A path that several projects hold belongs to the first of them in the workspace; `others` names the rest.
    """
    names = [F.lit(x) for p, c in contexts.items() for x in (p, c.root)]
    root = F.coalesce(F.element_at(F.create_map(*names), F.col("project")), F.lit("")) if names else F.lit("")
    full = F.when(root == "", F.col("path")).otherwise(F.concat(root, F.lit("/"), F.col("path")))
    plain = F.regexp_replace(full, r"\.[^./]+$", "")
    place = F.array_position(F.array(*[F.lit(p) for p in contexts]), F.col("owner")) if contexts else F.lit(0)
    rows = parsed.select(F.col("project").alias("owner"), F.col("module_name").alias("target"), F.explode(F.array(full, plain, F.regexp_replace(plain, "/(index|__init__|mod)$", ""))).alias("id"))
    first = F.struct(F.when(place > 0, place).otherwise(F.lit(1 << 30)), F.col("owner"), F.col("target"))
    out = rows.groupBy("id").agg(F.min_by(F.struct("target", "owner"), first).alias("b"), F.array_sort(F.collect_set("owner")).alias("all"))
    return out.select("id", "b.target", "b.owner", F.array_remove(F.col("all"), F.col("b.owner")).alias("others"))


def resolve(wanted: DataFrame, parsed: DataFrame, contexts: dict[str, Context], across: bool = True) -> DataFrame:
    """wanted(project, module, raw) -> plus target, owner (project of the target), is_local, resolver_confidence.

    Known ids are all modules and all defined symbols of a project. With `across`, a path alias may lead into another
    project.
    """
    info = parsed.select("project", F.col("module_name").alias("module"), "is_package", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), "use_aliases")
    info = info.groupBy("project", "module").agg(F.max("is_package").alias("is_package"), F.min("folder").alias("folder"), F.first("use_aliases").alias("use_aliases"))
    rows = wanted.select("project", "module", "raw").distinct().join(info, ["project", "module"], "left")
    schema = "project string, module string, raw string, options array<struct<how:string,id:string,confidence:double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                use = dict(r.use_aliases) if r.use_aliases is not None else {}
                found = candidates(r.raw, r.module, bool(r.is_package), r.folder or "", use, contexts.get(r.project, Context()))
                out.append((r.project, r.module, r.raw, [{"how": h, "id": i, "confidence": c} for h, i, c in found]))
            yield pd.DataFrame(out, columns=["project", "module", "raw", "options"])

    options = rows.mapInPandas(run, schema).select("project", "module", "raw", F.posexplode("options").alias("pos", "o")).select("project", "module", "raw", "pos", "o.*")
    defined = parsed.select("project", F.explode("nodes").alias("n")).select("project", F.col("n.id").alias("id"))
    known = stage(defined.unionByName(parsed.select("project", F.col("module_name").alias("id"))).distinct(), "known-ids")
    paths = file_owners(parsed, contexts).drop("others")
    ends = known.withColumn("parts", F.split("id", r"\.")).select("project", F.col("id").alias("target"), F.explode(F.expr("transform(sequence(2, greatest(size(parts), 2)), i -> array_join(slice(parts, i, size(parts)), '.'))")).alias("id")).filter("id <> ''")
    ends = ends.groupBy("project", "id").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    direct = options.filter("how in ('known', 'sure')").join(known.withColumn("is_local", F.lit(True)), ["project", "id"], "left").withColumn("is_local", F.coalesce("is_local", F.lit(False))).filter("is_local or how = 'sure'")
    columns = ["project", "module", "raw", "pos", "confidence", "target", "owner", "is_local"]
    direct = direct.withColumn("target", F.col("id")).withColumn("owner", F.col("project")).select(*columns)
    by_path = options.filter("how = 'path'").join(paths, "id").filter(F.lit(across) | (F.col("owner") == F.col("project"))).withColumn("is_local", F.lit(True)).select(*columns)
    by_end = options.filter("how = 'suffix'").join(ends, ["project", "id"]).withColumn("owner", F.col("project")).withColumn("is_local", F.lit(True)).select(*columns)
    best = direct.unionByName(by_path).unionByName(by_end).groupBy("project", "module", "raw").agg(F.min_by(F.struct("target", "owner", "is_local", F.col("confidence").alias("resolver_confidence")), "pos").alias("b"))
    return best.select("project", "module", "raw", "b.*")


def reexport_hops(parsed: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Named hops (project, module, name) -> (to_project, to_module, to_name, to_local), the last of a name; and stars (project, module, ord, to_project, to_module)."""
    entries = parsed.select("project", "path", F.posexplode("reexports").alias("k", "r")).select("project", "path", "k", F.col("r.from_module").alias("module"), F.col("r.raw_target").alias("raw"), "r.is_star", "r.specs")
    entries = entries.join(resolved, ["project", "module", "raw"])
    named = entries.filter("not is_star").select("project", "path", "k", "module", "owner", "target", "is_local", F.posexplode("specs").alias("j", "s"))
    named = named.groupBy("project", "module", F.col("s.local").alias("name")).agg(F.max_by(F.struct(F.col("owner").alias("to_project"), F.col("target").alias("to_module"), F.col("s.exported").alias("to_name"), F.col("is_local").alias("to_local")), F.struct("path", "k", "j")).alias("h"))
    stars = entries.filter("is_star and is_local").select("project", "module", F.struct("path", "k").alias("ord"), F.col("owner").alias("to_project"), F.col("target").alias("to_module"))
    return named.select("project", "module", "name", "h.*"), stars


def walk_reexports(starts: DataFrame, named: DataFrame, stars: DataFrame, known: DataFrame) -> DataFrame:
    """starts(project, module, name) -> plus state, to_project, to_module, to_name, alternatives.

    state 'canonical' (the module is known), 'unresolved' (it is not) or 'cycle'. A star is followed if its target
    exports the name itself. All starts move one hop a round, until none is open: a walk ends or meets a place it has seen.
    """
    named, stars = stage(named, "hops"), stage(stars, "stars")
    start = starts.select("project", "module", "name").distinct()
    open_rows = start.select(*[F.col(c).alias(f"s_{c}") for c in ("project", "module", "name")], "project", "module", "name", F.array().cast("array<string>").alias("alternatives"), F.array().cast("array<string>").alias("seen"))
    done = []
    through = stars.join(named.select(F.col("project").alias("to_project"), F.col("module").alias("to_module"), "name").distinct(), ["to_project", "to_module"])
    through = through.groupBy("project", "module", "name").agg(F.min_by(F.struct(F.col("to_project").alias("p"), F.col("to_module").alias("m")), "ord").alias("star"))
    while True:
        here = F.concat_ws("|", "project", "module", "name")
        step = open_rows.join(named, ["project", "module", "name"], "left").join(through, ["project", "module", "name"], "left")
        step = step.withColumn("state", F.when(F.array_contains("seen", here), "cycle").when(F.col("to_module").isNotNull() & ~F.col("to_local"), "outside").when(F.col("to_module").isNull() & F.col("star").isNull(), "end").otherwise("open"))
        step = stage(step.withColumn("seen", F.concat("seen", F.array(here))).withColumn("own", F.concat_ws(".", "module", "name")), "walk")
        start_columns = ["s_project", "s_module", "s_name"]
        ended = step.filter("state <> 'open'")
        done.append(ended.select(*start_columns, "state", F.when(F.col("state") == "outside", F.col("to_project")).otherwise(F.col("project")).alias("e_project"), F.when(F.col("state") == "outside", F.col("to_module")).otherwise(F.col("module")).alias("e_module"), F.when(F.col("state") == "outside", F.col("to_name")).otherwise(F.col("name")).alias("e_name"), F.when(F.col("state") == "outside", F.concat("alternatives", F.array("own"))).otherwise(F.col("alternatives")).alias("alternatives")))
        open_rows = step.filter("state = 'open'").select(*start_columns, F.coalesce("to_project", "star.p").alias("project"), F.coalesce("to_module", "star.m").alias("module"), F.coalesce("to_name", "name").alias("name"), F.concat("alternatives", F.array("own")).alias("alternatives"), "seen")
        if step.filter("state = 'open'").isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = out.join(known.select(F.col("project").alias("e_project"), F.col("id").alias("e_module")).distinct().withColumn("there", F.lit(True)), ["e_project", "e_module"], "left")
    state = F.when(F.col("state") == "cycle", "cycle").when((F.col("state") == "end") & F.col("there"), "canonical").otherwise("unresolved")
    return out.select(F.col("s_project").alias("project"), F.col("s_module").alias("module"), F.col("s_name").alias("name"), state.alias("state"), F.col("e_project").alias("to_project"), F.col("e_module").alias("to_module"), F.col("e_name").alias("to_name"), "alternatives")


def build_graph(parsed: DataFrame, contexts: dict[str, Context] | None = None, stubs: DataFrame | None = None, language: DataFrame | str = "Python", across: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and merged edges of all projects: names resolved, barrels collapsed into their canonical symbols, placeholders added.

    `across`: path aliases may lead from one project into another.
    """
    contexts = contexts or {}
    parsed = stage(parsed, "parsed")
    raw = parsed.select("project", "path", F.posexplode("edges").alias("k", "e")).select("project", "path", "k", "e.*")
    named_imports = parsed.select("project", "path", F.posexplode("named_imports").alias("k", "i")).select("project", "path", "k", F.col("i.from_module").alias("module"), F.col("i.raw_target").alias("raw"), "i.line", "i.specs")
    reexports = parsed.select("project", F.explode("reexports").alias("r")).select("project", F.col("r.from_module").alias("module"), F.col("r.raw_target").alias("raw"))
    wanted = raw.filter("kind <> 'Defines'").select("project", F.col("src").alias("module"), F.col("dst").alias("raw")).unionByName(named_imports.select("project", "module", "raw")).unionByName(reexports)
    resolved = stage(resolve(wanted, parsed, contexts, across), "resolved")
    known = parsed.select("project", F.col("module_name").alias("id")).distinct()
    named, stars = reexport_hops(parsed, resolved)
    named = stage(named, "named")
    asked = named_imports.join(resolved, ["project", "module", "raw"]).select("project", "path", "k", "module", "line", "raw", "owner", "target", "is_local", "resolver_confidence", F.posexplode("specs").alias("j", "name"))
    starts = named.select("project", "module", "name").unionByName(asked.filter("is_local").select(F.col("owner").alias("project"), F.col("target").alias("module"), "name"))
    walked = stage(walk_reexports(starts, named, stars, known), "walked")

    barrels = walked.join(named.select("project", "module", "name"), ["project", "module", "name"], "left_semi").filter("state = 'canonical'").select("project", F.concat_ws(".", "module", "name").alias("barrel"), "to_project", F.concat_ws(".", "to_module", "to_name").alias("canonical"), "alternatives").filter("barrel <> canonical")
    barrels = stage(barrels, "barrels")
    records = parsed.select("project", "path", "language", F.posexplode("nodes").alias("k", "n")).select("project", "path", "language", "k", "n.*")
    records = records.join(barrels.select("project", F.col("barrel").alias("id")), ["project", "id"], "left_anti")
    nodes = merge_nodes(records.select("project", "id", "kind", F.col("path").alias("file_path"), "language", "line", F.lit(True).alias("is_local"), F.array().cast("array<string>").alias("alternative_paths"), F.struct("path", "k").alias("seq")))
    more = barrels.select(F.col("to_project").alias("project"), F.col("canonical").alias("id"), F.explode("alternatives").alias("p")).groupBy("project", "id").agg(F.array_sort(F.collect_set("p")).alias("paths"))
    nodes = with_alternative_paths(nodes, more)

    seq = F.struct("path", F.lit(0).alias("part"), "k", F.lit(0).alias("j")).alias("seq")
    plain = raw.filter("kind <> 'Defines'").join(resolved.select("project", F.col("module").alias("src"), F.col("raw").alias("dst"), "target", "is_local", "resolver_confidence"), ["project", "src", "dst"])
    plain = plain.select("project", "src", F.col("dst").alias("raw_dst"), F.col("target").alias("dst"), "kind", "line", "confidence", "confidence_kind", "is_local", "resolver_confidence", seq)
    defines = raw.filter("kind = 'Defines'").select("project", "src", F.col("dst").alias("raw_dst"), "dst", "kind", "line", "confidence", "confidence_kind", F.lit(True).alias("is_local"), F.lit(1.0).alias("resolver_confidence"), seq)
    defines = defines.join(barrels.select("project", F.col("barrel").alias("dst")), ["project", "dst"], "left_anti").select(*plain.columns)
    fans = asked.join(walked.select(F.col("project").alias("owner"), F.col("module").alias("target"), "name", "state", "to_module"), ["owner", "target", "name"], "left")
    fans = fans.select("project", F.col("module").alias("src"), F.col("raw").alias("raw_dst"), F.when(F.col("state") == "canonical", F.col("to_module")).otherwise(F.col("target")).alias("dst"), F.lit("Imports").alias("kind"), "line", F.lit(1.0).alias("confidence"), F.lit("Extracted").alias("confidence_kind"), "is_local", "resolver_confidence", F.struct("path", F.lit(1).alias("part"), "k", "j").alias("seq"))
    edges = plain.unionByName(defines).unionByName(fans)
    exact = barrels.select("project", F.col("barrel").alias("dst"), "canonical")
    parent = barrels.select("project", F.col("barrel").alias("__up"), F.col("canonical").alias("__over"))
    edges = edges.join(exact, ["project", "dst"], "left").withColumn("__up", F.regexp_extract("dst", r"^(.*)\.[^.]+$", 1)).join(parent, ["project", "__up"], "left")
    target = F.coalesce("canonical", F.concat("__over", F.lit("."), F.substring_index("dst", ".", -1)), "dst")
    edges = edges.withColumn("is_local", F.col("is_local") | F.col("canonical").isNotNull()).withColumn("dst", target).drop("canonical", "__up", "__over")
    merged = merge_edges(resolved_confidence(edges, stubs))
    return complete(nodes, merged, language), merged
