"""Reports from the tables of one project: single files, built by Spark as lines of text and written where the caller says.

Reports are for people and tools that read whole files, so their lines are gathered by a sort; the tables themselves
stay available in any format that Spark writes.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterable
from datetime import datetime, timezone
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depweave.functions.text import confidence_label, cypher_escape, edge_kind_rank, script_safe, wikilink_target, xml_escape
from depweave.operators.cycles import cycle_pairs
from depweave.operators.history import confidence_summary

#: The files that a report folder may hold and still be pruned.
ARTIFACTS = ("graph.json", "analysis.json", "graph_nodes.csv", "graph_edges.csv", "architecture_report.md", "architecture_graph.html", "graph.cypher", "graph.graphml", "obsidian_vault", ".extract-cache", "drift-report.json", "drift-report.md")


def write_lines(lines: Iterable[str], path: str) -> str:
    """Stream lines into a file, through a neighbour that is renamed when it is whole."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".part", "w", encoding="utf-8") as out:
        for line in lines:
            out.write(line + "\n")
    os.replace(path + ".part", path)
    return path


def lines_of(df: DataFrame, line: Column, *order: Column | str) -> Iterable[str]:
    """One text column, in order, without holding more than a partition on the driver."""
    for row in df.orderBy(*order).select(line.alias("line")).toLocalIterator():
        yield row["line"]


def numbered(lines: DataFrame) -> DataFrame:
    """lines(project, line, sort columns ...) -> (project, n, line): numbered from 1 in their order, project by project."""
    order = [c for c in lines.columns if c.startswith("by_")]
    rank = F.row_number().over(Window.partitionBy("project").orderBy(*order))
    return lines.select("project", rank.cast("long").alias("n"), "line")


def _ordered(lines: DataFrame) -> Iterable[str]:
    yield from lines_of(lines, F.col("line"), *[c for c in lines.columns if c.startswith("by_")])


def _items(lines: Iterable[str]) -> Iterable[str]:
    """JSON texts as the lines of an array, with commas between them; one is held back at a time."""
    last = None
    for line in lines:
        if last is not None:
            yield last + ","
        last = line
    if last is not None:
        yield last


def _array(df: DataFrame, value: Column, *order: str) -> Iterable[str]:
    """The items of a JSON array of a column's JSON texts, line by line."""
    return _items(lines_of(df, value, *order))


def _by_edge(edges: DataFrame, line: Column) -> DataFrame:
    return edges.select("project", line.alias("line"), F.col("src").alias("by_1"), F.col("dst").alias("by_2"), edge_kind_rank(F.col("kind")).alias("by_3"))


def node_lines(nodes: DataFrame) -> DataFrame:
    """The nodes of graph.json; alternative_paths only where there are any."""
    paths = F.when(F.size("alternative_paths") > 0, F.col("alternative_paths"))
    node = F.to_json(F.struct("id", "kind", "file_path", "language", "line", "is_local", paths.alias("alternative_paths")))
    return nodes.select("project", node.alias("line"), F.col("id").alias("by_1"))


def link_lines(edges: DataFrame) -> DataFrame:
    """The links of graph.json."""
    return _by_edge(edges, F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "weight", "line", "confidence", "confidence_kind")))


def graph_json(nodes: DataFrame, edges: DataFrame) -> Iterable[str]:
    """Node-link form, line by line."""
    yield '{"directed":true,"multigraph":false,"nodes":['
    yield from _items(_ordered(node_lines(nodes)))
    yield '],"links":['
    yield from _items(_ordered(link_lines(edges)))
    yield "]}"


def analysis_json(metrics: DataFrame, edges: DataFrame, communities: DataFrame, cycles: DataFrame, allowlisted: Iterable[str] | None = None) -> Iterable[str]:
    """metrics with community_id. Edges carry the communities of their ends and whether they follow a reported cycle."""
    of = lambda end, name: metrics.select("project", F.col("id").alias(end), F.col("community_id").alias(name))
    looped = cycle_pairs(cycles).withColumn("in_cycle", F.lit(True))
    full = edges.join(of("src", "sc"), ["project", "src"], "left").join(of("dst", "tc"), ["project", "dst"], "left").join(looped, ["project", "src", "dst"], "left").withColumn("r", edge_kind_rank(F.col("kind")))
    edge = F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "confidence", "confidence_kind", F.coalesce("sc", F.lit(0)).alias("source_community"), F.coalesce("tc", F.lit(0)).alias("target_community"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle")))
    node = F.to_json(F.struct("id", "betweenness", "pagerank", "in_degree", "out_degree", "in_cycle", "score", "community_id", "hotspot_type"))
    group = F.to_json(F.struct(F.col("community_id").alias("id"), "members", "cohesion"))
    top = metrics.orderBy(F.desc("score"), "id").limit(20)
    counts = (metrics.count(), edges.count(), communities.count(), cycles.count())
    sums = confidence_summary(edges).drop("project")
    hot = F.concat(F.lit("["), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(","), F.col("score").cast("string"), F.lit("]"))
    yield '{"nodes":['
    yield from _array(metrics, node, F.desc("score"), "id")
    yield '],"edges":['
    yield from _array(full, edge, "src", "dst", "r")
    yield '],"communities":['
    yield from _array(communities, group, "community_id")
    yield '],"cycles":['
    yield from _array(cycles, F.to_json("nodes"), F.array_join("nodes", ">"))
    yield f'],"summary":{{"total_nodes":{counts[0]},"total_edges":{counts[1]},"total_communities":{counts[2]},"total_cycles":{counts[3]},"top_hotspots":['
    yield from _array(top, hot, F.desc("score"), "id")
    confidence = sums.select(F.to_json(F.struct(*sums.columns)).alias("j")).first()
    yield f']}},"generated_at":"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}","confidence_summary":{confidence["j"] if confidence else "{}"}'
    if allowlisted is not None:
        yield ',"allowlisted_symbols":['
        yield from _items(json.dumps(x, ensure_ascii=False) for x in allowlisted)
        yield "]"
    yield "}"


def _csv(columns: list[Column]) -> Column:
    quote = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *[quote(F.coalesce(c.cast("string"), F.lit(""))) for c in columns])


NODE_CSV = ("id", "kind", "file_path", "language", "line", "is_local", "betweenness", "pagerank", "in_degree", "out_degree", "in_cycle", "score", "community_id", "alternative_paths")
EDGE_CSV = ("source", "target", "kind", "weight", "line", "confidence", "confidence_kind")


def nodes_csv(nodes: DataFrame, metrics: DataFrame) -> Iterable[str]:
    full = nodes.drop("in_cycle").join(metrics.drop("hotspot_type"), ["project", "id"], "left").na.fill(0).withColumn("alternative_paths", F.array_join("alternative_paths", "|"))
    yield ",".join(NODE_CSV)
    yield from lines_of(full, _csv([F.col(c) for c in NODE_CSV]), F.desc("score"), "id")


def edge_csv_lines(edges: DataFrame) -> DataFrame:
    """The lines of graph_edges.csv below its header."""
    return _by_edge(edges, _csv([F.col("src"), F.col("dst"), F.col("kind"), F.col("weight"), F.col("line"), F.format_string("%.2f", "confidence"), F.col("confidence_kind")]))


def edges_csv(edges: DataFrame) -> Iterable[str]:
    yield ",".join(EDGE_CSV)
    yield from _ordered(edge_csv_lines(edges))


def markdown(project: str, nodes: DataFrame, edges: DataFrame, metrics: DataFrame, communities: DataFrame, cycles: DataFrame) -> Iterable[str]:
    """The architecture report: counts, a warning if confidence is low, hotspots, communities, cycles."""
    sums = confidence_summary(edges).first()
    yield f"# Architecture report: {project}"
    yield ""
    yield from ("| metric | value |", "|---|---|", f"| nodes | {nodes.count()} |", f"| edges | {edges.count()} |", f"| communities | {communities.count()} |", f"| cycles | {cycles.count()} |")
    if sums:
        yield f"| mean confidence | {sums['mean_confidence']:.2f} |"
        if sums["mean_confidence"] < 0.7 or sums["ambiguous_pct"] > 50:
            yield ""
            yield "> **Low confidence:** many edges could not be resolved; read the scores with care."
    yield from ("", "## Hotspots", "", "| # | node | score | in | out | betweenness | type | confidence |", "|---|---|---|---|---|---|---|---|")
    mean = edges.groupBy("project", F.col("dst").alias("id")).agg(F.avg("confidence").alias("c"))
    top = metrics.orderBy(F.desc("score"), "id").limit(20).join(mean, ["project", "id"], "left")
    row = F.format_string("`%s` | %.3f | %d | %d | %.1f | %s | %s |", "id", "score", "in_degree", "out_degree", "betweenness", "hotspot_type", confidence_label(F.col("c")))
    for rank, line in enumerate(lines_of(top, row, F.desc("score"), "id"), 1):
        yield f"| {rank} | {line}"
    yield from ("", "## Communities", "")
    yield from lines_of(communities, F.format_string("- **%d** (%d nodes, cohesion %.2f): %s", "community_id", F.size("members"), "cohesion", F.concat(F.array_join(F.slice("members", 1, 10), ", "), F.when(F.size("members") > 10, F.lit(", …")).otherwise(""))), "community_id")
    yield from ("", "## Cycles", "")
    yield from lines_of(cycles, F.concat(F.lit("- "), F.array_join(F.concat("nodes", F.slice("nodes", 1, 1)), " → ")), F.array_join("nodes", ">"))


_HEAD = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 8px;text-align:left}}tr:nth-child(even){{background:#f6f6f6}}canvas{{border:1px solid #ccc}}</style></head>
<body><h1>{title}</h1><input id="q" placeholder="filter"><p id="n"></p><canvas id="g" width="1100" height="700"></canvas><table><thead><tr><th>node</th><th>kind</th><th>score</th><th>in</th><th>out</th><th>community</th></tr></thead><tbody id="t"></tbody></table>
<script type="application/json" id="data">"""
#: Draws the nodes that pass the filter (the first 300 by score) around the centres of their communities, and their edges; a click filters by a node.
_TAIL = """</script>
<script>const d=JSON.parse(document.getElementById('data').textContent),t=document.getElementById('t'),q=document.getElementById('q'),g=document.getElementById('g'),c=g.getContext('2d');let seen=[];
function draw(rows){const at={},near={};seen=[];c.clearRect(0,0,g.width,g.height);const groups=[...new Set(rows.map(x=>x.community_id))];
rows.forEach(x=>{const k=groups.indexOf(x.community_id),a=2*Math.PI*k/groups.length,i=near[k]=(near[k]||0)+1,b=i*2.4,r=9*Math.sqrt(i);const p={x:550+(groups.length>1?400:0)*Math.cos(a)*.9+r*Math.cos(b),y:350+(groups.length>1?250:0)*Math.sin(a)+r*Math.sin(b),n:x};at[x.id]=p;seen.push(p)});
c.strokeStyle='#bbb';for(const e of d.links){const a=at[e.source],b=at[e.target];if(a&&b){c.beginPath();c.moveTo(a.x,a.y);c.lineTo(b.x,b.y);c.stroke()}}
for(const p of seen){c.fillStyle='hsl('+(p.n.community_id*67%360)+',60%,50%)';c.beginPath();c.arc(p.x,p.y,3+6*(p.n.score||0),0,7);c.fill()}}
g.onclick=e=>{const b=g.getBoundingClientRect(),x=e.clientX-b.left,y=e.clientY-b.top;const p=seen.find(p=>Math.hypot(p.x-x,p.y-y)<8);if(p){q.value=p.n.id;show()}};
function show(){t.textContent='';const v=q.value.toLowerCase();const r=d.nodes.filter(x=>x.id.toLowerCase().includes(v));document.getElementById('n').textContent=r.length+' of '+d.nodes.length+' nodes, '+d.links.length+' edges';draw(r.slice(0,300));for(const x of r.slice(0,500)){const e=t.insertRow();for(const y of [x.id,x.kind,(x.score||0).toFixed(3),x.in_degree,x.out_degree,x.community_id])e.insertCell().textContent=y}}q.oninput=show;show()</script></body></html>"""


def html(project: str, nodes: DataFrame, edges: DataFrame, metrics: DataFrame) -> Iterable[str]:
    """One page that stands alone, line by line: the data as JSON, a graph view and a table with a filter."""
    full = nodes.drop("in_cycle").join(metrics, ["project", "id"], "left")
    node = F.to_json(F.struct("id", "kind", "file_path", "is_local", "score", "in_degree", "out_degree", "community_id", "hotspot_type"))
    link = F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "confidence"))
    yield _HEAD.format(title=project.replace("&", "&amp;").replace("<", "&lt;")) + '{"nodes":['
    yield from _array(full, script_safe(node), F.desc("score"), "id")
    yield '],"links":['
    yield from _array(edges, script_safe(link), "src", "dst", "kind")
    yield "]}" + _TAIL


def _with_scores(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    return nodes.drop("in_cycle").join(metrics.select("project", "id", F.col("score").cast("double").alias("score"), F.col("community_id").cast("long").alias("community_id")), ["project", "id"], "left").na.fill(0)


def cypher_node_lines(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    e = lambda c: cypher_escape(F.col(c))
    line = F.format_string("CREATE (:%s {id: '%s', file: '%s', language: '%s', score: %.6f, community: %d});", "kind", e("id"), e("file_path"), "language", "score", "community_id")
    return _with_scores(nodes, metrics).select("project", line.alias("line"), F.col("id").alias("by_1"))


def cypher_edge_lines(edges: DataFrame) -> DataFrame:
    e = lambda c: cypher_escape(F.col(c))
    return _by_edge(edges, F.format_string("MATCH (a {id: '%s'}), (b {id: '%s'}) CREATE (a)-[:%s {weight: %d, confidence: %.2f, confidence_kind: '%s'}]->(b);", e("src"), e("dst"), F.upper("kind"), "weight", "confidence", "confidence_kind"))


def cypher(nodes: DataFrame, edges: DataFrame, metrics: DataFrame) -> Iterable[str]:
    yield from _ordered(cypher_node_lines(nodes, metrics))
    yield from _ordered(cypher_edge_lines(edges))


def graphml_node_lines(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    x = lambda c: xml_escape(F.col(c))
    line = F.format_string('    <node id="%s"><data key="kind">%s</data><data key="file_path">%s</data><data key="score">%.6f</data><data key="community">%d</data></node>', x("id"), x("kind"), x("file_path"), "score", "community_id")
    return _with_scores(nodes, metrics).select("project", line.alias("line"), F.col("id").alias("by_1"))


def graphml_edge_lines(edges: DataFrame) -> DataFrame:
    """What follows an edge's number."""
    x = lambda c: xml_escape(F.col(c))
    return _by_edge(edges, F.format_string('source="%s" target="%s"><data key="edge_kind">%s</data><data key="weight">%d</data><data key="confidence">%.2f</data></edge>', x("src"), x("dst"), x("kind"), "weight", "confidence"))


def graphml(nodes: DataFrame, edges: DataFrame, metrics: DataFrame) -> Iterable[str]:
    """Edges are numbered e0, e1, ... in the order they are written."""
    keys = [("kind", "node", "string"), ("file_path", "node", "string"), ("score", "node", "double"), ("community", "node", "int"), ("edge_kind", "edge", "string"), ("weight", "edge", "int"), ("confidence", "edge", "double")]
    yield '<?xml version="1.0" encoding="UTF-8"?>'
    yield '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
    for name, where, kind in keys:
        yield f'  <key id="{name}" for="{where}" attr.name="{name}" attr.type="{kind}"/>'
    yield '  <graph id="G" edgedefault="directed">'
    yield from _ordered(graphml_node_lines(nodes, metrics))
    for k, line in enumerate(_ordered(graphml_edge_lines(edges))):
        yield f'    <edge id="e{k}" {line}'
    yield from ("  </graph>", "</graphml>")


def vault_notes(nodes: DataFrame, edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """(project, name, text): a note a node with its links."""
    out = edges.groupBy("project", F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct(wikilink_target(F.col("dst")).alias("t"), "kind"))).alias("uses"))
    into = edges.groupBy("project", F.col("dst").alias("id")).agg(F.array_sort(F.collect_set(F.struct(wikilink_target(F.col("src")).alias("t"), "kind"))).alias("used"))
    full = _with_scores(nodes, metrics).join(out, ["project", "id"], "left").join(into, ["project", "id"], "left")
    links = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<struct<t:string,kind:string>>")), lambda e: F.concat(F.lit("- [["), e["t"], F.lit("]] ("), e["kind"], F.lit(")"))), "\n")
    note = F.concat(F.format_string("# %s\n\nkind: %s\nfile: %s\nscore: %.3f\ncommunity: %d\n\n## Uses\n\n", "id", "kind", "file_path", "score", "community_id"), links("uses"), F.lit("\n\n## Used by\n\n"), links("used"))
    return full.select("project", wikilink_target(F.col("id")).alias("name"), note.alias("text"))


def obsidian(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, communities: DataFrame) -> Iterable[tuple[str, Iterable[str]]]:
    """(file name, lines) of a vault: a note a node with its links, an index and an overview; nothing is held back."""
    notes = vault_notes(nodes, edges, metrics)
    for row in notes.orderBy("name").toLocalIterator():
        yield f"{row['name']}.md", [row["text"]]
    index = lines_of(notes, F.concat(F.lit("- [["), "name", F.lit("]]")), "name")
    yield "_index.md", chain(["# Index", ""], index)
    top = lines_of(metrics.orderBy(F.desc("score"), "id").limit(20), F.format_string("- [[%s]] %.3f", wikilink_target(F.col("id")), "score"), F.desc("score"), "id")
    groups = lines_of(communities, F.format_string("- %d: %d nodes, cohesion %.2f", "community_id", F.size("members"), "cohesion"), "community_id")
    yield "00-architecture-overview.md", chain(["# Overview", "", "## Hotspots", ""], top, ["", "## Communities", ""], groups)


def write_all(folder: str, project: str, tables: dict[str, DataFrame], formats: Iterable[str], allowlisted: list[str] | None = None) -> list[str]:
    """Write the chosen formats of one project (tables: nodes, edges, metrics, communities, cycles)."""
    t, out = tables, []
    at = lambda name: os.path.join(folder, name)
    for kind in formats:
        if kind == "json":
            out += [write_lines(graph_json(t["nodes"], t["edges"]), at("graph.json")), write_lines(analysis_json(t["metrics"], t["edges"], t["communities"], t["cycles"], allowlisted), at("analysis.json"))]
        elif kind == "csv":
            out += [write_lines(nodes_csv(t["nodes"], t["metrics"]), at("graph_nodes.csv")), write_lines(edges_csv(t["edges"]), at("graph_edges.csv"))]
        elif kind == "md":
            out.append(write_lines(markdown(project, *[t[k] for k in ("nodes", "edges", "metrics", "communities", "cycles")]), at("architecture_report.md")))
        elif kind == "html":
            out.append(write_lines(html(project, t["nodes"], t["edges"], t["metrics"]), at("architecture_graph.html")))
        elif kind == "neo4j":
            out.append(write_lines(cypher(t["nodes"], t["edges"], t["metrics"]), at("graph.cypher")))
        elif kind == "graphml":
            out.append(write_lines(graphml(t["nodes"], t["edges"], t["metrics"]), at("graph.graphml")))
        elif kind == "obsidian":
            out += [write_lines(lines, at(f"obsidian_vault/{name}")) for name, lines in obsidian(t["nodes"], t["edges"], t["metrics"], t["communities"])]
        else:
            raise ValueError(f"unknown format {kind!r}")
    return out


def prune(root: str, projects: Iterable[str]) -> list[str]:
    """Remove report folders of projects that are gone: only those made of known artifacts alone."""
    keep, out = set(projects), []
    for name in sorted(os.listdir(root)) if os.path.isdir(root) else []:
        path = os.path.join(root, name)
        if os.path.isdir(path) and name not in keep and (inside := os.listdir(path)) and set(inside) <= set(ARTIFACTS):
            shutil.rmtree(path)
            out.append(name)
    return out
