"""All graph queries over the driver's tables, with the SQL that gives the same rows.

The flow graph (plans.graphs) has two projects, `web` (imports) and `app` (defines and calls). Where a query needs
scores that SQL can compute, a node's score is 0.6 * normalised in-degree + 0.4 * normalised out-degree, and its
community is the number in the second segment of its id. Doubles are rounded to six places, arrays are joined.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions import text
from depweave.operators import communities, contracts, cycles, drift, history, metrics, model, policy, query, smells
from depweave.plans import graphs
from depweave.plans.staging import shared_folder, stage
from depweave.streaming import watch

NODE = "app.m1.x0.u1"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_FLOW = graphs.FLOW_RAW.format(events="events")


def _edges_sql(raw: str, name: str) -> str:
    """CTEs that merge a raw table into `name`."""
    return f"""{name}_o as (select *, row_number() over (partition by project, src, dst, kind order by confidence desc, seq) rn from {raw}),
{name} as (select project, src, dst, kind, count(*) weight, arg_min(line, seq) line, max(confidence) confidence, min(case when rn = 1 then confidence_kind end) confidence_kind
  from {name}_o group by project, src, dst, kind)"""


def _metrics_sql(edges: str, name: str) -> str:
    """CTEs with the nodes, degrees and scores of an edge table: <name>_n, <name>."""
    return f"""{name}_i as (select project, src id from {edges} union select project, dst from {edges}),
{name}_n as ({graphs.FLOW_NODES.format(ids=f"{name}_i")}),
{name}_d as (select i.project, i.id, (select count(*) from {edges} e where e.project = i.project and e.dst = i.id) in_degree,
  (select count(*) from {edges} e where e.project = i.project and e.src = i.id) out_degree from {name}_i i),
{name}_w as (select *, min(in_degree) over w a0, max(in_degree) over w a1, min(out_degree) over w b0, max(out_degree) over w b1 from {name}_d window w as (partition by project)),
{name} as (select project, id, in_degree, out_degree, cast(substr(split_part(id, '.', 2), 2) as bigint) community_id,
  case when a1 > a0 then (in_degree - a0) * 1.0e0 / (a1 - a0) else 0 end norm_in, case when b1 > b0 then (out_degree - b0) * 1.0e0 / (b1 - b0) else 0 end norm_out,
  0.6e0 * case when a1 > a0 then (in_degree - a0) * 1.0e0 / (a1 - a0) else 0 end + 0.4e0 * case when b1 > b0 then (out_degree - b0) * 1.0e0 / (b1 - b0) else 0 end score from {name}_w)"""


BASE = f"raw as ({_FLOW}), {_edges_sql('raw', 'e')}, {_metrics_sql('e', 'm')}"
PARTS = {"b": "cast(floor(seq / 10) as bigint) % 3 <> 0", "a": "cast(floor(seq / 10) as bigint) % 3 <> 1"}
DIFF = f"raw as ({_FLOW}), " + ", ".join(f"r{k} as (select * from raw where {test}), {_edges_sql(f'r{k}', f'e{k}')}, {_metrics_sql(f'e{k}', f'm{k}')}" for k, test in PARTS.items())
#: Reachability in the flow graph and the components it gives.
REACH = "rc(project, a, b) as (select project, src, dst from e where src <> dst union select rc.project, rc.a, e.dst from rc join e on e.project = rc.project and e.src = rc.b)"
SCC = f"{REACH}, sc as (select i.project, i.id, coalesce(min(x.b), i.id) scc_id from m_i i left join (select f.project, f.a, f.b from rc f join rc g on g.project = f.project and g.a = f.b and g.b = f.a union select project, id, id from m_i) x on x.project = i.project and x.a = i.id group by i.project, i.id)"


def case(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c: str):
    return F.round(c, 6).alias(c)


def flow_edges(spark: SparkSession, sf_dir: str, part: str | None = None) -> DataFrame:
    """Merged edges of the flow graph, or of its part before or after."""
    raw = graphs.flow_raw(spark, sf_dir)  # a projection of the events: reading it twice costs two scans and no shuffle
    return model.merge_edges(raw.filter(PARTS[part]) if part else raw)


def flow(spark: SparkSession, sf_dir: str, part: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and merged edges; the edges are staged, as the queries that want both read them several times."""
    edges = stage(flow_edges(spark, sf_dir, part), "flow")
    return graphs.flow_nodes(edges), edges


def scored(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    table = metrics.normalize(metrics.degrees(nodes, edges), ["in_degree", "out_degree"])
    return table.withColumn("score", 0.6 * F.col("norm_in_degree") + 0.4 * F.col("norm_out_degree")).withColumn("community_id", F.substring(text.segment(F.col("id"), 1), F.lit(2), F.lit(20)).cast("long"))


# --- structure ---------------------------------------------------------------------------------------------------


@case(f"with {BASE} select project, src, dst, kind, weight, line, confidence, confidence_kind from e")
def edge_merge(spark, sf_dir):
    return flow_edges(spark, sf_dir)


@case(f"with {BASE}, f as (select r.project, r.src id, r.kind, r.seq from raw r) select project, id, arg_min(kind, seq) kind, min(seq) line from f group by project, id")
def node_first_wins(spark, sf_dir):
    raw = graphs.flow_raw(spark, sf_dir)
    return model.merge_nodes(raw.select("project", F.col("src").alias("id"), "kind", "line", "seq")).select("project", "id", "kind", "line")


@case(f"with {BASE} select project, id, 'Module' kind, '' file_path, 'Go' as language, cast(0 as bigint) line, false is_local from m_n where not is_local")
def placeholder_nodes(spark, sf_dir):
    nodes, edges = flow(spark, sf_dir)
    return model.placeholder_nodes(nodes.filter("is_local"), edges, "Go").drop("alternative_paths")


@case(f"with {BASE} select project, src, dst, kind, weight, line, confidence, confidence_kind from e where confidence_kind <> 'ExpectedExternal'")
def scoring_view(spark, sf_dir):
    return model.scoring_view(flow_edges(spark, sf_dir))


@case(f"with {BASE} select project, id, in_degree, out_degree from m")
def degree(spark, sf_dir):
    return metrics.degrees(*flow(spark, sf_dir))


@case(f"""with recursive {BASE}, {SCC} select n.project, count(*) total_nodes, (select count(*) from e where e.project = n.project) total_edges, count(*) filter (n.is_local) local_nodes,
  count(distinct substr(split_part(n.id, '.', 2), 2)) communities, (select count(*) from (select scc_id from sc where sc.project = n.project group by scc_id having count(*) > 1)) cycles from m_n n group by n.project""")
def graph_stats(spark, sf_dir):
    nodes, edges = flow(spark, sf_dir)
    return query.stats(nodes, edges, scored(nodes, edges).select("project", "id", "community_id"), cycles.find_sccs(nodes, edges))


_KINDS = {"extracted": "Extracted", "inferred": "Inferred", "ambiguous": "Ambiguous", "expected_external": "ExpectedExternal"}


@case(f"""with {BASE} select project, {", ".join(f"count(*) filter (confidence_kind = '{v}') {k}_count, round(count(*) filter (confidence_kind = '{v}') * 100.0e0 / count(*), 6) {k}_pct" for k, v in _KINDS.items())},
  round(avg(confidence), 6) mean_confidence from e group by project""")
def confidence_summary(spark, sf_dir):
    out = history.confidence_summary(flow_edges(spark, sf_dir))
    return out.select("project", *[x for k in _KINDS for x in (f"{k}_count", r6(f"{k}_pct"))], r6("mean_confidence"))


@case(f"""with {BASE}, c as (select i.project, i.id, avg(e.confidence) c from m_i i left join e on e.project = i.project and e.dst = i.id group by i.project, i.id)
select project, id, round(c, 6) mean_confidence, case when c is null then '—' when round(c, 9) >= 0.9 then 'resolved' when round(c, 9) >= 0.5 then 'partial' else 'ambiguous' end label from c""")
def in_confidence_label(spark, sf_dir):
    nodes, edges = flow(spark, sf_dir)
    mean = edges.groupBy("project", F.col("dst").alias("id")).agg(F.avg("confidence").alias("c"))
    out = nodes.select("project", "id").join(mean, ["project", "id"], "left")
    return out.select("project", "id", F.round("c", 6).alias("mean_confidence"), text.confidence_label(F.round("c", 9)).alias("label"))


@case(f"""with {BASE}, s(project, prefix) as (values ('web', 'app.m1'), ('web', 'app.m2.x1'), ('app', 'app.m')),
x as (select e.*, split_part(e.dst, '.', 2) <> 'm3' is_local, exists (select 1 from s where s.project = e.project and (e.dst = s.prefix or starts_with(e.dst, s.prefix || '.'))) expected from e)
select project, src, dst, kind, case when kind = 'Defines' then confidence when is_local then least(confidence, 0.8e0) else least(confidence, 0.5e0) end confidence,
  case when kind = 'Defines' then confidence_kind when not is_local and expected then 'ExpectedExternal' when not is_local then 'Ambiguous' when src like '%u1' then 'Inferred' else confidence_kind end confidence_kind from x""")
def confidence_pipeline(spark, sf_dir):
    edges = flow_edges(spark, sf_dir)
    raw = edges.withColumn("is_local", text.segment(F.col("dst"), 1) != "m3").withColumn("resolver_confidence", F.lit(0.8)).withColumn("raw_dst", F.when(F.col("src").endswith("u1"), F.lit("?")).otherwise(F.col("dst")))
    stubs = spark.createDataFrame([("web", "app.m1"), ("web", "app.m2.x1"), ("app", "app.m")], "project string, prefix string")
    return model.resolved_confidence(raw, stubs).select("project", "src", "dst", "kind", "confidence", "confidence_kind")


@case(f"with {BASE} select project, src, dst, kind, weight, line, confidence, confidence_kind from e")
def stream_rebuild(spark, sf_dir):
    """The edges after all event files came in as a stream: the same rows as one merge."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    records = lambda events: events.sparkSession.sql(graphs.FLOW_RAW, events=events)
    return watch.rebuild_edges(spark, f"{sf_dir}/events.parquet", "event_id long, ts timestamp, user_id long, event_type string", records, f"{folder}/state", f"{folder}/checkpoint")


# --- predicates and names ----------------------------------------------------------------------------------------


@case(f"with {BASE} select n.project, n.id, n.kind, round(m.score, 6) score, m.in_degree from m_n n join m on m.project = n.project and m.id = n.id where regexp_matches(n.id, '^app[.]m.[.]x1[.].*$') and n.is_local and n.kind = 'Function'")
def search_glob(spark, sf_dir):
    nodes, edges = flow(spark, sf_dir)
    found = query.search(nodes, scored(nodes, edges), "app.m?.x1.*", kind="Function", local_only=True)
    return found.select("project", "id", "kind", r6("score"), "in_degree")


@case(f"with {BASE} select distinct id from m_i where contains(lower(id), 'x1.u1') order by id limit 3")
def suggest_ids(spark, sf_dir):
    return query.suggest(flow(spark, sf_dir)[0], "X1.U1")


@case(f"with {BASE} select split_part(id, '.', -1) leaf, split_part(id, '.', 1) top, split_part(id, '.', 3) third, count(*) n from m_i group by 1, 2, 3")
def leaf_symbols(spark, sf_dir):
    nodes, _ = flow(spark, sf_dir)
    keys = [text.leaf_symbol(F.col("id")).alias("leaf"), text.top_segment(F.col("id")).alias("top"), text.segment(F.col("id"), 2).alias("third")]
    return nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@case(f"with {BASE} select project, id, regexp_matches(split_part(id, '.', -1), '^u1.*$') or regexp_matches(split_part(id, '.', -1), '^u2[0-4]$') allowed from m_i")
def allowlist(spark, sf_dir):
    return flow(spark, sf_dir)[0].select("project", "id", text.allowlisted(F.col("id"), ["u1.*", "u2[0-4]"]).alias("allowed"))


_STUBS = [("app.m1", 1), ("app.m2.x1", 2), ("app.m2", 3), ("app.m", 4), ("app.m4.x2.u3", 5)]
_STUB_SQL = f"s(prefix, n) as (values {', '.join(f'({p!r}, {n})' for p, n in _STUBS)}), h as (select distinct i.id, s.prefix from m_i i join s on i.id = s.prefix or starts_with(i.id, s.prefix || '.') or starts_with(i.id, s.prefix || '/') or starts_with(i.id, s.prefix || '::'))"


@case(f"with {BASE}, {_STUB_SQL} select id, prefix from h")
def stub_match(spark, sf_dir):
    stubs = spark.createDataFrame(_STUBS, "prefix string, n int")
    ids = flow(spark, sf_dir)[0].select("id").distinct()
    return ids.withColumn("prefix", F.explode(text.stub_candidates(F.col("id")))).join(stubs, "prefix").select("id", "prefix")


@case(f"with {BASE}, {_STUB_SQL} select id, arg_max(prefix, length(prefix)) prefix from h group by id")
def stub_longest(spark, sf_dir):
    stubs = spark.createDataFrame(_STUBS, "prefix string, n int")
    ids = flow(spark, sf_dir)[0].select("id").distinct()
    hits = ids.withColumn("prefix", F.explode(text.stub_candidates(F.col("id")))).join(stubs, "prefix")
    return hits.groupBy("id").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


# --- scores ------------------------------------------------------------------------------------------------------


@case(f"with {BASE} select project, id, round(norm_in, 6) norm_in_degree, round(norm_out, 6) norm_out_degree from m")
def normalize_score(spark, sf_dir):
    return scored(*flow(spark, sf_dir)).select("project", "id", r6("norm_in_degree"), r6("norm_out_degree"))


@case(f"""with {BASE}, x as (select *, in_degree > 6 hub, out_degree * 100.0e0 / greatest(in_degree, 1) > 150 bridge from m)
select project, id, case when hub and not bridge then 'hub' when bridge and not hub then 'bridge' else 'mixed' end hotspot_type from x""")
def classify_hotspot(spark, sf_dir):
    table = metrics.degrees(*flow(spark, sf_dir))
    kind = metrics.classify(F.col("in_degree"), F.col("out_degree") * 100.0, metrics.Thresholds(6, 150.0))
    return table.select("project", "id", kind.alias("hotspot_type"))


@case(f"with {BASE} select project, id, in_degree, out_degree, round(score, 6) score from m order by m.score desc, id, project limit 20")
def top_hotspots(spark, sf_dir):
    out = scored(*flow(spark, sf_dir)).orderBy(F.desc("score"), "id", "project").limit(20)
    return out.select("project", "id", "in_degree", "out_degree", r6("score"))


@case(f"with {BASE}, k as (select *, row_number() over (partition by project order by score desc, id) rank from m) select project, cast(rank as int) rank, id, round(score, 6) score from k where rank <= 5")
def ranked_hotspots(spark, sf_dir):
    return metrics.ranked_hotspots(scored(*flow(spark, sf_dir)), 5).select("project", "rank", "id", r6("score"))


def _pagerank_sql(edges: str, nodes: str, rounds: int, name: str) -> str:
    """CTEs for the PageRank of an edge table after some rounds: <name>."""
    return f"""{name}_n as (select project, id from {nodes}), {name}_o as (select project, src, count(*) k from {edges} group by 1, 2), {name}_c as (select project, count(*)::double n from {name}_n group by 1),
{name}_r(it, project, id, r) as (select 0, i.project, i.id, 1.0 / c.n from {name}_n i join {name}_c c on c.project = i.project union all
  (with last as (select * from {name}_r where it < {rounds}), idle as (select l.project, sum(case when o.k is null then l.r else 0 end) d from last l left join {name}_o o on o.project = l.project and o.src = l.id group by 1),
    given as (select l.project, g.dst, sum(l.r / o.k) s from last l join {name}_o o on o.project = l.project and o.src = l.id join {edges} g on g.project = l.project and g.src = l.id group by 1, 2)
  select l.it + 1, l.project, l.id, 0.15 / c.n + 0.85 * (coalesce(x.s, 0) + idle.d / c.n) from last l join {name}_c c on c.project = l.project join idle on idle.project = l.project left join given x on x.project = l.project and x.dst = l.id)),
{name} as (select project, id, r from {name}_r where it = {rounds})"""


def _betweenness_sql(edges: str, name: str) -> str:
    """CTEs for the exact betweenness of an edge table: <name>. Parallel edges are paths of their own."""
    return f"""{name}_l as (select project, src, dst, count(*) m from {edges} group by 1, 2, 3), {name}_v as (select project, src id from {name}_l union select project, dst from {name}_l),
{name}_w(project, s, id, d) as (select project, id, id, 0 from {name}_v union select w.project, w.s, l.dst, w.d + 1 from {name}_w w join {name}_l l on l.project = w.project and l.src = w.id where w.d < 16),
{name}_d as (select project, s, id, min(d) d from {name}_w group by 1, 2, 3),
{name}_g(project, s, id, d, sigma) as (select project, id, id, 0, 1.0::double from {name}_v union all select g.project, g.s, l.dst, any_value(g.d) + 1, sum(g.sigma * l.m) from {name}_g g join {name}_l l on l.project = g.project and l.src = g.id
  join {name}_d d on d.project = g.project and d.s = g.s and d.id = l.dst and d.d = g.d + 1 group by g.project, g.s, l.dst),
{name}_p as (select a.project, a.id, sum(a.sigma * b.sigma / c.sigma) b from {name}_g a join {name}_g b on b.project = a.project and b.s = a.id join {name}_g c on c.project = a.project and c.s = a.s and c.id = b.id and c.d = a.d + b.d
  where a.s <> a.id and b.id <> a.id and b.id <> a.s group by 1, 2),
{name} as (select v.project, v.id, coalesce(p.b, 0) b from {name}_v v left join {name}_p p on p.project = v.project and p.id = v.id)"""


@case(f"with recursive {BASE}, {_pagerank_sql('e', 'm_n', 20, 'pr')} select project, id, round(r, 9) pagerank from pr")
def pagerank_20(spark, sf_dir):
    out = metrics.pagerank(*flow(spark, sf_dir), rounds=20, tolerance=0.0)
    return out.select("project", "id", F.round("pagerank", 9).alias("pagerank"))


@case(f"with recursive {BASE}, {_betweenness_sql('e', 'bc')} select project, id, round(b, 6) betweenness from bc")
def betweenness(spark, sf_dir):
    """Over all sources and ways of any length; the SQL follows ways of at most 16 edges, so it fits up to there."""
    return metrics.betweenness(*flow(spark, sf_dir)).select("project", "id", r6("betweenness"))


@case(f"""with recursive {BASE}, sv as (select * from e where confidence_kind <> 'ExpectedExternal'), rc(project, a, b) as (select project, src, dst from sv where src <> dst union select rc.project, rc.a, s.dst from rc join sv s on s.project = rc.project and s.src = rc.b),
cy as (select distinct f.project, f.a id from rc f join rc g on g.project = f.project and g.a = f.b and g.b = f.a where f.a <> f.b), {_pagerank_sql('sv', 'm_n', 20, 'pr')}, {_betweenness_sql('sv', 'bc')},
z as (select n.project, n.id, coalesce(bc.b, 0) b, coalesce(pr.r, 0) r, (select count(*) from sv s where s.project = n.project and s.dst = n.id) i, (select count(*) from sv s where s.project = n.project and s.src = n.id) o, cy.id is not null c
  from m_n n left join bc on bc.project = n.project and bc.id = n.id left join pr on pr.project = n.project and pr.id = n.id left join cy on cy.project = n.project and cy.id = n.id),
y as (select *, min(b) over w b0, max(b) over w b1, min(r) over w r0, max(r) over w r1, min(i) over w i0, max(i) over w i1 from z window w as (partition by project))
select project, id, round(b, 6) betweenness, round(r, 9) pagerank, i in_degree, o out_degree, c in_cycle,
  round(0.4e0 * case when b1 > b0 then (b - b0) / (b1 - b0) else 0 end + 0.2e0 * case when r1 > r0 then (r - r0) / (r1 - r0) else 0 end + 0.2e0 * case when i1 > i0 then (i - i0) * 1.0e0 / (i1 - i0) else 0 end + case when c then 0.2e0 else 0 end, 6) score,
  case when i > 50 and not b / greatest(i, 1) > 3000 then 'hub' when b / greatest(i, 1) > 3000 and not i > 50 then 'bridge' else 'mixed' end hotspot_type from y""")
def full_metrics(spark, sf_dir):
    """All node metrics, PageRank after 20 rounds. The SQL's betweenness follows ways of at most 16 edges, so it fits up to there."""
    nodes, edges = flow(spark, sf_dir)
    out = metrics.compute_metrics(nodes, edges, rounds=20, tolerance=0.0)
    return out.select("project", "id", r6("betweenness"), F.round("pagerank", 9).alias("pagerank"), "in_degree", "out_degree", "in_cycle", r6("score"), "hotspot_type")


# --- neighbours and paths ----------------------------------------------------------------------------------------


@case(f"with {BASE} select project, src id, kind, confidence, confidence_kind from e where dst = '{NODE}'")
def dependents(spark, sf_dir):
    return query.dependents(flow_edges(spark, sf_dir), NODE)


@case(f"with {BASE} select project, dst id, kind, confidence, confidence_kind from e where src = '{NODE}'")
def dependencies(spark, sf_dir):
    return query.dependencies(flow_edges(spark, sf_dir), NODE)


@case(f"with recursive {BASE}, t(project, id, depth) as (select distinct project, '{NODE}', 0 from e where dst = '{NODE}' union select t.project, e.src, t.depth + 1 from t join e on e.project = t.project and e.dst = t.id where t.depth < 4) select project, id, cast(min(depth) as bigint) depth from t where id <> '{NODE}' group by project, id")
def transitive_dependents_d4(spark, sf_dir):
    return query.transitive_dependents(flow_edges(spark, sf_dir), NODE, 4)


_DAG = """g as (select 'r' || n_regionkey src, 'n' || n_nationkey dst from nation union all select 'n' || s_nationkey, 's' || s_suppkey from supplier union all select distinct 's' || l_suppkey, 'p' || l_partkey from lineitem)"""


@case(f"with recursive {_DAG}, t(start, id, depth) as (select 'r' || r_regionkey, 'r' || r_regionkey, 0 from region union select t.start, g.dst, t.depth + 1 from t join g on g.src = t.id) select start, cast(min_depth as bigint) depth, count(*) n from (select start, id, min(depth) min_depth from t group by 1, 2) group by 1, 2")
def bfs_levels(spark, sf_dir):
    """Hops from every region through nations and suppliers to parts, counted by level."""
    edges = graphs.dag_edges(spark, sf_dir)
    starts = graphs.read(spark, sf_dir, "region").select(F.lit("parts").alias("project"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return query.reach(edges, starts, 10).groupBy("start", "depth").agg(F.count(F.lit(1)).alias("n"))


def _orders_sql(edges: str) -> str:
    return f"g as (select project, lpad(cast(src as varchar), 9, '0') src, lpad(cast(dst as varchar), 9, '0') dst from ({edges.format(orders='orders')}))"


_ORDERS = _orders_sql(graphs.SCC_EDGES)
_AT = "lpad('{}', 9, '0')".format


@case(f"with recursive {_ORDERS}, t(id, depth) as (select {_AT(0)}, 0 union select g.dst, t.depth + 1 from t join g on g.project = 'p0' and g.src = t.id where t.depth < 40), u as (select id, cast(min(depth) as bigint) hops from t group by id) select id, hops from u where hops < 40")
def shortest_hops(spark, sf_dir):
    edges = graphs.scc_edges(spark, sf_dir)
    starts = spark.createDataFrame([("p0", "0" * 9)], "project string, id string")
    return query.reach(edges, starts, 39).select("id", F.col("depth").alias("hops"))


@case(f"""with recursive {_ORDERS}, p(nodes) as (select [src, dst] from g where src = {_AT(31)} union all select list_append(p.nodes, g.dst) from p join g on g.src = p.nodes[-1]
  where len(p.nodes) <= 4 and p.nodes[-1] <> {_AT(1)} and (not list_contains(p.nodes, g.dst) or g.dst = {_AT(1)})) select array_to_string(nodes, '>') path from p where nodes[-1] = {_AT(1)}""")
def all_paths_d4(spark, sf_dir):
    out = query.all_paths(graphs.scc_edges(spark, sf_dir), "31".zfill(9), "1".zfill(9), depth=4, most=None)
    return out.select(F.array_join("nodes", ">").alias("path"))


# --- cycles ------------------------------------------------------------------------------------------------------

_SCC2 = "rc(a, b) as (select src, dst from gg union select rc.a, gg.dst from rc join gg on gg.src = rc.b), v as (select project, src id from gg union select project, dst from gg), sc as (select v.project, v.id, least(v.id, min(f.b)) scc_id from v join rc f on f.a = v.id join rc k on k.a = f.b and k.b = f.a group by v.project, v.id)"
_OUT = [1, 2, 7, 101]


@case(f"with recursive {_ORDERS}, gg as (select * from g), {_SCC2} select project, scc_id, string_agg(id, ',' order by id) nodes from sc group by project, scc_id having count(*) > 1")
def scc(spark, sf_dir):
    edges = graphs.scc_edges(spark, sf_dir)
    return cycles.find_sccs(graphs_nodes(edges), edges).select("project", "scc_id", F.array_join("nodes", ",").alias("nodes"))


@case(f"with recursive {_ORDERS}, gg as (select * from g where cast(src as int) not in (1, 2, 7, 101) and cast(dst as int) not in (1, 2, 7, 101)), {_SCC2} select project, scc_id, string_agg(id, ',' order by id) nodes from sc group by project, scc_id having count(*) > 1")
def scc_excluding(spark, sf_dir):
    edges = graphs.scc_edges(spark, sf_dir)
    return cycles.find_sccs(graphs_nodes(edges), edges, excluding=[str(x).zfill(9) for x in _OUT]).select("project", "scc_id", F.array_join("nodes", ",").alias("nodes"))


@case(f"with recursive {BASE}, {SCC}, z as (select project, scc_id, count(*) n from sc group by 1, 2) select sc.project, sc.id, z.n > 1 in_cycle from sc join z on z.project = sc.project and z.scc_id = sc.scc_id")
def in_cycle(spark, sf_dir):
    return cycles.in_cycle(*flow(spark, sf_dir))


_CYCLES3 = "c2 as (select a.src x, a.dst y from g a join g b on b.src = a.dst and b.dst = a.src where a.src < a.dst), c3 as (select a.src x, a.dst y, b.dst z from g a join g b on b.src = a.dst join g c on c.src = b.dst and c.dst = a.src where a.src < a.dst and a.src < b.dst and a.dst <> b.dst)"


@case(f"with {_ORDERS}, {_CYCLES3} select x || '>' || y path from c2 union all select x || '>' || y || '>' || z from c3")
def cycles_len3(spark, sf_dir):
    edges = graphs.scc_edges(spark, sf_dir)
    return cycles.bounded_cycles(graphs_nodes(edges), edges, 3).select(F.array_join("nodes", ">").alias("path"))


@case(f"""with recursive {_orders_sql(graphs.LAST_EDGES)}, w(project, nodes) as (select project, [src, dst] from g union all select w.project, list_append(w.nodes, g.dst) from w join g on g.src = w.nodes[-1] where w.nodes[-1] > w.nodes[1] and not list_contains(w.nodes[:-2], w.nodes[-1]))
select project, array_to_string(nodes[:-2], '>') path from w where nodes[-1] = nodes[1]""")
def simple_cycles_500(spark, sf_dir):
    """Cycles of any length, below the cap of 500 a project."""
    edges = graphs.scc_edges(spark, sf_dir, graphs.LAST_EDGES)
    return cycles.report_cycles(graphs_nodes(edges), edges).select("project", F.array_join("nodes", ">").alias("path"))


def graphs_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("project", F.explode(F.array("src", "dst")).alias("id")).distinct()


# --- communities -------------------------------------------------------------------------------------------------


@case(f"""with {BASE}, z as (select project, community_id, count(*) n from m group by 1, 2),
p as (select distinct e.project, least(src, dst) x, greatest(src, dst) y from e where src <> dst),
q as (select p.project, a.community_id, count(*) k from p join m a on a.project = p.project and a.id = p.x join m b on b.project = p.project and b.id = p.y where a.community_id = b.community_id group by 1, 2)
select z.project, z.community_id, z.n size, round(case when z.n <= 1 then 1 else coalesce(q.k, 0) / (z.n * (z.n - 1) / 2.0e0) end, 6) cohesion from z left join q on q.project = z.project and q.community_id = z.community_id""")
def cohesion_given_partition(spark, sf_dir):
    nodes, edges = flow(spark, sf_dir)
    out = communities.communities(scored(nodes, edges).select("project", "id", "community_id"), edges)
    return out.select("project", "community_id", F.size("members").cast("long").alias("size"), r6("cohesion"))


def _communities(spark, sf_dir, method):
    nodes, edges = flow(spark, sf_dir)
    out = communities.communities(communities.detect(nodes, edges, method), edges)
    return out.select("project", "community_id", F.array_join("members", ",").alias("members"), r6("cohesion"))


@case()
def community_louvain(spark, sf_dir):
    return _communities(spark, sf_dir, "modularity")


@case()
def label_propagation(spark, sf_dir):
    return _communities(spark, sf_dir, "labels")


# --- drift and history -------------------------------------------------------------------------------------------


def _halves(spark, sf_dir):
    out = []
    for part in ("b", "a"):
        nodes, edges = flow(spark, sf_dir, part)
        out.append((scored(nodes, edges), edges))
    return out


@case(f"with {DIFF} select coalesce(a.project, b.project) project, coalesce(a.id, b.id) id, case when b.id is null then 'added' else 'removed' end change from ma a full join mb b on b.project = a.project and b.id = a.id where a.id is null or b.id is null")
def diff_nodes(spark, sf_dir):
    (b, _), (a, _) = _halves(spark, sf_dir)
    return drift.node_changes(b, a)


@case(f"with {DIFF} select a.project, a.id, a.in_degree - b.in_degree in_degree, a.out_degree - b.out_degree out_degree from ma a join mb b on b.project = a.project and b.id = a.id where a.in_degree <> b.in_degree or a.out_degree <> b.out_degree")
def diff_degree(spark, sf_dir):
    (b, _), (a, _) = _halves(spark, sf_dir)
    return drift.degree_changes(b, a)


@case(f"""with {DIFF}, tb as (select * from (select *, row_number() over (partition by project order by score desc, id) r from mb) where r <= 20), ta as (select * from (select *, row_number() over (partition by project order by score desc, id) r from ma) where r <= 20),
s as (select coalesce(a.project, b.project) project, coalesce(a.id, b.id) id, b.score s0, a.score s1 from ma a full join mb b on b.project = a.project and b.id = a.id)
select project, id, case when s1 - s0 > 0 then 'rising' else 'falling' end bucket, round(s0, 6) as before, round(s1, 6) as after, round(s1 - s0, 6) delta from s where abs(s1 - s0) >= 0.05
union all select s.project, s.id, 'new', round(coalesce(s0, 0), 6), round(coalesce(s1, 0), 6), round(coalesce(s1, 0) - coalesce(s0, 0), 6) from s join ta on ta.project = s.project and ta.id = s.id where not exists (select 1 from tb where tb.project = s.project and tb.id = s.id)
union all select s.project, s.id, 'removed', round(coalesce(s0, 0), 6), round(coalesce(s1, 0), 6), round(coalesce(s1, 0) - coalesce(s0, 0), 6) from s join tb on tb.project = s.project and tb.id = s.id where not exists (select 1 from ta where ta.project = s.project and ta.id = s.id)""")
def diff_hotspots(spark, sf_dir):
    (b, _), (a, _) = _halves(spark, sf_dir)
    return drift.hotspot_changes(b, a).select("project", "id", "bucket", r6("before"), r6("after"), r6("delta"))


@case(f"""with {DIFF}, x(k, project, p) as (select 'b', s.project, s.src || '>' || s.dst from eb s join eb t on t.project = s.project and t.src = s.dst and t.dst = s.src where s.src < s.dst
  union select 'a', s.project, s.src || '>' || s.dst from ea s join ea t on t.project = s.project and t.src = s.dst and t.dst = s.src where s.src < s.dst)
select project, p path, case when min(k) = 'a' then 'introduced' else 'resolved' end change from x group by project, p having count(*) = 1""")
def diff_cycles(spark, sf_dir):
    found = []
    for table, edges in _halves(spark, sf_dir):
        found.append(cycles.bounded_cycles(table, edges, 2))
    out = drift.cycle_changes(*found)
    return out.select("project", F.array_join("nodes", ">").alias("path"), "change")


@case(f"""with {DIFF}, cb as (select project, id, community_id % 3 c from mb), ca as (select project, id, (community_id + in_degree) % 3 c from ma),
o as (select a.project, a.c ac, b.c bc, count(*) n from ca a join cb b on b.project = a.project and b.id = a.id group by 1, 2, 3),
q as (select project, ac, bc, row_number() over (partition by project, ac order by n desc, (bc <> ac)::int, bc) r from o)
select a.project, a.id, b.c from_community, a.c to_community, q.bc <> b.c moved from ca a join cb b on b.project = a.project and b.id = a.id join q on q.project = a.project and q.ac = a.c and q.r = 1""")
def diff_communities(spark, sf_dir):
    (b, _), (a, _) = _halves(spark, sf_dir)
    old = b.select("project", "id", (F.col("community_id") % 3).alias("community_id"))
    new = a.select("project", "id", ((F.col("community_id") + F.col("in_degree")) % 3).alias("community_id"))
    return drift.community_moves(old, new, old, new)


@case(f"""with {DIFF}, c as (select 'b' k, project, 'nodes' what, count(*) n from mb group by project union all select 'a', project, 'nodes', count(*) from ma group by project union all select 'b', project, 'edges', count(*) from eb group by project
  union all select 'a', project, 'edges', count(*) from ea group by project union all select 'b', project, 'communities', count(distinct community_id) from mb group by project union all select 'a', project, 'communities', count(distinct community_id) from ma group by project
  union all select 'b', project, 'cycles', 0 from mb group by project)
select project, what, cast(sum(case k when 'b' then n else 0 end) as bigint) as before, cast(sum(case k when 'a' then n else 0 end) as bigint) as after, cast(sum(case k when 'a' then n else -n end) as bigint) change from c group by project, what""")
def diff_summary(spark, sf_dir):
    none = spark.createDataFrame([], "project string, nodes array<string>")
    (b, eb), (a, ea) = _halves(spark, sf_dir)
    return drift.summary_delta(drift.Snapshot(b, eb, b, none), drift.Snapshot(a, ea, a, none))


#: A snapshot for each day of events; the capture time is the day in nanoseconds.
_DAYS = f"""raw as ({_FLOW}), de as (select distinct project, dt, src, dst, kind from raw), di as (select project, dt, src id from de union select project, dt, dst from de),
dn as (select i.project, i.dt, i.id, (select count(*) from de where de.project = i.project and de.dt = i.dt and de.dst = i.id) s from di i),
pt as (select project, cast(date_diff('day', date '1970-01-01', dt) as bigint) * 86400000000000 captured_at, count(*) total_nodes, (select count(*) from de where de.project = dn.project and de.dt = dn.dt) total_edges,
  count(distinct split_part(id, '.', 2)) total_communities, cast(0 as bigint) total_cycles, dt from dn group by project, dt),
st as (select project, captured_at to_captured_at, dt d1, lag(captured_at) over w from_captured_at, lag(dt) over w d0 from pt window w as (partition by project order by captured_at))"""


def _days(spark, sf_dir):
    """points and nodes of the daily snapshots."""
    raw = graphs.flow_raw(spark, sf_dir).withColumn("captured_at", F.datediff("dt", F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000_000)
    edges = raw.select("project", "captured_at", "src", "dst", "kind").distinct()
    keys = ["project", "captured_at"]
    ends = edges.select(*keys, F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i")))).alias("e"))
    nodes = ends.groupBy(*keys, F.col("e.id").alias("id")).agg(F.sum("e.i").alias("in_degree")).withColumn("score", F.col("in_degree").cast("double")).withColumn("community_id", F.substring(text.segment(F.col("id"), 1), F.lit(2), F.lit(20)).cast("long"))
    points = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_nodes"), F.countDistinct("community_id").alias("total_communities")).join(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_edges")), keys).withColumn("total_cycles", F.lit(0).cast("long"))
    return points, nodes


@case(f"with {_DAYS}, k as (select *, row_number() over (partition by project order by captured_at desc) r from pt) select project, captured_at, total_nodes, total_edges, total_communities, total_cycles from k where r <= 10")
def trend_points(spark, sf_dir):
    points, _ = _days(spark, sf_dir)
    return history.latest(points, 10).select("project", "captured_at", *history.COUNTS)


@case(f"""with {_DAYS} select st.project, from_captured_at, to_captured_at, {", ".join(f"b.{c} before_{c}, a.{c} after_{c}, a.{c} - b.{c} change_{c}" for c in history.COUNTS)}
from st join pt b on b.project = st.project and b.captured_at = st.from_captured_at join pt a on a.project = st.project and a.captured_at = st.to_captured_at""")
def trend_intervals(spark, sf_dir):
    return history.intervals(_days(spark, sf_dir)[0])


@case(f"""with {_DAYS}, top as (select * from (select *, row_number() over (partition by project, dt order by s desc, id) r from dn) where r <= 5),
o as (select st.project, st.from_captured_at, st.to_captured_at, top.id, top.s::double s from st join top on top.project = st.project and top.dt = st.d0), n as (select st.project, st.from_captured_at, st.to_captured_at, top.id, top.s::double s from st join top on top.project = st.project and top.dt = st.d1 where st.d0 is not null)
select coalesce(o.project, n.project) project, coalesce(o.from_captured_at, n.from_captured_at) from_captured_at, coalesce(o.to_captured_at, n.to_captured_at) to_captured_at, coalesce(o.id, n.id) id,
  case when o.s is null then 'new' when n.s is null then 'removed' when n.s > o.s then 'rising' else 'falling' end bucket, o.s as before, n.s as after
from o full join n on n.project = o.project and n.to_captured_at = o.to_captured_at and n.id = o.id where o.s is distinct from n.s""")
def trend_hotspots(spark, sf_dir):
    points, nodes = _days(spark, sf_dir)
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("project", "captured_at").orderBy(F.desc("score"), "id"))
    return history.hotspot_deltas(points, nodes.withColumn("r", rank).filter("r <= 5").drop("r"))


@case(f"""with {_DAYS}, c as (select project, dt, id, cast(substr(split_part(id, '.', 2), 2) as bigint) % 3 + s % 2 c from dn),
j as (select st.project, st.from_captured_at, st.to_captured_at, o.id, o.c oc, n.c nc from st join c o on o.project = st.project and o.dt = st.d0 join c n on n.project = st.project and n.dt = st.d1 and n.id = o.id),
k as (select project, to_captured_at, nc, oc, row_number() over (partition by project, to_captured_at, nc order by count(*) desc, oc desc) r from j group by project, to_captured_at, nc, oc)
select j.project, from_captured_at, j.to_captured_at, count(*) filter (k.oc <> j.oc) moved_nodes, count(*) filter (k.oc = j.oc) stable_nodes, round(count(*) filter (k.oc <> j.oc) * 100.0e0 / count(*), 6) churn_pct
from j join k on k.project = j.project and k.to_captured_at = j.to_captured_at and k.nc = j.nc and k.r = 1 group by j.project, from_captured_at, j.to_captured_at""")
def churn(spark, sf_dir):
    points, nodes = _days(spark, sf_dir)
    nodes = nodes.withColumn("community_id", F.col("community_id") % 3 + F.col("in_degree") % 2)
    out = history.churn(points, nodes)
    return out.select("project", "from_captured_at", "to_captured_at", "moved_nodes", "stable_nodes", r6("churn_pct"))


# --- gates -------------------------------------------------------------------------------------------------------

GROUPS = [policy.Group("even", ("app.m0.*", "app.m2.*", "app.m4.*", "app.m6.*"), partition_by="segment:2"), policy.Group("odd", ("app.m1.*", "app.m3.*", "app.m5.*"), projects=("w*",), partition_by="segment:2")]
RULES = [
    policy.Rule("no-even-to-odd", ("group:even",), ("group:odd",), except_targets=("project:none*",)),
    policy.Rule("even-partition", ("group:even",), ("group:even", "project:app"), allow_same_partition=True),
    policy.Rule("cross", ("project:*",), ("project:app",), except_same_project=True),
]


@case(f"""with {BASE}, i as (select e.project, e.src, e.dst from e join m_n s on s.project = e.project and s.id = e.src and s.kind = 'Module' join m_n t on t.project = e.project and t.id = e.dst and t.kind = 'Module' where e.kind = 'Imports'),
ow as (select distinct id, project owner from m_n where is_local), x as (select i.*, coalesce(ow.owner, i.project) owner, cast(substr(split_part(src, '.', 2), 2) as int) % 2 = 0 se, cast(substr(split_part(dst, '.', 2), 2) as int) % 2 = 0 de from i left join ow on ow.id = i.dst)
select 'no-even-to-odd' as rule, src source_node, dst target_node, project source_project, owner target_project, 'group:even' source_selectors, 'group:odd' target_selectors from x where se and not de and owner = 'web'
union all select 'even-partition', src, dst, project, owner, 'group:even', concat_ws(',', case when de then 'group:even' end, case when owner = 'app' then 'project:app' end) from x where se and (de or owner = 'app') and not (de and split_part(src, '.', 3) = split_part(dst, '.', 3) and src <> dst)
union all select 'cross', src, dst, project, owner, 'project:*', 'project:app' from x where owner = 'app' and project <> owner""")
def policy_violations(spark, sf_dir):
    nodes, edges = flow(spark, sf_dir)
    out = policy.evaluate(nodes, edges, GROUPS, RULES)
    return out.withColumn("source_selectors", F.array_join("source_selectors", ",")).withColumn("target_selectors", F.array_join("target_selectors", ","))


@case(f"""with recursive {BASE}, {SCC}, z as (select project, count(*) n from (select project, scc_id from sc group by 1, 2 having count(*) > 1) group by project),
x as (select m.project, count(*) nodes, (select count(*) from e where e.project = m.project) edges, count(distinct community_id) communities, coalesce(any_value(z.n), 0) cycles, max(score) filter (not regexp_matches(split_part(id, '.', -1), '^u1.*$')) s,
  arg_min(id, (-score, id)) filter (not regexp_matches(split_part(id, '.', -1), '^u1.*$')) i from m left join z on z.project = m.project group by m.project)
select project, nodes, edges, communities, cycles, round(s, 6) max_hotspot_score, i max_hotspot_id, cycles > case project when 'web' then 5 else 0 end cycles_violated, s > 0.9e0 score_violated, not (cycles > case project when 'web' then 5 else 0 end or s > 0.9e0) ok from x""")
def quality_gates(spark, sf_dir):
    nodes, edges = flow(spark, sf_dir)
    table = scored(nodes, edges)
    out = policy.gates(table, edges, table, cycles.find_sccs(nodes, edges), policy.Limits(0, 0.9), {"web": policy.Limits(max_cycles=5)}, text.allowlisted(F.col("id"), ["u1.*"]))
    return out.select("project", "nodes", "edges", "communities", "cycles", r6("max_hotspot_score"), "max_hotspot_id", "cycles_violated", "score_violated", "ok")


_FIELDS = [
    ("user", "orm", "id", "number", False, 1), ("user", "orm", "full_name", "string", False, 2), ("user", "orm", "created_at", "date", True, 3), ("user", "orm", "secret", "string", False, 4), ("user", "orm", "mail", "string", False, 5), ("user", "orm", "tags", "!tsvector", False, 6), ("user", "orm", "any_thing", "unknown", True, 7),
    ("user", "ts", "id", "number", True, 1), ("user", "ts", "fullName", "number", False, 2), ("user", "ts", "createdAt", "date", True, 3), ("user", "ts", "email", "string", False, 4), ("user", "ts", "tags", "string", False, 5), ("user", "ts", "extra", "boolean", True, 6), ("user", "ts", "anyThing", "date", True, 7),
    ("post", "orm", "id", "number", True, 1), ("post", "ts", "id", "number", False, 2),
]
_RELATIONS = [("user", "orm", "posts", "many", 8), ("user", "orm", "boss", "one", 9), ("user", "ts", "posts", "one", 8), ("user", "ts", "team", "one", 9)]


def _literal(rows) -> str:
    return ", ".join("(" + ", ".join(str(v).lower() if isinstance(v, bool) else repr(v) for v in r) + ")" for r in rows)


@case(f"""with f(pair, side, raw, t, nullable, line) as (values {_literal(_FIELDS)}), r(pair, side, raw, card, line) as (values {_literal(_RELATIONS)}),
k as (select *, case when raw in ('mail', 'email') then 'email' when raw = 'full_name' then 'fullName' when raw = 'created_at' then 'createdAt' when raw = 'any_thing' then 'anyThing' else raw end key from f where not (side = 'orm' and raw = 'secret')),
j as (select coalesce(a.pair, b.pair) pair, coalesce(a.key, b.key) as name, a.t ot, b.t tt, a.nullable an, b.nullable bn, a.line al, b.line bl from (select * from k where side = 'orm') a full join (select * from k where side = 'ts') b on a.pair = b.pair and a.key = b.key),
q as (select coalesce(a.pair, b.pair) pair, coalesce(a.raw, b.raw) as name, a.card ac, b.card bc, a.line al, b.line bl from (select * from r where side = 'orm') a full join (select * from r where side = 'ts') b on a.pair = b.pair and a.raw = b.raw)
select pair, cast(al as bigint) line, 0 rank, 'FieldMissingOnTs' violation, name, 'error' severity from j where bl is null union all select pair, bl, 1, 'FieldMissingOnOrm', name, 'error' from j where al is null
union all select pair, al, 2, 'NullabilityMismatch', name, 'error' from j where an <> bn union all select pair, al, 3, 'TypeMismatch', name, 'error' from j where ot <> tt and ot not like '!%' and ot <> 'unknown' and tt <> 'unknown'
union all select pair, al, 4, 'UnmappedOrmType', name, 'warning' from j where ot like '!%' and bl is not null union all select pair, al, 5, 'RelationMissingOnTs', name, 'error' from q where bl is null
union all select pair, bl, 6, 'RelationMissingOnOrm', name, 'error' from q where al is null union all select pair, al, 7, 'CardinalityMismatch', name, 'error' from q where ac <> bc""")
def contract_compare(spark, sf_dir):
    kind = lambda t: f'{{"kind":"unmapped","value":"{t[1:]}"}}' if t[0] == "!" else f'{{"kind":"primitive","value":"{t}"}}'
    fields = spark.createDataFrame([(p, s, n, kind(t), null, line, line) for p, s, n, t, null, line in _FIELDS], "pair string, side string, raw_name string, type_json string, nullable boolean, line long, seq long")
    relations = spark.createDataFrame([(p, s, n, c, line, line) for p, s, n, c, line in _RELATIONS], "pair string, side string, raw_name string, cardinality string, line long, seq long")
    alias = "array<struct<orm:string,ts:string>>"
    config = spark.createDataFrame([("user", ["secret"], [], [("mail", "email")], []), ("post", [], [], [], [])], f"pair string, ignore_orm array<string>, ignore_ts array<string>, field_aliases {alias}, relation_aliases {alias}")
    return contracts.compare(fields, relations, config)


# --- reports -----------------------------------------------------------------------------------------------------


@case(f"""with {BASE}, h as (select *, row_number() over (partition by project order by score desc, id) <= 10 hot from m),
p as (select distinct a.project, a.src, a.dst from e a join e b on b.project = a.project and b.src = a.dst and b.dst = a.src where a.src <> a.dst),
x as (select e.*, s.community_id <> t.community_id across, p.src is not null looped, least(s.in_degree + s.out_degree, t.in_degree + t.out_degree) <= 2 and greatest(s.in_degree + s.out_degree, t.in_degree + t.out_degree) >= 5 hub, s.hot sh, t.hot th,
  case confidence_kind when 'Ambiguous' then 3 when 'Inferred' then 2 when 'Extracted' then 1 else 0 end bonus
  from e join h s on s.project = e.project and s.id = e.src join h t on t.project = e.project and t.id = e.dst left join p on p.project = e.project and p.src = e.src and p.dst = e.dst),
y as (select *, bonus + 2 * across::int + 2 * looped::int + hub::int + (sh or th)::int score from x)
select project, src, dst, kind, confidence, confidence_kind, score, concat_ws('; ', case when bonus > 0 then 'low-confidence (' || confidence_kind || ')' end, case when across then 'cross-community' end, case when looped then 'in-cycle' end,
  case when hub then 'peripheral→hub' end, case when sh or th then 'touches hotspot `' || case when th then dst else src end || '`' end) reasons from y where score >= 3""")
def smell_edges(spark, sf_dir):
    nodes, edges = flow(spark, sf_dir)
    out = smells.smells(edges, scored(nodes, edges), cycles.two_cycle_pairs(edges))
    return out.drop("drift_new").withColumn("reasons", F.array_join("reasons", "; "))


_LEAVES = "l as (select m.project, m.id, split_part(m.id, '.', -1) leaf_name, m.in_degree from m where not regexp_matches(split_part(m.id, '.', -1), '^u1.$'))"


@case(f"with {BASE}, {_LEAVES} select project, leaf_name, count(*) group_size, string_agg(id || ':' || in_degree, ',' order by in_degree desc, id) members from l group by project, leaf_name having count(*) >= 2")
def consolidation(spark, sf_dir):
    nodes, edges = flow(spark, sf_dir)
    out = smells.consolidation(scored(nodes, edges), nodes, 2, ["u1."])
    members = F.array_join(F.transform("members", lambda m: F.concat(m["id"], F.lit(":"), m["fan_in"].cast("string"))), ",")
    return out.select("project", "leaf_name", "group_size", members.alias("members"))


@case(f"with {BASE}, {_LEAVES} select leaf_name, count(distinct project) project_count, count(*) group_size, string_agg(project || '/' || id, ',' order by in_degree desc, project, id) members from l group by leaf_name having count(distinct project) >= 2 and count(*) >= 3")
def consolidation_cross(spark, sf_dir):
    nodes, edges = flow(spark, sf_dir)
    out = smells.consolidation(scored(nodes, edges), nodes, 3, ["u1."], across=True)
    members = F.array_join(F.transform("members", lambda m: F.concat(m["project"], F.lit("/"), m["id"])), ",")
    return out.select("leaf_name", "project_count", "group_size", members.alias("members"))


_LANGS = "case cast(substr(split_part(id, '.', 2), 2) as int) % 2 when 0 then 'Go' else 'Python' end"


@case(f"""with {BASE}, t as (select e.project, e.dst, e.weight, case when cast(substr(split_part(e.dst, '.', 2), 2) as int) % 2 = 0 then 'Go' else 'Rust' end lang from e join m_n n on n.project = e.project and n.id = e.dst where not n.is_local),
c as (select * from t where not (project = 'web' and (dst = 'app.m1' or starts_with(dst, 'app.m1.')))),
p as (select project, case when lang = 'Go' then split_part(dst, '.', 1) else dst end prefix, dst, weight, lang from c), q as (select project, prefix, sum(weight) w from p where prefix <> 'app' group by 1, 2 having sum(weight) >= 2),
g as (select q.prefix, sum(q.w) w, string_agg(q.project, ',' order by q.project) projects, count(*) k from q group by q.prefix)
select prefix, cast(w as bigint) edge_weight, projects, case when k >= 2 then 'settings' else projects end scope from g""")
def suggest_stubs(spark, sf_dir):
    nodes, edges = flow(spark, sf_dir)
    nodes = nodes.withColumn("language", F.when(F.substring(text.segment(F.col("id"), 1), F.lit(2), F.lit(9)).cast("int") % 2 == 0, "Go").otherwise("Rust"))
    stubs = spark.createDataFrame([("web", "app.m1")], "project string, prefix string")
    out, _ = smells.suggest_stubs(nodes, edges, stubs, min_edges=2)
    return out.select("prefix", "edge_weight", F.array_join("projects", ",").alias("projects"), "scope")


@case("""with l as (select distinct regexp_extract(url, '://([^/?#]+)', 1) host, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) href from pages)
select split_part(trim(href), '/', 1) prefix, count(*) links, count(distinct host) hosts from l group by 1""")
def page_link_prefixes(spark, sf_dir):
    links = graphs.page_edges(spark, sf_dir).withColumn("prefix", text.extract_prefix(F.col("dst"), F.lit("TypeScript")))
    return links.groupBy("prefix").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("src").alias("hosts"))


@case(f"""with {BASE}, o as (select distinct project to_project, id dst from m_n) select e.project from_project, o.to_project, count(*) edge_count, count(*) filter (kind = 'Imports') imports, count(*) filter (kind = 'Defines') defines, count(*) filter (kind = 'Calls') calls,
  count(distinct e.dst) shared_modules from e join o on o.dst = e.dst and o.to_project <> e.project group by 1, 2""")
def coupling(spark, sf_dir):
    return smells.coupling(*flow(spark, sf_dir))


@case(f"with {BASE} select id, string_agg(distinct project, ',' order by project) projects from m_i group by id having count(distinct project) > 1")
def shared_modules(spark, sf_dir):
    return smells.shared_modules(flow(spark, sf_dir)[0]).select("id", F.array_join("projects", ",").alias("projects"))


@case(f"""with {BASE}, x as (select project, count(*) nodes, (select count(*) from e where e.project = m.project) edges, count(distinct community_id) communities, cast(0 as bigint) cycles from m group by project)
select project, nodes, edges, communities, cycles from x union all select null, cast(sum(nodes) as bigint), cast(sum(edges) as bigint), cast(sum(communities) as bigint), cast(sum(cycles) as bigint) from x""")
def workspace_summary(spark, sf_dir):
    nodes, edges = flow(spark, sf_dir)
    return smells.workspace_summary(nodes, edges, scored(nodes, edges), spark.createDataFrame([], "project string, nodes array<string>"))
