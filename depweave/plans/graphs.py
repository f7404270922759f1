"""Graphs derived from the driver's tables. The SQL is shared with the oracles, word for word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Raw edge records, one for each event: from its user to another one whose number lies up to 30 above or below, by the
#: event's number. Every row is an edge of its own, so nothing is sorted or shuffled to make the records.
FLOW_RAW = """
select case when event_type in ('view', 'click') then 'web' else 'app' end project,
       concat('app.m', cast(u % 7 as string), '.x', cast(cast(floor(u / 40) as bigint) as string), '.u', cast(u % 40 as string)) src,
       concat('app.m', cast(v % 7 as string), '.x', cast(cast(floor(v / 40) as bigint) as string), '.u', cast(v % 40 as string)) dst,
       case when event_type in ('view', 'click') then 'Imports' when event_type = 'signup' then 'Defines' else 'Calls' end kind,
       event_id seq, event_id line,
       case k % 4 when 0 then 1.0e0 when 1 then 0.9e0 when 2 then 0.7e0 else 0.5e0 end confidence,
       case when k % 8 = 3 then 'ExpectedExternal' when k % 4 = 3 then 'Ambiguous' when k % 4 = 2 then 'Inferred' else 'Extracted' end confidence_kind,
       dt
from (select event_id, event_type, user_id u, abs(user_id + (event_id * 7919 + cast(floor(event_id / 61) as bigint)) % 61 - 30) v,
             cast(floor(event_id / 10) as bigint) k, cast(ts as date) dt
      from {events}) h
"""

#: Nodes of the flow graph from a table of ids: kind and locality follow the id.
FLOW_NODES = """
select project, id,
       case cast(regexp_extract(id, 'u([0-9]+)$', 1) as int) % 6 when 0 then 'Module' when 1 then 'Module' when 2 then 'Function' when 3 then 'Class' when 4 then 'Method' else 'Trait' end kind,
       concat(replace(id, '.', '/'), '.py') file_path, 'Python' language, cast(1 as bigint) line,
       cast(regexp_extract(id, 'u([0-9]+)$', 1) as int) % 6 <> 0 is_local
from {ids}
"""

#: Cyclic graphs from all orders, a project for each thousand customers: an order ties its customer to another one of
#: the same fifty, every eleventh order to one of the fifty after it, so that there are many components.
SCC_EDGES = """
select distinct concat('p', cast(cast(floor(s / 1000) as bigint) as string)) project, s src, d dst
from (select o_custkey s, cast(floor(o_custkey / 50) as bigint) * 50 + (o_custkey * 7 + o_orderkey) % 50
               + case when o_orderkey % 11 = 0 and o_custkey % 1000 < 950 then 50 else 0 end d from {orders}) t
where s <> d
"""

#: The last order of each customer only: every node has one way out, so a project of a thousand has few cycles.
LAST_EDGES = """
select concat('p', cast(cast(floor(s / 1000) as bigint) as string)) project, s src, d dst
from (select o_custkey s, cast(floor(o_custkey / 50) as bigint) * 50 + (o_custkey * 7 + max(o_orderkey)) % 50 d from {orders} group by o_custkey) t
where s <> d
"""


def flow_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FLOW_RAW, events=read(spark, sf_dir, "events"))


def flow_nodes(edges: DataFrame) -> DataFrame:
    """The endpoints of edges(project, src, dst) as nodes."""
    ids = edges.select("project", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return edges.sparkSession.sql(FLOW_NODES, ids=ids).withColumn("alternative_paths", F.array().cast("array<string>"))


def scc_edges(spark: SparkSession, sf_dir: str, sql: str = SCC_EDGES) -> DataFrame:
    """Cyclic graphs with several components: edges(project, src, dst), ids as strings of nine digits."""
    out = spark.sql(sql, orders=read(spark, sf_dir, "orders"))
    padded = lambda c: F.lpad(F.col(c).cast("string"), 9, "0").alias(c)
    return out.select("project", padded("src"), padded("dst"))


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src host, dst href) of all links in the pages."""
    pages = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("dst"))
    return pages.distinct()


def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> supplier -> part: a large graph without cycles."""
    at = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nation = read(spark, sf_dir, "nation").select(at("r", "n_regionkey").alias("src"), at("n", "n_nationkey").alias("dst"))
    supplier = read(spark, sf_dir, "supplier").select(at("n", "s_nationkey").alias("src"), at("s", "s_suppkey").alias("dst"))
    part = read(spark, sf_dir, "lineitem").select(at("s", "l_suppkey").alias("src"), at("p", "l_partkey").alias("dst")).distinct()
    return nation.unionByName(supplier).unionByName(part).withColumn("project", F.lit("parts"))
