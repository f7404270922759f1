"""Building the graph: raw records become one row a node and one row an edge of each kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions.text import stub_candidates

NODE_COLUMNS = ("project", "id", "kind", "file_path", "language", "line", "is_local", "alternative_paths")
EDGE_COLUMNS = ("project", "src", "dst", "kind", "weight", "line", "confidence", "confidence_kind")


def merge_nodes(raw: DataFrame) -> DataFrame:
    """raw(project, id, ..., seq): of each id the record with the least seq."""
    rest = [c for c in raw.columns if c not in ("project", "id", "seq")]
    return raw.groupBy("project", "id").agg(F.min_by(F.struct(*rest), "seq").alias("first")).select("project", "id", "first.*")


def merge_edges(raw: DataFrame) -> DataFrame:
    """raw(project, src, dst, kind, line, confidence, confidence_kind, seq) -> one row for each (src, dst, kind).

    weight counts records; the line is that of the first record; confidence and its kind are those of the first record
    with the highest confidence. One partial aggregation before one shuffle, no window.
    """
    out = raw.groupBy("project", "src", "dst", "kind").agg(
        F.count(F.lit(1)).alias("weight"),
        F.min_by("line", "seq").alias("line"),
        F.max("confidence").alias("confidence"),
        F.min_by("confidence_kind", F.struct(-F.col("confidence"), F.col("seq"))).alias("confidence_kind"),
    )
    return out.select(*EDGE_COLUMNS)


def edge_state(raw: DataFrame) -> DataFrame:
    """What merge_edges needs to know of some records, so that the states of several batches can be put together."""
    return raw.groupBy("project", "src", "dst", "kind").agg(
        F.count(F.lit(1)).alias("weight"),
        F.min(F.struct("seq", "line")).alias("first"),
        F.min(F.struct((-F.col("confidence")).alias("c"), F.col("seq"), F.col("confidence_kind").alias("kind"))).alias("best"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """Merged edges from the states of any number of batches: the rows of merge_edges over all their records."""
    out = states.groupBy("project", "src", "dst", "kind").agg(F.sum("weight").alias("weight"), F.min("first").alias("first"), F.min("best").alias("best"))
    return out.select("project", "src", "dst", "kind", "weight", F.col("first.line").alias("line"), (-F.col("best.c")).alias("confidence"), F.col("best.kind").alias("confidence_kind")).select(*EDGE_COLUMNS)


def placeholder_nodes(nodes: DataFrame, edges: DataFrame, language: str | DataFrame = "Python") -> DataFrame:
    """A Module node for every endpoint that has none. `language`: one name, or a table (project, language)."""
    ends = edges.select("project", F.explode(F.array("src", "dst")).alias("id")).distinct()
    missing = ends.join(nodes.select("project", "id"), ["project", "id"], "left_anti")
    missing = missing.withColumn("language", F.lit(language)) if isinstance(language, str) else missing.join(language, "project", "left")
    return missing.select("project", "id", F.lit("Module").alias("kind"), F.lit("").alias("file_path"), "language", F.lit(0).cast("long").alias("line"), F.lit(False).alias("is_local"), F.array().cast("array<string>").alias("alternative_paths"))


def complete(nodes: DataFrame, edges: DataFrame, language: str | DataFrame = "Python") -> DataFrame:
    return nodes.select(*NODE_COLUMNS).unionByName(placeholder_nodes(nodes, edges, language))


def scoring_view(edges: DataFrame) -> DataFrame:
    """The edges that metrics are computed on: not those to expected externals."""
    return edges.filter("confidence_kind <> 'ExpectedExternal'")


def with_alternative_paths(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Append more(project, id, paths array) to the alternative paths, each path once, in order."""
    both = nodes.join(more, ["project", "id"], "left")
    return both.withColumn("alternative_paths", F.array_distinct(F.concat("alternative_paths", F.coalesce("paths", F.array().cast("array<string>"))))).drop("paths")


def resolved_confidence(edges: DataFrame, stubs: DataFrame | None = None) -> DataFrame:
    """edges(..., raw_dst, dst, is_local, confidence, confidence_kind, resolver_confidence) with the final confidence.

    Defines edges stay as they are. Otherwise the lower of extractor and resolver counts, a changed target makes the
    edge Inferred, and a target outside the project is capped at 0.5 and is ExpectedExternal (if a stub prefix of
    stubs(project, prefix) matches) or Ambiguous.
    """
    if stubs is None:
        expected = edges.withColumn("__expected", F.lit(False))
    else:
        targets = edges.filter("not is_local").select("project", "dst").distinct()
        possible = targets.withColumn("prefix", F.explode(stub_candidates(F.col("dst"))))
        hit = possible.join(stubs.select("project", "prefix"), ["project", "prefix"], "left_semi").select("project", "dst").distinct().withColumn("__expected", F.lit(True))
        expected = edges.join(hit, ["project", "dst"], "left").withColumn("__expected", F.coalesce("__expected", F.lit(False)))
    defines = F.col("kind") == "Defines"
    lower = F.least("confidence", "resolver_confidence")
    kind = F.when(F.col("raw_dst") != F.col("dst"), "Inferred").otherwise(F.col("confidence_kind"))
    outside = F.when(F.col("__expected"), "ExpectedExternal").otherwise("Ambiguous")
    return (
        expected.withColumn("__c", F.when(defines, F.col("confidence")).when(F.col("is_local"), lower).otherwise(F.least(lower, F.lit(0.5))))
        .withColumn("confidence_kind", F.when(defines, F.col("confidence_kind")).when(F.col("is_local"), kind).otherwise(outside))
        .withColumn("confidence", F.col("__c"))
        .drop("__c", "__expected")
    )
