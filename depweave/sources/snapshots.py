"""Readers of earlier reports: explicit schemas, so that missing keys are null and unknown keys are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.operators.drift import Snapshot
from depweave.schemas import ANALYSIS, GRAPH, HISTORY


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def is_history_text(text: str) -> bool:
    """A history snapshot: captured_at is an integer and project a string."""
    import json

    try:
        data = json.loads(text)
    except ValueError:
        return False
    return isinstance(data, dict) and isinstance(data.get("captured_at"), int) and not isinstance(data.get("captured_at"), bool) and isinstance(data.get("project"), str)


def read_analysis(spark: SparkSession, path: str, project: str = "") -> Snapshot:
    """An analysis report as the tables of a snapshot. A history file gets an error that says so."""
    raw = read_json(spark, path, ANALYSIS + ", captured_at long")
    if not raw.filter("captured_at is not null").isEmpty():
        raise ValueError(f"{path} is a history snapshot; an analysis report is expected")
    if raw.filter("nodes is not null").isEmpty():
        raise ValueError(f"{path} is not an analysis report")
    raw = raw.withColumn("project", F.lit(project))
    nodes = raw.select("project", F.explode("nodes").alias("n")).select("project", "n.*")
    edges = raw.select("project", F.explode(F.coalesce("edges", F.array())).alias("e")).select("project", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.kind", "e.confidence", "e.confidence_kind", "e.in_cycle")
    members = raw.select("project", F.explode("communities").alias("c")).select("project", F.col("c.id").alias("community_id"), F.explode("c.members").alias("id"))
    return Snapshot(nodes, edges, members, raw.select("project", F.explode("cycles").alias("nodes")))


def read_graph(spark: SparkSession, path: str, project: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a node-link file."""
    raw = read_json(spark, path, GRAPH).withColumn("project", F.lit(project))
    nodes = raw.select("project", F.explode("nodes").alias("n")).select("project", "n.*").withColumn("alternative_paths", F.coalesce("alternative_paths", F.array().cast("array<string>")))
    edges = raw.select("project", F.explode("links").alias("e")).select("project", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.kind", F.col("e.weight"), "e.line", "e.confidence", "e.confidence_kind")
    return nodes, edges


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """All .json snapshots of a folder (see schemas.HISTORY), by capture time."""
    return spark.read.schema(HISTORY).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).orderBy("captured_at")


def history_tables(history: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, top hotspots, nodes) in the long form that operators.history works on."""
    points = history.select("project", "captured_at", "summary.*", F.col("confidence_summary.mean_confidence").alias("mean_confidence"))
    top = history.select("project", "captured_at", F.explode("top_hotspots").alias("h")).select("project", "captured_at", "h.*")
    nodes = history.select("project", "captured_at", F.explode("nodes").alias("n")).select("project", "captured_at", "n.*")
    return points, top, nodes
