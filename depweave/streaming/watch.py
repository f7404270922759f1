"""Rebuilding on change: a stream of change records drives the projects they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depweave.operators.model import edge_state, merge_states
from depweave.sources.files import DEFAULT_EXCLUDES, EXTENSIONS

DEBOUNCE = "300 milliseconds"


def should_rebuild(path: Column, languages: list[str], excludes: tuple[str, ...] = (), output: str | None = None) -> Column:
    """A source file of the languages, in no excluded folder and not in the report folder."""
    words = [e for e, language in EXTENSIONS.items() if language in languages]
    banned = F.array(*[F.lit(x) for x in (*DEFAULT_EXCLUDES, *excludes)])
    out = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1).isin(words) & ~F.arrays_overlap(F.split(path, "/"), banned)
    return out if output is None else out & ~path.startswith(output.rstrip("/") + "/")


def affected_projects(changes: DataFrame, roots: dict[str, str]) -> DataFrame:
    """(project) whose root holds a changed path."""
    hits = F.array_compact(F.array(*[F.when(F.col("path").startswith(root.rstrip("/") + "/"), F.lit(name)) for name, root in roots.items()]))
    return changes.select(F.explode(hits).alias("project")).distinct()


def watch(changes: DataFrame, roots: dict[str, str], rebuild: Callable[[list[str]], None], checkpoint: str, languages: list[str], excludes: tuple[str, ...] = (), output: str | None = None, once: bool = False) -> StreamingQuery:
    """Start a query over a stream of changes(path, ...): each micro-batch rebuilds its projects once, however many files changed.

    The checkpoint remembers what was seen; a restarted query goes on from there.
    """
    wanted = changes.filter(should_rebuild(F.col("path"), languages, excludes, output))

    def batch(df: DataFrame, number: int) -> None:
        names = sorted(r["project"] for r in affected_projects(df, roots).collect())
        if names:
            rebuild(names)

    writer = wanted.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


def file_changes(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """New and rewritten files below a folder as a stream of paths."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder)
    return raw.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "modificationTime", "length")


def rebuild_edges(spark: SparkSession, source: str, schema: str, records: Callable[[DataFrame], DataFrame], state: str, checkpoint: str) -> DataFrame:
    """Merged edges of a stream of event files, batch by batch, until no file is left; records(events) are its raw edges.

    Each batch is reduced to one state row an edge before it is kept, under its own number (a repeated batch overwrites
    itself); the edges are merged from the states: the same rows as one merge over the whole input.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():  # a stream reads folders: take the one file of its folder
        reader, source = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()
    stream = reader.parquet(source)
    none = edge_state(records(spark.createDataFrame([], schema)))

    def batch(df: DataFrame, number: int) -> None:
        edge_state(records(df)).write.mode("overwrite").parquet(f"{state}/batch={number}")

    none.write.mode("overwrite").parquet(f"{state}/batch=-1")  # so that there is a table also without a file
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return merge_states(spark.read.schema(none.schema).parquet(state).select(*none.columns))
