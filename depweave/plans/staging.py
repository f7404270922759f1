"""Tables written to the shared folder between the rounds of an iterative program, and the choice of its kernel."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Nodes and edges of one project that a single task may hold; larger projects take the distributed program.
KERNEL_ROWS = 1_000_000

#: The same for a task that holds them as numbers (numbered()), of which it needs a few words each.
NUMBER_ROWS = 16_000_000

Program = Callable[[DataFrame, DataFrame], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors see.

    A session without one gets a temporary folder if it runs on one machine (local mode); on a cluster that would be
    another disk on each machine, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="depweave-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table and read it back: its lineage ends, and a lost executor repeats nothing before it."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    path = getattr(df, "_staged_path", None)
    if path:
        remove(df.sparkSession, path)


def by_size(nodes: DataFrame, edges: DataFrame, kernel: Program, program: Program, distributed: bool | None = None, rows: int | None = None) -> DataFrame:
    """kernel(nodes, edges) on the projects whose nodes and edges one task may hold, program(nodes, edges) on the others.

    Each project is judged by its own size, so a large one changes nothing for the small ones beside it. `distributed`
    sends all projects one way; `rows` is the bound, KERNEL_ROWS if it is not given.
    """
    if distributed is not None:
        return (program if distributed else kernel)(nodes, edges)
    sizes = nodes.groupBy("project").count().unionByName(edges.groupBy("project").count()).groupBy("project").agg(F.sum("count").alias("n"))
    large = stage(sizes.filter(F.col("n") > (KERNEL_ROWS if rows is None else rows)).select("project"), "large-projects")
    if large.isEmpty():
        discard(large)
        return kernel(nodes, edges)
    part = lambda how: (nodes.join(large, "project", how), edges.join(large, "project", how))
    return kernel(*part("left_anti")).unionByName(program(*part("left_semi")))


def per_project(nodes: DataFrame, edges: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """kernel(nodes, edges) once for each project, each in a task of its own. Call it through by_size()."""
    edges = edges.toDF(*edges.columns)  # new column identities: both tables may come from one
    return nodes.groupBy("project").cogroup(edges.groupBy("project")).applyInPandas(kernel, schema)


def numbered(ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (project, id, k), k from 0 in the order of each project's distinct ids, and staged (project, data).

    `data` holds some of the project's edges, as 32-bit numbers: all starts, then all ends; edges(project, src, dst)
    outside the ids are left out. Call it through by_size().
    """
    schema = T.StructType([T.StructField("project", T.StringType()), T.StructField("data", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, which = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            ends = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()]).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array([ends[:, which == i].tobytes() for i in range(len(names))], pa.binary())], names=["project", "data"])

    order = F.row_number().over(Window.partitionBy("project").orderBy("id")) - 1
    numbers = stage(ids.select("project", "id").distinct().withColumn("k", order), "numbers")
    at = lambda c: numbers.select("project", F.col("id").alias(c), F.col("k").alias(f"k_{c}"))
    links = edges.select("project", "src", "dst").join(at("src"), ["project", "src"]).join(at("dst"), ["project", "dst"])
    return numbers, stage(links.select("project", "k_src", "k_dst").mapInArrow(pack, schema), "packed-edges")


def unpacked(data: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all edges that numbered() packed."""
    parts = [np.frombuffer(x, "<i4").reshape(2, -1) for x in data]
    both = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int32)
    return both[0], both[1]
