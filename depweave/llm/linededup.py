"""Line dedup over levelled sorted runs of line hashes.

The keys of all lines kept so far live in runs: tables of (hash, owning document), bucketed and sorted by hash, no key
in two runs. A batch of documents is reduced to its distinct (key, least document) pairs in one shuffle whose partitions
are the buckets, merge-anti-joined with the runs as they lie, and what is new becomes a run of level 0. When a level
holds `fanout` runs they are merged into one run of the next level, bucket by bucket and without a shuffle, so that a
corpus of many batches reads few runs. Batches are ranges of rising doc_id, so the first owner of a key is its smallest
document. Runs are written to the shared folder; a lost executor repeats at most the batch in hand.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm.common import LOWER, arrow_batch, remove, schema_of, stage, staged_path, unused

MIN_CHARS, BATCHES, FANOUT = 10, 4, 2
NO_ID = (1 << 63) - 1


def line_key(line: bytes) -> bytes:
    return line.strip().translate(LOWER)


def key_hash(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes for the key of a line, None if the key is too short to count."""
    key = line_key(line)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_pairs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, h1, h2): the distinct long keys of each row of docs(doc, data)."""
    schema = schema_of("doc long, h1 long, h2 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {key_hash(x, min_chars) for x in (data or b"").split(b"\n")} - {None}
                ids += [doc] * len(own)
                hashes += own
            halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield arrow_batch({"doc": ids, "h1": pa.array(halves[:, 0].copy()), "h2": pa.array(halves[:, 1].copy())}, schema)

    return docs.select("doc", "data").mapInArrow(run, schema)


#: With it, Spark takes a bucket of one file as sorted and does not sort it again.
_SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """The levelled runs. Their tables are (h1, h2, owner); no key is in two runs. Call close() when they are not needed any more."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.sorted_before = spark.conf.get(_SORTED_SCAN, None)
        spark.conf.set(_SORTED_SCAN, "true")
        self.paths: dict[str, str] = {}

    def names(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def table(self) -> DataFrame:
        """All runs as plain rows: a join with a hot key may then be split, which buckets would not allow."""
        paths = [self.paths[x] for x in self.names()]
        return self.spark.read.schema("h1 long, h2 long, owner long").parquet(*paths) if paths else self.spark.createDataFrame([], "h1 long, h2 long, owner long")

    def add(self, pairs: DataFrame) -> None:
        """Take in a batch of (doc, h1, h2) whose documents follow all earlier ones."""
        owners = pairs.groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
        for run in self.names():
            owners = owners.join(self.spark.table(run).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._put(0, self._write(owners))

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = staged_path(self.spark, name)
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table {name}")
        remove(self.spark, self.paths.pop(name))

    def _put(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0])
            for x in old[1:]:  # no key is in both: the full outer merge join interleaves two sorted runs
                other = self.spark.table(x).withColumnRenamed("owner", "other").hint("merge")
                merged = merged.join(other, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("owner", "other").alias("owner"))
            new = self._write(merged)
            for x in old:
                self._drop(x)
            self._put(level + 1, new)

    def close(self, keep: bool = False) -> None:
        """Forget the runs' names, and with `keep` leave their files; the session's setting is put back."""
        for name in self.names():
            if keep:
                self.spark.sql(f"drop table {name}")
            else:
                self._drop(name)
        self.levels = []
        if self.sorted_before is None:
            self.spark.conf.unset(_SORTED_SCAN)
        else:
            self.spark.conf.set(_SORTED_SCAN, self.sorted_before)


def batch_bounds(pairs: DataFrame, batches: int) -> list[int]:
    """Rising upper ends (inclusive) of all batches but the last, from the distribution of doc."""
    if batches < 2:
        return []
    cuts = pairs.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs(doc_id, text, ...) -> the same columns, text without repeated lines, plus n_lines and n_dropped (long).

    A line goes if its key (white space stripped, A-Z lower-cased, at least `min_chars` code points) also occurs in a
    document with a smaller doc_id; lines that repeat within their first document stay. Null text counts as one empty
    line and comes out empty; rows that share a doc_id count as one document; a null doc_id counts as the largest.
    Kept lines are joined by \\n. Other columns pass through, also an earlier n_lines or n_dropped (then replaced).
    """
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    own, drop = unused(docs, "__doc"), unused(docs, "__drops")
    rows = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(own))
    pairs = stage(line_pairs(rows.select(F.col(own).alias("doc"), F.col("text").cast("binary").alias("data")), min_chars), "line-pairs")
    runs = LineRuns(docs.sparkSession, fanout)
    try:
        low = None
        for high in [*batch_bounds(pairs, batches), None]:
            batch = pairs if low is None else pairs.filter(F.col("doc") > low)
            runs.add(batch if high is None else batch.filter(F.col("doc") <= high))
            low = high
        owners = runs.table()
    finally:
        runs.close(keep=True)
    late = pairs.join(owners, ["h1", "h2"]).filter("owner < doc")
    drops = late.groupBy(F.col("doc").alias(own)).agg(F.collect_set(F.struct("h1", "h2")).alias(drop))
    return _rewrite(rows.join(drops, own, "left").drop(own), columns, drop, min_chars)


def _rewrite(rows: DataFrame, columns: list[str], drop: str, min_chars: int) -> DataFrame:
    kinds = {f.name: f for f in rows.schema.fields}
    schema = schema_of("n_lines long, n_dropped long")
    out = type(schema)([kinds[c] for c in columns] + schema.fields)
    names = [f"c{i}" for i in range(len(columns))]
    text = columns.index("text")
    plain = rows.select(*[F.col(c).cast("binary").alias(n) if c == "text" else F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], drop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, dropped = [], [], []
            drops = batch.column(len(names))
            ends, flat = drops.offsets.to_numpy() if len(batch) else [0], drops.values
            halves = np.column_stack([flat.field("h1").to_numpy(), flat.field("h2").to_numpy()]).astype("<i8").tobytes() if len(flat) else b""
            for i, data in enumerate(batch.column(text).to_pylist()):
                lines = (data or b"").split(b"\n")
                gone = {halves[16 * k : 16 * k + 16] for k in range(ends[i], ends[i + 1])}
                kept = [x for x in lines if key_hash(x, min_chars) not in gone] if gone else lines
                texts.append(b"\n".join(kept))
                totals.append(len(lines))
                dropped.append(len(lines) - len(kept))
            arrays = [batch.column(i) if i != text else pa.array(texts, pa.binary()).cast(pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names=out.fieldNames())

    return plain.mapInArrow(run, out)
