"""SimHash near-duplicates: 64-bit fingerprints of three-word shingles, linked through a byte-position inverted index.

Two fingerprints that differ in at most 2 bits differ in at most 2 of their 8 bytes, so they share at least 6
positional bytes: that is the guaranteed minimum of the count filter. The index keeps one posting list for every
choice of 6 byte positions and their bytes (28 choices); two fingerprints meet in a list exactly if they reach the
minimum, and no pair that shares fewer bytes is ever listed. Inside a list the shared positional bytes of each pair are
tallied, pairs below the minimum are passed over, and the rest are verified bit by bit. The members of a list differ
in 2 bytes only, so a list of distinct fingerprints never has more than 65,536 entries, whatever the corpus holds; in
large lists the partners that keep the minimum are looked up instead (all ways to change at most 2 of the open bits).
Links are handed on as a spanning forest, so a group of n near copies costs n rows, not n * n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import LOWER, arrow_batch, schema_of, stage, unused
from depweave.llm.components import connected_components

SEED, SHINGLE, BITS = 42, 3, 2
#: Shingles hashed at once: bounds the memory that a very long text takes.
BLOCK = 1 << 18


def shingle_hashes(data: bytes | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of all shingles of UTF-8 bytes, repeats included, in blocks; nothing for null or no words."""
    words = (data or b"").translate(LOWER).split()
    if not words:
        return
    buf = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), BLOCK):
        parts = map(buf.__getitem__, map(slice, starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist()))
        yield np.fromiter(map(digest, parts, repeat(SEED)), np.uint64, len(starts[i : i + BLOCK]))


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The unsigned fingerprint of blocks of hashes: the bits set in over half of them; 0 without any."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in blocks:
        total += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of UTF-8 bytes; 0 for null or no words."""
    return majority(shingle_hashes(data, shingle))


def with_fingerprint(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc, fp long): the fingerprint's 64 bits as a signed long."""
    schema = schema_of("doc long, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield arrow_batch({"doc": batch.column(0), "fp": pa.array(fps)}, schema)

    return docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("data")).mapInArrow(run, schema)


def _masks(bits: int) -> list[int]:
    """For each choice of the bytes that must be equal, a mask of them (as a signed long)."""
    out = []
    for kept in combinations(range(8), 8 - bits):
        mask = sum(0xFF << 8 * i for i in kept)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def shared_bytes(many: np.ndarray, one: np.uint64) -> np.ndarray:
    """The tally: how many of its 8 positional bytes each fingerprint shares with one."""
    return ((many ^ one).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def list_links(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest, as (smaller, larger), of the links among distinct signed fingerprints of one posting list."""
    values = np.unique(values)
    n, parent = len(values), list(range(len(values)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, raw = [], values.view(np.uint64)
    if n <= 512:
        for i in range(n - 1):
            near = shared_bytes(raw[i + 1 :], raw[i]) >= 8 - bits
            reached = np.flatnonzero(near) + i + 1
            for j in reached[np.bitwise_count(raw[reached] ^ raw[i]) <= bits].tolist():
                if (a := find(i)) != (b := find(j)):
                    parent[max(a, b)] = min(a, b)
                    out.append((int(values[i]), int(values[j])))
        return out
    open_bits = int(np.bitwise_or.reduce(raw ^ raw[0]))
    places = [1 << i for i in range(64) if open_bits >> i & 1]
    flips = [sum(x) for k in range(1, bits + 1) for x in combinations(places, k)]
    for flip in flips:
        other = raw ^ np.uint64(flip)
        at = np.searchsorted(values, other.view(np.int64))
        at[at == n] = 0
        for i in np.flatnonzero(values[at] == other.view(np.int64)).tolist():
            if i < (j := int(at[i])) and (a := find(i)) != (b := find(j)):
                parent[max(a, b)] = min(a, b)
                out.append((int(values[i]), int(values[j])))
    return out


def fingerprint_links(distinct_fps: DataFrame, bits: int = BITS) -> DataFrame:
    """fps(fp), distinct -> links(u, v) that connect all fingerprints at most `bits` apart."""
    parts = int(distinct_fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = distinct_fps.select("fp").repartition(parts, "fp").select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("at"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(_masks(bits))])).alias("p"))
    lists = postings.groupBy("p.at", "p.bytes").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
    schema = schema_of("u long, v long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [x for fps in pdf["fps"] for x in list_links(np.asarray(fps, np.int64), bits)]
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return lists.mapInPandas(run, schema).distinct()


def near_duplicates(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc long, fp long, component long): component is the least id reachable through links of `bits` or fewer bits.

    Null texts and texts without a word have fingerprint zero and link like any other. Repeated ids give a row each;
    rows whose id is null link documents but are never named as a component (all-null components are null).
    Copies meet in one fingerprint before anything is paired. An empty table gives an empty result.
    """
    fps = stage(with_fingerprint(docs, doc_col, text_col), "simhash-fp")
    firsts = stage(fps.groupBy("fp").agg(F.min("doc").alias("first")), "simhash-first")
    roots = connected_components(fingerprint_links(firsts.select("fp"), bits), "simhash-edges")
    grouped = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component"))
    named = stage(grouped.join(least, "root").select("fp", "component"), "simhash-named")
    return fps.join(named, "fp").select("doc", "fp", "component")


def keep_first(docs: DataFrame, bits: int = BITS, find: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """The documents that are the first of their near-duplicate component, with all their columns.

    find(rows, id column, text column) -> (doc, component, ...) takes the place of near_duplicates. A null id counts as a large one made from the text. Of rows with one id, the least by text stays.
    """
    own, count = unused(docs, "__own_id"), unused(docs, "__rows")
    rows = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)))
    near = find(rows, own, "text") if find else near_duplicates(rows, own, "text", bits)
    first = near.filter("doc = component").groupBy(F.col("doc").alias(own)).agg(F.count(F.lit(1)).alias(count))
    kept = rows.join(first, own)
    again = kept.filter(F.col(count) > 1).groupBy(own).agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNotNull(), "text")).alias("row"))
    return kept.filter(F.col(count) == 1).select(*docs.columns).unionByName(again.select("row.*"))
