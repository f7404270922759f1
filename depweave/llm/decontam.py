"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against sliding windows of the training text.

The test items are taken in blocks of bounded size. Each block's windows are a sorted array of 64-bit hashes with the
place of each window in the block's words, sent once to every executor; the windows of a document are hashed and looked
up there, and each hit is verified word by word. All of the index but its word numbers is arrays: about 30 bytes a word
of the block. A benchmark that fits one block (the usual case) costs one pass without a shuffle; a larger one costs a
pass a block, whose hits are staged and meet by text at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.llm.common import LOWER, discard, schema_of, stage, unused

WINDOW = 13
#: Share of hit words from which a document is contaminated: 1 / 20.
MIN_SHARE = 20
#: Bytes of benchmark text in a block: bounds what is broadcast (an index takes at most about 40 times that: short words, all distinct).
BLOCK_BYTES = 2_000_000
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: other bytes become spaces.
WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in LOWER)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(WORDS).split()


@dataclass
class Windows:
    """The distinct windows of one size: rising hashes, the place of each in the words, and its items as ends into a list."""

    hashes: np.ndarray
    places: np.ndarray
    ends: np.ndarray
    items: np.ndarray


@dataclass
class WindowIndex:
    """The windows of a block of test items, by size."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    #: The numbers of all words of the block, in a row; the item ids.
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    names: list[str] = field(default_factory=list)
    windows: dict[int, Windows] = field(default_factory=dict)
    seed: int = 0

    @classmethod
    def build(cls, items: list[tuple[str, bytes | None]], window: int = WINDOW) -> WindowIndex:
        out = cls()
        number: dict[str, int] = {}
        parts, starts, at = [], {}, 0
        for item, data in items:
            ids = np.array([out.vocabulary.setdefault(w, len(out.vocabulary)) for w in words_of(data)], np.int32)
            size = min(window, len(ids))
            if size:
                first = np.arange(at, at + len(ids) - size + 1)
                starts.setdefault(size, []).append((first, np.full(len(first), number.setdefault(item, len(number)))))
                parts.append(ids)
                at += len(ids)
        out.words, out.names = np.concatenate([out.words, *parts]), list(number)
        while not all(out._put(size, *(np.concatenate(x) for x in zip(*found, strict=True))) for size, found in starts.items()):
            out.seed += 1  # two windows have one hash: hash all of them another way
            out.windows.clear()
        return out

    def _put(self, size: int, places: np.ndarray, items: np.ndarray) -> bool:
        hashes = self.mixed(self.words, places, size)
        order = np.lexsort((places, items, hashes))
        hashes, places, items = hashes[order], places[order], items[order]
        fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        group = np.cumsum(fresh) - 1
        firsts = places[fresh]
        for k in range(size):
            if not np.array_equal(self.words[places + k], self.words[firsts[group] + k]):
                return False
        kept = np.concatenate([[True], (group[1:] != group[:-1]) | (items[1:] != items[:-1])])
        ends = np.concatenate([[0], np.cumsum(np.bincount(group[kept], minlength=len(firsts)))])
        self.windows[size] = Windows(hashes[fresh], firsts, ends, items[kept].astype(np.int32))
        return True

    @property
    def nbytes(self) -> int:
        """Bytes of the arrays."""
        return self.words.nbytes + sum(x.nbytes for w in self.windows.values() for x in (w.hashes, w.places, w.ends, w.items))

    def mixed(self, ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """A 64-bit hash of the words from each start on."""
        out = np.full(len(starts), self.seed, np.uint64)
        for k in range(size):
            out = (out ^ (ids[starts + k].astype(np.uint64) + np.uint64(1))) * _MIX
            out ^= out >> np.uint64(29)
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """The places of hit words, rising, and the items with a window among the words."""
        n = len(words)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        edge, items = np.zeros(n + 1, np.int64), set()
        for size, own in self.windows.items():
            if n < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(starts):
                continue
            mixed = self.mixed(ids, starts, size)
            at = np.searchsorted(own.hashes, mixed)
            at[at == len(own.hashes)] = 0
            met = own.hashes[at] == mixed
            starts, at = starts[met], at[met]
            for k in range(size if len(starts) else 0):
                same = ids[starts + k] == self.words[own.places[at] + k]
                starts, at = starts[same], at[same]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + size, -1)
            for k in np.unique(at).tolist():
                items.update(self.names[i] for i in own.items[own.ends[k] : own.ends[k + 1]])
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0), items


def spans_of(data: bytes, hit: list[int]) -> list[tuple[int, int]]:
    """Runs of hit words as byte ranges of the UTF-8 text."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(WORDS))]
    out: list[tuple[int, int]] = []
    last = None
    for k in hit:
        out.append((out.pop()[0] if last == k - 1 else places[k][0], places[k][1]))
        last = k
    return out


def without_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its hit spans; what stood between words stays."""
    out, at = [], 0
    for start, end in spans:
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The items, in blocks of about block_bytes: never more than that (or one item) is on the driver."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("data")).filter("item is not null and data is not null")
    total = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    blocks = max(1, ceil(total / block_bytes))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item", "data"), F.lit(blocks)) == k)
        yield [(r["item"], bytes(r["data"])) for r in part.collect()]


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, found: str = "__found") -> DataFrame:
    """docs plus `found` struct<n_words long, hit array<int>, items array<string>>: hit word numbers, sorted item ids.

    Null text has no words. Items with a null id or text, or without a word, match nothing. Items of fewer words than
    the window are one window of their own length. Repeated rows get the same result each. `found` must be a new name.
    """
    blocks = _blocks(benchmark, item_col, item_text, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _scan_block(docs, text_col, WindowIndex.build(first, window), found)
    key, hits = F.sha2(F.col("text").cast("binary"), 256), []
    once = stage(docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null").dropDuplicates().select(key.alias("key"), "text"), "decontam-texts")
    for items in (first, second, *blocks):  # one block at a time: the generator hands on the next when this one is done
        met = _scan_block(once, "text", WindowIndex.build(items, window), "met").filter(F.size("met.items") > 0)
        hits.append(stage(met.select("key", "met.hit", "met.items"), "decontam-block"))
    discard(once)
    every = reduce(DataFrame.unionByName, hits).groupBy("key").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hit", "items")])
    name, more = unused(docs, "__key"), unused(docs, "__more")
    counted = _scan_block(docs, text_col, WindowIndex(), found).withColumn(name, F.sha2(F.col(text_col).cast("string").cast("binary"), 256))
    both = counted.join(every.select(F.col("key").alias(name), F.struct("hit", "items").alias(more)), name, "left")
    merged = F.struct(F.col(f"{found}.n_words").alias("n_words"), F.col(f"{more}.hit").alias("hit"), F.col(f"{more}.items").alias("items"))
    return both.withColumn(found, F.when(F.col(more).isNull(), F.col(found)).otherwise(merged)).select(*docs.columns, found)


def _scan_block(docs: DataFrame, text_col: str, index: WindowIndex, found: str) -> DataFrame:
    width = len(docs.columns)
    out = T.StructType([*docs.schema.fields, schema_of(f"{found} struct<n_words:long,hit:array<int>,items:array<string>>").fields[0]])
    kind = pa.struct([("n_words", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
    sent = docs.sparkSession.sparkContext.broadcast(index)
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(text_col).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            rows = []
            for data in batch.column(width).to_pylist():
                words = words_of(data)
                hit, items = own.scan(words)
                rows.append({"n_words": len(words), "hit": hit.tolist(), "items": sorted(items)})
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(width)], pa.array(rows, kind)], names=out.fieldNames())

    return plain.mapInArrow(run, out)


def contaminated(found: str = "__found", min_share: int = MIN_SHARE) -> Column:
    hit = F.size(f"{found}.hit")
    return (hit > 0) & (F.lit(min_share) * hit >= F.col(f"{found}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    found = unused(docs, "__found")
    return scan(docs, benchmark, found=found).filter(~contaminated(found)).select(*docs.columns)


def remove_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every hit span cut out of the text: the other way to act on a hit."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_spans(t.encode(), spans_of(t.encode(), list(h))).decode() for t, h in zip(texts, hits, strict=True)], dtype=object)

    name = unused(docs, "__found")
    found = scan(docs, benchmark, text_col, found=name)
    return found.withColumn(text_col, F.when(F.size(f"{name}.hit") > 0, cut(text_col, f"{name}.hit")).otherwise(F.col(text_col))).select(*docs.columns)
