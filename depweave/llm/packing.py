"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids; those longer than a sequence are cut into whole sequences and one shorter first piece.
The pieces below a sequence's length are dealt into shards of bounded size. Each shard is bred by several islands: a
chromosome is a grouping of pieces into bins; crossover injects whole well-filled bins of one parent into the other,
drops the bins that now hold a piece twice, swaps pieces set free for smaller ones where that fills a bin better, and
best-fits the rest; mutation dissolves a few bins and does the same. Breeding ends as soon as the number of bins meets
a lower bound, so that a shard that best-fit-decreasing packs as well as can be costs little. After each epoch the
elite of every island migrates to the next island of its shard (a shuffle of one row an island). In a last step the
pieces in the bins that stayed badly filled, from all shards, are dealt out and bred again together.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import arrow_batch, discard, schema_of, stage

CAPACITY, END_ID = 1024, 2
SHARD, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 8192, 2, 2, 6, 16
#: Text chunks whose ids a worker process keeps, and the bytes of text that it turns into ids at once.
CACHE, BLOCK = 250_000, 2_500_000
#: A bin of the other parent is well filled from GOOD of its capacity on; below LOOSE it is opened in the child.
GOOD, LOOSE = 63 / 64, 7 / 8

Bins = list[list[int]]
_CUT = re.compile(r" (?=\S)")
#: An empty word, or one that begins with white space.
_OPEN = r"^(?:$|[\s\x0b\x1c-\x1f\x{85}\pZ])"


class Ids:
    """Token ids of texts, as little-endian unsigned 32-bit numbers, equal to those of the `tokenizers` library.

    The byte-level pre-tokenizer never joins across a space that a non-space follows, so a block of texts is cut there
    and each distinct chunk is turned into ids once; the ids of the texts are then gathered by chunk number. Chunks go
    to tiktoken with the same vocabulary, which is several times faster; a text that holds a special token's string
    goes to `tokenizers` itself.
    """

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        self.words, self.starts, self.sizes, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.width = np.zeros(max(table.values()) + 1, np.int64)
            for token, number in table.items():
                self.width[number] = len(token)

    def chunks(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of " " + word for distinct words, as starts and sizes in one array. New words are kept until the store is full."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        new = words.take(pa.array(fresh))
        # one call for all new words: a space before a non-space always separates
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(new)], new), " ")[0].as_py()
        ids = np.array(self.fast.encode_ordinary(" " + text if len(new) else ""), "<u4")
        upto = np.cumsum(self.width[ids])
        ends = np.searchsorted(upto, np.cumsum(pc.binary_length(new).to_numpy().astype(np.int64) + 1)) + 1
        sizes = np.diff(ends, prepend=0)
        flat, starts = np.concatenate([self.flat, ids]), len(self.flat) + ends - sizes
        out_starts, out_sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        old = at >= 0
        out_starts[old], out_sizes[old] = self.starts[at[old]], self.sizes[at[old]]
        out_starts[fresh], out_sizes[fresh] = starts, sizes
        keep = min(len(fresh), CACHE - len(self.words))
        if keep:
            self.words = pa.concat_arrays([self.words, new.slice(0, keep)])
            self.starts, self.sizes = np.concatenate([self.starts, starts[:keep]]), np.concatenate([self.sizes, sizes[:keep]])
            self.flat = flat[: len(self.flat) + int(ends[keep - 1])]
        return out_starts, out_sizes, flat

    def of(self, text: str) -> np.ndarray:
        """The ids of one text."""
        if not text:
            return np.zeros(0, "<u4")
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")

    def long(self, text: str) -> np.ndarray:
        """The ids of a text beyond BLOCK, part by part."""
        if self.fast is None or any(s in text for s in self.special):
            return self.of(text)
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + BLOCK // 4)
            end = cut.start() if cut else len(text)
            out += self.block(pa.array([text[at:end]]))
            at = end
        return np.concatenate(out)

    def block(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each of some texts without nulls."""
        if self.fast is None or not len(texts):
            return [self.of(t) for t in texts.to_pylist()]
        parts = pc.split_pattern(texts, " ")
        coded = parts.values.dictionary_encode()
        words, codes, ends = coded.dictionary, coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy()
        firsts = ends[:-1]
        # a space before another space, other white space or the end does not separate: such texts go whole
        open_words = pc.match_substring_regex(words, _OPEN).to_numpy(zero_copy_only=False)
        joined = open_words[codes]
        joined[firsts] = False
        whole = np.add.reduceat(joined, firsts, dtype=np.int64) > 0
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        closed = np.flatnonzero(~open_words)
        starts, sizes = np.zeros(len(words) + len(firsts), np.int64), np.zeros(len(words) + len(firsts), np.int64)
        starts[closed], sizes[closed], flat = self.chunks(words.take(pa.array(closed)))
        heads = [self.fast.encode_ordinary(w) for w in words.take(pa.array(codes[firsts])).to_pylist()]
        sizes[len(words) :] = list(map(len, heads))
        starts[len(words) :] = len(flat) + np.cumsum(sizes[len(words) :]) - sizes[len(words) :]
        flat = np.concatenate([flat, np.array([i for x in heads for i in x], "<u4")])
        codes[firsts] = len(words) + np.arange(len(firsts))
        counts = sizes[codes]
        upto = np.cumsum(counts)
        places = np.repeat(starts[codes] - (upto - counts), counts) + np.arange(upto[-1])
        out = np.split(flat[places], upto[ends[1:-1] - 1])
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.of(texts[i].as_py())
        return out

    def many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (null: none), in blocks of bounded size."""
        texts = pc.fill_null(texts, "")
        upto = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, side="right")))
            if end == at + 1 and upto[at] - (upto[at - 1] if at else 0) > BLOCK:
                yield self.long(texts[at].as_py())
            else:
                yield from self.block(pa.concat_arrays([texts.slice(at, end - at)]))
            at = end


@lru_cache(maxsize=2)
def ids_of(tokenizer: str, ranks: str | None, pattern: str | None) -> Ids:
    """One tokenizer and one store of chunks for all tasks of a worker process."""
    return Ids(tokenizer, ranks, pattern)


def tokenizer_files() -> dict:
    """The public byte-level vocabulary, as parameters of `pieces`."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, ids (if kept), uid, sequence_id (whole sequences only).

    Null text counts as empty: the end id alone. Repeated ids and rows are packed row by row.
    """
    schema = schema_of("doc_id long, piece int, start long, length long, ids_crc32 long, uid long, sequence_id long" + ", ids array<int>" * keep_ids)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, uid = ids_of(tokenizer, ranks, pattern), TaskContext.get().partitionId() << 36
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.fieldNames()}
            for doc, ids in zip(batch.column(0).to_pylist(), own.many(batch.column(1)), strict=True):
                data = ids.tobytes() + end
                total = len(data) // 4
                start, k = 0, 0
                while start < total:
                    size = (total - 1) % capacity + 1 if not k else capacity
                    uid += 1
                    part = data[4 * start : 4 * (start + size)]
                    for name, value in zip(schema.fieldNames(), (doc, k, start, size, zlib.crc32(part), uid, -uid if size == capacity else None), strict=False):
                        out[name].append(value)
                    if keep_ids:
                        out["ids"].append(np.frombuffer(part, "<i4"))
                    start, k = start + size, k + 1
            yield arrow_batch(out, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs: the sum's, or for some t that of pieces above half a bin with those of at least t."""
    s = np.sort(np.asarray(sizes, np.int64))
    upto = np.concatenate([[0], np.cumsum(s)])
    half = int(np.searchsorted(s, capacity // 2, side="right"))
    t = np.unique(np.concatenate([[0], s[:half]]))
    alone = np.maximum(np.searchsorted(s, capacity - t, side="right"), half)
    room = (alone - half) * capacity - (upto[alone] - upto[half])
    small = upto[half] - upto[np.minimum(np.searchsorted(s, t), half)]
    return int((len(s) - half + np.maximum(0, -(-(small - room) // capacity))).max(initial=0))


def best_fit(sizes: list[int], order: list[int], bins: Bins, capacity: int, filled: list[int] | None = None) -> Bins:
    """Put pieces into the bins, which are changed (and `filled` with them), or new ones: always where the least room is left."""
    filled = _filled(sizes, bins) if filled is None else filled
    room = sorted((capacity - x, k) for k, x in enumerate(filled))
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
            filled[k] += sizes[i]
        else:
            left, k = capacity, len(bins)
            bins.append([i])
            filled.append(sizes[i])
        if left > sizes[i]:
            insort(room, (left - sizes[i], k))
    return bins


def _filled(sizes: list[int], bins: Bins) -> list[int]:
    return [sum([sizes[i] for i in b]) for b in bins]


@dataclass
class Packing:
    """A chromosome: bins and how full they are. Bins are shared between chromosomes and never changed in place."""

    bins: Bins
    filled: list[int]

    @classmethod
    def of(cls, sizes: list[int], bins: Bins) -> Packing:
        return cls(bins, _filled(sizes, bins))

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first, then fuller ones (sum of squares)."""
        return len(self.bins), -sum([x * x for x in self.filled])


def place_displaced(sizes: list[int], bins: Bins, filled: list[int], displaced: list[int], capacity: int) -> Packing:
    """Best-fit displaced pieces; before that, fuller bins first, swap one for one or two of a bin where the bin gains most."""
    loose = sorted((sizes[i], i) for i in displaced)
    for k in np.argsort([-x for x in filled], kind="stable").tolist():
        room, own = capacity - filled[k], bins[k]
        if not room:
            continue
        gain, out, at = 0, (), -1
        pairs = [(i, j) for n, i in enumerate(own) for j in own[:n]] if len(own) <= 8 else []
        for group in ([(i,) for i in own], pairs):
            for some in group:
                have = sum([sizes[i] for i in some])
                found = bisect_right(loose, (have + room, len(sizes))) - 1
                if found >= 0 and loose[found][0] - have > gain:
                    gain, out, at = loose[found][0] - have, some, found
            if gain == room:
                break
        if out:
            new = loose.pop(at)[1]
            bins[k] = [i for i in own if i not in out] + [new]
            filled[k] += gain
            for i in out:
                insort(loose, (sizes[i], i))
    # bins that pieces are put into are copied first
    done, order = Packing(bins, filled), [i for _, i in reversed(loose)]
    room = sorted((capacity - x, k) for k, x in enumerate(filled))
    copied: set[int] = set()
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            if k not in copied:
                bins[k] = list(bins[k])
                copied.add(k)
            bins[k].append(i)
            filled[k] += sizes[i]
        else:
            left, k = capacity, len(bins)
            bins.append([i])
            filled.append(sizes[i])
            copied.add(k)
        if left > sizes[i]:
            insort(room, (left - sizes[i], k))
    return done


def crossover(sizes: list[int], first: Packing, second: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """Half of the well-filled bins of one parent go whole into the other; bins with duplicates go; what they held is placed anew."""
    full = [k for k, x in enumerate(first.filled) if x >= GOOD * capacity]
    taken = [full[i] for i in np.flatnonzero(rng.random(len(full)) < 0.5)]
    bins, filled = [first.bins[k] for k in taken], [first.filled[k] for k in taken]
    have = {i for b in bins for i in b}
    displaced: list[int] = []
    for b, x in zip(second.bins, second.filled, strict=True):
        if not have.isdisjoint(b):
            displaced += [i for i in b if i not in have]
        elif x >= LOOSE * capacity:
            bins.append(b)
            filled.append(x)
        else:
            displaced += b
    return place_displaced(sizes, bins, filled, displaced, capacity)


def mutate(sizes: list[int], own: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """Dissolve the least filled bins and as many random ones, and place their pieces anew."""
    some = max(2, len(own.bins) // 20)
    gone = set(np.argsort(own.filled, kind="stable")[:some].tolist()) | set(rng.integers(0, len(own.bins), some).tolist())
    kept = [k for k in range(len(own.bins)) if k not in gone]
    return place_displaced(sizes, [own.bins[k] for k in kept], [own.filled[k] for k in kept], [i for k in sorted(gone) for i in own.bins[k]], capacity)


def evolve(sizes: list[int], seeds: list[Bins], capacity: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> Bins:
    """One epoch of one island; the elite it ends with."""
    rng, bound = np.random.default_rng(seed), lower_bound(sizes, capacity)
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    pool = [Packing.of(sizes, [list(b) for b in x]) for x in seeds] or [Packing.of(sizes, best_fit(sizes, order, [], capacity))]
    while len(pool) < population and min(len(x.bins) for x in pool) > bound:
        noise = rng.random(len(sizes)) * 0.05 * capacity * len(pool)
        pool.append(Packing.of(sizes, best_fit(sizes, sorted(order, key=lambda i: -sizes[i] - noise[i]), [], capacity)))
    ranked = sorted(((x.fitness(), k, x) for k, x in enumerate(pool)), key=lambda x: x[:2])
    count = len(ranked)
    for _ in range(generations):
        if ranked[0][0][0] <= bound:
            break
        best, mate = ranked[0][2], ranked[int(rng.integers(1, len(ranked)))][2] if len(ranked) > 1 else ranked[0][2]
        for child in (crossover(sizes, best, mate, capacity, rng), crossover(sizes, mate, best, capacity, rng), mutate(sizes, best, capacity, rng)):
            count += 1
            ranked.append((child.fitness(), count, child))
        ranked = sorted(ranked, key=lambda x: x[:2])[:population]
    return ranked[0][2].bins


def _deal(items: DataFrame, shard: int, salt: int) -> DataFrame:
    """items(uid, length) with a shard number: shards hold about `shard` pieces at any input size."""
    count = items.count()
    return items.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(max(1, round(count / shard)))))


def _breed(dealt: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """dealt(uid, length, shard) -> (uid, length, shard, bin, offset, filled) of each shard's elite, staged."""
    parts = dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(F.col("length").cast("int").alias("length"), "uid"))).alias("own"))
    rows = stage(rows, "pack-shards")
    elites = rows.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(None).cast("array<int>").alias("a"), F.lit(None).cast("array<int>").alias("b"))
    schema = "shard long, island int, a array<int>, bins int"

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for shard, island, own, a, b in zip(pdf["shard"], pdf["island"], pdf["sizes"], pdf["a"], pdf["b"], strict=True):
                    sizes = [int(x) for x in own]
                    seeds = [_bins(x) for x in (a, b) if x is not None]
                    best = evolve(sizes, seeds, capacity, seed=(int(shard) * 64 + int(island)) * 64 + number)
                    at = np.zeros(len(sizes), np.int32)
                    for k, members in enumerate(best):
                        at[members] = k
                    out.append((shard, island, at, len(best)))
                yield pd.DataFrame(out, columns=["shard", "island", "a", "bins"])

        return run

    sizes = rows.select("shard", F.col("own.length").alias("sizes"))
    old = []
    for number in range(epochs):
        work = sizes.join(elites, "shard").repartition(int(parts), "shard", "island")
        bred = stage(work.select("shard", "island", "sizes", "a", "b").mapInPandas(epoch(number), schema), "pack-elite")
        migrant = bred.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("a").alias("b"))
        elites = bred.select("shard", "island", "a").join(migrant, ["shard", "island"])
        old.append(bred)
    best = bred.groupBy("shard").agg(F.min_by("a", F.struct("bins", "island")).alias("a"))
    schema = "uid long, length int, shard long, bin int, offset long, filled long"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, own, a in zip(pdf["shard"], pdf["own"], pdf["a"], strict=True):
                one = pd.DataFrame({"uid": [x["uid"] for x in own], "length": [x["length"] for x in own], "bin": np.asarray(a)})
                size = one.groupby("bin")["length"]
                yield one.assign(shard=shard, offset=size.cumsum() - one["length"], filled=size.transform("sum"))[["uid", "length", "shard", "bin", "offset", "filled"]]

    out = stage(rows.join(best, "shard").select("shard", "own", "a").mapInPandas(place, schema), "pack-placed")
    for table in (rows, *old):
        discard(table)
    return out


def _bins(assigned: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(int(max(assigned)) + 1)]
    for i, k in enumerate(assigned):
        out[k].append(i)
    return out


def pack(table: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of `pieces` with sequence_id and offset: no sequence over capacity, no gap, no piece lost.

    An empty table gives an empty result. Sequence numbers: whole sequences negative, bins of shards positive.
    """
    table = stage(table, "pack-pieces")
    items = table.filter("sequence_id is null").select("uid", "length")
    first = _breed(_deal(items, shard, 0), capacity, islands, epochs)
    good = F.lit(50) * (F.lit(capacity) - F.col("filled")) <= F.lit(capacity)
    again = _breed(_deal(first.filter(~good).select("uid", F.col("length").cast("long").alias("length")), shard, 1), capacity, islands, epochs)
    number = lambda step: ((F.col("shard") * 2 + step) * F.lit(1 << 24) + F.col("bin")).alias("sequence_id")
    placed = first.filter(good).select("uid", number(0), "offset").unionByName(again.select("uid", number(1), "offset"))
    rest = table.filter("sequence_id is null").drop("sequence_id").join(placed, "uid").select(*table.columns, "offset")
    return table.filter("sequence_id is not null").withColumn("offset", F.lit(0).cast("long")).unionByName(rest).drop("uid")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True, **files) -> DataFrame:
    """docs(doc_id, text) packed into sequences: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(pieces(docs, **(files or tokenizer_files()), capacity=capacity, end_id=end_id, keep_ids=keep_ids), capacity)
