"""Near copies by the Jaccard similarity of five-word shingle sets: documents at 0.8 or more are linked, without loss.

Operator 9's fingerprints, of five-word shingles, go through its index first, and the sets decide on what it brings
together. At 0.8 fingerprints of 64 bits are mostly too far apart for any index on their bytes, so an exact way follows
for the rest: the same count filtering over shingles instead of positional bytes. Two sets at 0.8 share a guaranteed
minimum of shingles. With each set in one order of all shingles (rare before frequent), the first shingle that two such
sets share stands so early in both that enough others can follow. So a set is posted under its first fifth of shingles
only, each posting with the largest partner for which the minimum can still be reached; pairs that no list brings
together, or whose postings rule each other out, cannot be similar enough. What remains is verified on the whole sets,
in whole numbers. The order comes from a table of counts of fixed size; it makes the lists short but decides nothing.

Lists are not paired out. First each member meets the leader of its list, the set with the fewest rare shingles, which
in a group of copies of one text is the text itself. Then, in rounds, only members that are still in different
components meet, through pivots whose number grows fourfold a round until all members have been pivots. So every pair of
a list is either compared, ruled out or already connected, and n near copies of one text cost about n comparisons.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.llm import simhash
from depweave.llm.common import arrow_batch, discard, schema_of, stage
from depweave.llm.components import connected_components, linked  # noqa: F401

ItemsOf = Callable[[DataFrame], DataFrame]

SEED, SHINGLE, GROWTH = 42, 5, 4
#: Similarity is at least AT_LEAST[0] / AT_LEAST[1].
AT_LEAST = (4, 5)
#: Counters of the table that the order of shingles comes from: four bytes each, whatever the corpus holds.
COUNTERS = 1 << 18
#: Bits of a set's bitmap: a bit that one set has and another has not is a shingle that they do not share.
BITS = 2048
#: Shingles of the texts that a task hands on at once.
BATCH = 1 << 18
#: Texts that a task is handed at once: each batch is held by the JVM and by its worker, beside its sets.
TEXTS = 1_000
_TEXTS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shingle_set(data: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of UTF-8 bytes as sorted hashes; shorter texts are one shingle, texts without words none."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *simhash.shingle_hashes(data, shingle)]))


def node_of(items: np.ndarray) -> int:
    """A signed number for the set."""
    return int(np.uint64(xxhash.xxh64_intdigest(items.tobytes(), SEED)).view(np.int64))


def bitmap(items: np.ndarray) -> np.ndarray:
    """BITS bits as signed longs; each shingle sets one."""
    out = np.zeros(BITS, np.uint8)
    out[(items >> np.uint64(20)) % np.uint64(BITS)] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


#: Built without a session, as workers use it too.
SETS = T.StructType([*[T.StructField(c, T.LongType()) for c in ("doc", "node", "n", "fp")], *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("items", "bits")]])
Batches = Iterator[pa.RecordBatch]


def _plain(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("data"))


def _sets(batches: Batches) -> Batches:
    """Batches of (doc, data) -> batches of SETS."""

    def out(docs: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
        fps = np.array([simhash.majority([x]) for x in sets], np.uint64).view(np.int64)
        return arrow_batch({"doc": docs, "node": [node_of(x) for x in sets], "n": [len(x) for x in sets], "fp": pa.array(fps), "items": items, "bits": [bitmap(x) for x in sets]}, SETS)

    for batch in batches:
        docs, sets, held = [], [], 0
        for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            docs.append(doc)
            sets.append(shingle_set(data))
            held += len(sets[-1])
            if held > BATCH:  # a batch's sets may be larger than its texts
                yield out(docs, sets)
                docs, sets, held = [], [], 0
        if docs:
            yield out(docs, sets)


def shingle_sets(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, node, n, fp, items, bits): each document's set, its number, its size, its fingerprint and its bitmap.

    The fingerprint is operator 9's, of the distinct five-word shingles."""
    return _plain(docs, doc_col, text_col).mapInArrow(_sets, SETS)


def counters(sets: DataFrame, make: Callable[[Batches], Batches] | None = None) -> np.ndarray:
    """How many shingles fall on each counter, over all sets.

    `make` gives the sets from the table's batches in the same pass: two passes in a row would be two workers a task.
    """
    schema = schema_of("cell int, n long")

    def run(batches: Batches) -> Batches:
        total = np.zeros(COUNTERS, np.int64)
        for batch in make(batches) if make else batches:
            total += np.bincount(batch.column("items").flatten().to_numpy().view(np.uint64) % np.uint64(COUNTERS), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield arrow_batch({"cell": pa.array(some), "n": pa.array(total[some])}, schema)

    found = (sets if make else sets.select("items")).mapInArrow(run, schema).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.uint32)
    out[found.column("cell").to_numpy()] = np.minimum(found.column("n").to_numpy(), np.iinfo(np.uint32).max)
    return out


def largest_partners(n: int) -> np.ndarray:
    """For each place from the first on: the size of the largest set that can share enough, if its first shared shingle stands there."""
    top, bottom = AT_LEAST
    places = np.arange(n)
    most = ((top + bottom) * (n - places) - top * n) // top
    return most[: int((bottom * most >= top * n).sum())]


def postings(sets: DataFrame, counts: np.ndarray, make: Callable[[Batches], Batches] | None = None) -> DataFrame:
    """(doc, node, n, fp, bits, keys): the shingles that a set is posted under, in their order. `make` as for counters."""
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    kept = ("doc", "node", "n", "fp", "bits")
    schema = schema_of("doc long, node long, n long, fp long, bits array<long>, keys array<long>")

    def run(batches: Batches) -> Batches:
        own, places = sent.value, {}
        for batch in make(batches) if make else batches:
            ends, flat = batch.column("items").offsets.to_numpy(), batch.column("items").values.to_numpy()
            keys = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if b - a not in places:
                    places[b - a] = len(largest_partners(b - a))
                items = flat[a:b]
                level = own[items.view(np.uint64) % np.uint64(COUNTERS)]
                keys.append(items[np.lexsort((items, level))[: places[b - a]]])
            yield arrow_batch({**{c: batch.column(c) for c in kept}, "keys": keys}, schema)

    return (sets if make else sets.select(*kept, "items")).mapInArrow(run, schema)


def _alike(pairs: DataFrame, sets: DataFrame, items_of: ItemsOf | None = None) -> DataFrame:
    """The rows of pairs(u, v) whose sets are similar enough, once each, staged.

    First by bitmaps, which are small: what one has and the other has not bounds what they share. The pairs that still
    may be similar are then compared set by set, in whole numbers. items_of(nodes(node)) -> (node, n, items) gives the
    sets of those pairs; without it they are taken from the table.
    """
    top, bottom = AT_LEAST
    of = lambda t, x, c: t.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col(c).alias(f"{c}{x}"))
    own = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda done, x: done + x)
    enough = lambda common: common * (top + bottom) >= (F.col("nu") + F.col("nv")) * top
    marked = pairs.distinct().join(of(sets, "u", "bits"), "u").join(of(sets, "v", "bits"), "v")
    possible = stage(marked.filter(enough(F.col("nu") - own("bitsu", "bitsv"))).filter(enough(F.col("nv") - own("bitsv", "bitsu"))).select("u", "v"), "copies-possible")
    whole = items_of(possible.select(F.explode(F.array("u", "v")).alias("node")).distinct()) if items_of else sets
    both = possible.join(of(whole, "u", "items"), "u").join(of(whole, "v", "items"), "v")
    links = stage(both.filter(enough(F.size(F.array_intersect("itemsu", "itemsv")))).select("u", "v"), "copies-links")
    discard(possible)
    if items_of:
        discard(whole)
    return links


def _may_meet(n: str, most: str, other_n: str, other_most: str):
    """The guaranteed minimum is in reach for two postings of one list."""
    top, bottom = AT_LEAST
    sizes = F.least(n, other_n) * bottom >= F.greatest(n, other_n) * top
    return sizes & (F.col(n) <= F.col(other_most)) & (F.col(other_n) <= F.col(most))


def lists_of(firsts: DataFrame) -> DataFrame:
    """Staged (key, node, n, most, size, lead) of all lists of two or more; the leader has the most room for its size.

    Most shingles are in one set only: their lists are counted away before anything else is known of them.
    """
    top, bottom = AT_LEAST
    posted = firsts.select("node", "n", F.posexplode("keys").alias("place", "key"))
    sizes = stage(posted.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "copies-sizes")
    most = F.floor(((top + bottom) * (F.col("n") - F.col("place")) - top * F.col("n")) / top).cast("long")
    shared = stage(posted.join(sizes, "key").select("key", "node", "n", most.alias("most"), "size"), "copies-shared")
    lead = F.max_by(F.struct("node", "n", "most"), F.struct(F.col("most") / F.col("n"), -F.col("node")))
    members = stage(shared.join(shared.groupBy("key").agg(lead.alias("lead")), "key"), "copies-members")
    discard(sizes)
    discard(shared)
    return members


def fingerprint_links(firsts: DataFrame, items_of: ItemsOf | None = None) -> DataFrame:
    """firsts(node, n, fp, bits), distinct sets -> links(u, v) among those that operator 9's index of fingerprints brings together.

    The index links the distinct fingerprints; the sets of one fingerprint meet its first, the firsts of linked
    fingerprints meet, and the sets decide.
    """
    first = stage(firsts.groupBy("fp").agg(F.min("node").alias("node")), "copies-fp")
    linked = simhash.fingerprint_links(first.select("fp"))
    at = lambda c: first.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"))
    across = linked.join(at("u"), "u").join(at("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    inside = firsts.select("fp", F.col("node").alias("v")).join(first.withColumnRenamed("node", "u"), "fp").filter("u <> v").select("u", "v")
    return _alike(across.unionByName(inside), firsts, items_of)


def set_links(members: DataFrame, sets: DataFrame, links: DataFrame | None = None, items_of: ItemsOf | None = None) -> DataFrame:
    """Staged members(key, node, n, most, size, lead) of the lists and the sets -> links(u, v) that connect what is similar.

    `links`: some that are known already; what they connect is not compared again.
    """
    known = members.filter("node <> lead.node").filter(_may_meet("n", "most", "lead.n", "lead.most")).select(F.col("lead.node").alias("u"), F.col("node").alias("v")).distinct()
    if links is not None:
        roots = stage(linked(links, "copies-edges"), "copies-roots")
        root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        known = known.join(root("u"), "u", "left").join(root("v"), "v", "left").filter("u_root is null or v_root is null or u_root <> v_root").select("u", "v")
    found = _alike(known, sets, items_of)
    links = found if links is None else links.unionByName(found)
    low, high = 0, GROWTH
    left = members.filter("node <> lead.node and size > 2").select("key", "node", "n", "most", "size")
    while True:
        roots = stage(linked(links, "copies-edges"), "copies-roots")
        rooted = left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        largest = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root")).alias("top"))
        now = stage(rooted.join(largest.filter("roots > 1").select("key", F.col("top.root").alias("main")), "key"), "copies-open")
        discard(roots)
        discard(left)
        most = now.agg(F.max("size")).first()[0]
        if most is None or low >= most:
            discard(now)
            return links
        place = F.shiftrightunsigned(F.xxhash64("node"), 11) / F.lit(float(1 << 53)) * F.col("size")
        pivots = now.withColumn("place", place).filter((F.col("place") >= low) & (F.col("place") < high) & (F.col("root") != F.col("main")))
        pivots = pivots.select("key", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("most").alias("p_most"), F.col("root").alias("p_root"))
        met = now.join(pivots, "key").filter("root <> p_root").filter(_may_meet("n", "most", "pn", "p_most"))
        links = links.unionByName(_alike(met.select(F.least("node", "p").alias("u"), F.greatest("node", "p").alias("v")), sets, items_of))
        left, low, high = now.drop("root", "main"), high, high * GROWTH
        left._staged_path = now._staged_path
        release_shuffles(members.sparkSession)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects the plans that made them, which it may not do for long by itself."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans run meanwhile hand at most TEXTS rows at once to a worker; the session's own setting comes back."""
    before = spark.conf.get(_TEXTS_CONF)
    spark.conf.set(_TEXTS_CONF, str(min(int(before), TEXTS) if int(before) > 0 else TEXTS))
    try:
        yield
    finally:
        spark.conf.set(_TEXTS_CONF, before)


def near_copies(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc long, node long, component long): component is the least id reachable through links.

    The index of fingerprints links first; the lists of shingles find what fingerprints of 64 bits cannot bring
    together. Whole sets are not kept: those of the pairs to be compared are made from their texts again. Texts without
    a word are one group. Copies meet in one set before anything is compared. Null ids are kept as null (keep_first
    gives every row an id first); an empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        return _near_copies(docs, doc_col, text_col)


def _near_copies(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    plain = _plain(docs, doc_col, text_col)
    rows = stage(postings(plain, counters(plain, _sets), _sets), "copies-rows")
    names = stage(rows.select("doc", "node"), "copies-names")
    firsts = stage(rows.groupBy("node").agg(F.min("doc").alias("first"), *[F.any_value(c).alias(c) for c in ("n", "fp", "bits", "keys")]), "copies-first")
    discard(rows)
    release_shuffles(spark)

    def items_of(nodes: DataFrame) -> DataFrame:
        """Of the documents that the nodes were first found in, so few ids that their texts need not be moved for them."""
        wanted = stage(firsts.join(nodes, "node", "left_semi").select("node", F.col("first").alias("doc")), "copies-wanted")
        ids = stage(wanted.select(F.col("doc").alias("wanted")).distinct(), "copies-ids")
        texts = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        sets = shingle_sets(texts.join(ids, F.col("doc").eqNullSafe(F.col("wanted")), "left_semi"), "doc", "text")
        out = stage(sets.join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).select("node", "n", "items"), "copies-compared")
        discard(wanted)
        discard(ids)
        return out

    sets = firsts.select("node", "n", "fp", "bits")
    links = fingerprint_links(sets, items_of)
    members = lists_of(firsts)
    release_shuffles(spark)
    roots = linked(set_links(members, sets, links, items_of), "copies-edges")
    grouped = firsts.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component"))
    named = stage(grouped.join(least, "root").select("node", "component"), "copies-named")
    for table in (members, firsts):
        discard(table)
    release_shuffles(spark)
    return names.join(named, "node").select("doc", "node", "component")
