"""LM scoring by a class-based n-gram model: exchange clustering, class transitions and word emissions.

All counts come from the whole training part of the corpus, and every training word is put into a class by exchange:

* The most frequent words, and one item for each value of a hash of the ending of all other words, are clustered by the
  sequential exchange algorithm on their bigram counts: one item at a time moves to the class that raises the likelihood
  of the class bigrams most, until no move helps. The number of these items is a parameter, so what reaches the driver
  is bounded.
* Every other training word then starts in the class of its ending and is moved, in one distributed sweep over its own
  counts by class of the word before, to the class that raises the likelihood of its occurrences most. The table of
  words, counts and classes grows with the corpus and stays in the shared folder.

A word's probability is P(class | context) * P(word | class), both with additive smoothing. The context is the class of
the word before: its own, if it is one of the most frequent words, else that of its ending (this is what a task knows
without the table). A word that the training part does not hold is emitted by the class of its ending.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import arrow_batch, crc_remainder, discard, schema_of, stage

#: Words that are items of the sequential exchange; endings; classes; words whose counts are sent to every task.
ITEMS, ENDINGS, CLASSES, HEAD = 1_000, 255, 48, 65_536
SWEEPS, DELTA, SEED = 8, 0.1, 42
HOLD_OUT_MODULUS, HOLD_OUT = 10, 0
#: Bytes of text that a task takes apart at once, and counts that it hands on at once.
BLOCK, FLUSH = 1_500_000, 250_000


def blocks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts (null: empty) of bounded size, with the place of their first; one text is never divided."""
    texts = pc.fill_null(texts, "")
    upto = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, side="right")))
        yield at, pa.concat_arrays([texts.slice(at, end - at)])
        at = end


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the code of each token, and the number of tokens of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = parts.values.dictionary_encode()
    words, codes, ends = found.dictionary, found.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy()
    real = (pc.binary_length(words).to_numpy() > 0)[codes]  # white space at an end of a text leaves an empty part
    sizes = np.add.reduceat(real, ends[:-1], dtype=np.int64) if len(codes) else np.zeros(len(texts), np.int64)
    return words, codes[real], sizes


def endings(words: pa.Array) -> np.ndarray:
    """The hash of each word's last three bytes."""
    last = pc.binary_slice(words.cast(pa.binary()), -3).dictionary_encode()
    hashed = np.array([zlib.crc32(x) % ENDINGS for x in last.dictionary.to_pylist()], np.int64)
    return hashed[last.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n long) over all rows of texts(text); tasks count before the shuffle."""
    schema = schema_of("word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block in blocks(batch.column(0)):
                words, codes, _ = coded(block)
                n = np.bincount(codes, minlength=len(words))
                some = np.flatnonzero(n)
                yield arrow_batch({"word": words.take(pa.array(some)), "n": pa.array(n[some])}, schema)

    return texts.select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def frequent(vocabulary: DataFrame, most: int) -> list[tuple[str, int]]:
    """The `most` words of the highest counts; among equal steps of the count (64 to a doubling), those of the least hash."""
    step = F.floor(F.log2("n") * 64)
    levels = sorted(((r["s"], r["k"]) for r in vocabulary.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total, least, rows = 0, None, []
    for s, k in levels:
        if total + k > most:
            cut = vocabulary.filter(step == s).orderBy(F.xxhash64("word", F.lit(SEED)), "word").limit(most - total)
            rows += cut.collect()
            break
        total, least = total + k, s
    if least is not None:
        rows += vocabulary.filter(step >= least).collect()
    return sorted(((r["word"], r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


@dataclass
class Items:
    """The words of the head, and the item of every word: own + 1 of them by themselves (0 is a text's border), else by ending."""

    words: pa.Array
    count: np.ndarray
    item: np.ndarray
    own: int

    @classmethod
    def of(cls, head: list[tuple[str, int]], items: int) -> Items:
        words, own = pa.array([w for w, _ in head], pa.string()), min(items, len(head))
        item = np.concatenate([1 + np.arange(own), 1 + own + endings(words.slice(own))])
        return cls(words, np.array([n for _, n in head], np.int64), item.astype(np.int64), own)

    @property
    def size(self) -> int:
        return 1 + self.own + ENDINGS

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Head numbers (-1 outside the head) and items of words."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        item = 1 + self.own + endings(words)
        inside = at >= 0
        item[inside] = self.item[at[inside]]
        return at, item


def before(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each token and then each end of some texts: the value of the token before it, 0 at the start of a text."""
    ends = np.cumsum(sizes)
    shifted = np.concatenate([[0], values[:-1]]) if len(values) else np.zeros(0, np.int64)
    starts = (ends - sizes)[sizes > 0]
    shifted[starts] = 0
    last = np.zeros(len(sizes), np.int64)
    last[sizes > 0] = values[ends[sizes > 0] - 1]
    return np.concatenate([shifted, last])


def bigram_counts(texts: DataFrame, items: Items) -> np.ndarray:
    """Counts of item pairs over all texts, (size, size): [before, after]; item 0 stands before and after each text."""
    size, schema = items.size, schema_of("cell int, n long")
    sent = texts.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = sent.value, np.zeros(size * size, np.int64)
        for batch in batches:
            for _, block in blocks(batch.column(0)):
                words, codes, sizes = coded(block)
                item = own.look_up(words)[1][codes]
                after = np.concatenate([item, np.zeros(len(sizes), np.int64)])
                total += np.bincount(before(item, sizes) * size + after, minlength=size * size)
        for cells, n in _some(total):
            yield arrow_batch({"cell": cells, "n": n}, schema)

    return _gathered(texts.select("text").mapInArrow(run, schema), size * size).reshape(size, size)


def _some(total: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The places and values of what is not zero, in parts."""
    some = np.flatnonzero(total)
    for i in range(0, len(some), FLUSH):
        yield pa.array(some[i : i + FLUSH]), pa.array(total[some[i : i + FLUSH]])


def _gathered(cells: DataFrame, width: int) -> np.ndarray:
    """The sums of (cell, n) as an array of that width, which bounds what reaches the driver."""
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def context_counts(texts: DataFrame, items: Items, of: np.ndarray) -> tuple[np.ndarray, DataFrame]:
    """How often each word follows each class of context (of: by item), over all texts, in one pass.

    Gives the counts (1 + head, classes) of the end of a text and of the words of the head, and a staged table
    (word, left, n) of all other words; tasks count first.
    """
    k, heads = int(of.max(initial=0)) + 1, len(items.words)
    schema = schema_of("word string, cell int, n long")
    sent = texts.sparkSession.sparkContext.broadcast((items, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, classes), total = sent.value, np.zeros((heads + 1) * k, np.int64)
        for batch in batches:
            for _, block in blocks(batch.column(0)):
                words, codes, sizes = coded(block)
                at, item = own.look_up(words)
                at, left = at[codes], before(classes[item[codes]], sizes)
                known = at >= 0
                key = np.concatenate([at[known] + 1, np.zeros(len(sizes), np.int64)])
                cells, n = np.unique(key * k + np.concatenate([left[: len(codes)][known], left[len(codes) :]]), return_counts=True)
                total[cells] += n
                pairs, n = np.unique(codes[~known] * k + left[: len(codes)][~known], return_counts=True)
                yield arrow_batch({"word": words.take(pa.array(pairs // k)), "cell": pa.array(pairs % k), "n": pa.array(n)}, schema)
        for cells, n in _some(total):
            yield arrow_batch({"word": pa.nulls(len(n), pa.string()), "cell": cells, "n": n}, schema)

    found = stage(texts.select("text").mapInArrow(run, schema), "brown-contexts")
    return _gathered(found.filter("word is null").select("cell", "n"), (heads + 1) * k).reshape(heads + 1, k), found


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each item; item 0 has class 0 for itself. Deterministic: items by falling count, ties by number."""
    size = len(counts)
    n = counts.astype(float)
    order = np.argsort(-(n.sum(0) + n.sum(1))[1:], kind="stable") + 1
    of = np.zeros(size, np.int64)
    of[order] = np.arange(size - 1) % classes + 1
    k = classes + 1
    one = np.zeros((size, k))
    one[np.arange(size), of] = 1
    pair = one.T @ n @ one
    out, into = n @ one, n.T @ one  # of item to class, of class to item
    left, right = n.sum(1), n.sum(0)

    for _ in range(sweeps):
        moves = 0
        for w in order.tolist():
            old, self_n = of[w], n[w, w]
            row, col = out[w].copy(), into[w].copy()  # w to classes, classes to w, both with w in its old class
            row[old] -= self_n
            col[old] -= self_n
            pair[old] -= row
            pair[:, old] -= col
            pair[old, old] -= self_n
            a, b = pair.sum(1), pair.sum(0)
            # adding w to class c changes row c, column c and, in both, cell (c, c)
            with_row, with_col = pair + row[None, :], pair + col[:, None]
            diag = np.arange(k)
            gain = (_xlogx(with_row) - _xlogx(pair)).sum(1) - (_xlogx(with_row[diag, diag]) - _xlogx(pair[diag, diag]))
            gain += (_xlogx(with_col) - _xlogx(pair)).sum(0) - (_xlogx(with_col[diag, diag]) - _xlogx(pair[diag, diag]))
            gain += _xlogx(pair[diag, diag] + row + col + self_n) - _xlogx(pair[diag, diag])
            gain -= _xlogx(a + left[w]) - _xlogx(a) + _xlogx(b + right[w]) - _xlogx(b)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            new = new if gain[new] > gain[old] + 1e-9 else int(old)
            pair[new] += row
            pair[:, new] += col
            pair[new, new] += self_n
            if new != old:
                moves += 1
                of[w] = new
                out[:, old] -= n[:, w]
                out[:, new] += n[:, w]
                into[:, old] -= n[w]
                into[:, new] += n[w]
        if not moves:
            break
    return of


def best_classes(lefts: np.ndarray, transition: np.ndarray, emission: np.ndarray) -> np.ndarray:
    """One exchange step for words with such counts by class before them: the class under which their occurrences are likeliest."""
    gain = lefts @ transition[:, 1:] - lefts.sum(1, keepdims=True) * emission[None, 1:]
    return gain.argmax(1) + 1


def assign_rest(rest: DataFrame, of: np.ndarray, transition: np.ndarray, emission: np.ndarray, sweep: bool, first_ending: int) -> DataFrame:
    """Staged (word, n, class, at, c) of the words outside the head: their class and their counts by class before them.

    Without `sweep` they stay in the class of their ending.
    """
    k = len(transition)
    schema = schema_of("word string, n long, class int, at array<int>, c array<long>")
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def out(words: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        own = best_classes(counts, transition, emission) if sweep else of[first_ending + endings(words)]
        rows, at = np.nonzero(counts)
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(counts)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (at.astype(np.int32), counts[rows, at].astype(np.int64))]
        return arrow_batch({"word": words, "n": pa.array(counts.sum(1).astype(np.int64)), "class": pa.array(own), "at": lists[0], "c": lists[1]}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_word, open_counts = None, np.zeros(k)
        for batch in batches:
            if not len(batch):
                continue
            words, left, n = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            fresh = np.concatenate([[True], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)])
            group, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            counts = np.bincount(group * k + left, weights=n, minlength=len(first) * k).reshape(-1, k)
            names = words.take(pa.array(first))
            if open_word is not None:
                if names[0].as_py() == open_word:
                    counts[0] += open_counts
                else:
                    yield out(pa.array([open_word]), open_counts[None, :])
            open_word, open_counts = names[-1].as_py(), counts[-1]
            if len(first) > 1:
                yield out(names.slice(0, len(first) - 1), counts[:-1])
        if open_word is not None:
            yield out(pa.array([open_word]), open_counts[None, :])

    return stage(rest.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(run, schema), "brown-rest")


def _rest_sums(rest: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Class pairs (before, own) and distinct words by class of the words outside the head."""
    schema = schema_of("cell int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k, np.int64)
        for batch in batches:
            own, at, c = batch.column(0).to_numpy().astype(np.int64), batch.column(1), batch.column(2)
            many = np.diff(at.offsets.to_numpy())
            cells = at.flatten().to_numpy().astype(np.int64) * k + np.repeat(own, many)
            total[: k * k] += np.bincount(cells, weights=c.flatten().to_numpy(), minlength=k * k).astype(np.int64)
            total[k * k :] += np.bincount(own, minlength=k)
        some = np.flatnonzero(total)
        yield arrow_batch({"cell": pa.array(some), "n": pa.array(total[some])}, schema)

    out = np.zeros(k * k + k, np.int64)
    for r in rest.select("class", "at", "c").mapInArrow(run, schema).groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out[: k * k].reshape(k, k), out[k * k :]


@dataclass
class Model:
    """What scoring needs besides the table of the words outside the head."""

    items: Items
    #: By item: the class of the context. By word of the head: its own class.
    context: np.ndarray
    classes: np.ndarray
    #: log10 P(class | context), (k, k).
    transition: np.ndarray
    #: By class: log10 of the emission denominator.
    emission: np.ndarray
    train_tokens: int
    vocabulary_size: int
    ends: int

    @property
    def base_floor(self) -> float:
        return float(np.log10(self.train_tokens + DELTA * (self.vocabulary_size + 1)))


def _log_model(pair: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = len(pair)
    transition = np.log10(pair + DELTA) - np.log10(pair.sum(1, keepdims=True) + DELTA * k)
    return transition, np.log10(pair.sum(0) + DELTA * (kinds + 1))


def fit(texts: DataFrame, item_count: int = ITEMS, classes: int = CLASSES, head: int = HEAD, sweep: bool = True) -> tuple[Model, DataFrame]:
    """A model of texts(text), and the staged table (word, n, class) of the training words outside the head.

    Without `sweep`, words that are no items of the sequential exchange keep the class of their ending.
    """
    vocabulary = stage(word_counts(texts), "brown-vocabulary")
    ends = texts.count()
    total = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    items = Items.of(frequent(vocabulary, head), item_count)
    discard(vocabulary)
    counts = bigram_counts(texts, items)
    of = exchange(counts, classes)
    k, heads, own = classes + 1, len(items.words), items.own
    one = np.zeros((items.size, k))
    one[np.arange(items.size), of] = 1
    # the class of each item, and distinct words by class, before the sweep
    kinds = np.bincount(of[items.item], minlength=k) if heads else np.zeros(k)
    transition, emission = _log_model(one.T @ counts @ one, kinds)
    found_lefts, found = context_counts(texts, items, of)
    lefts = np.zeros((heads + 1, k), np.int64)
    lefts[:, : found_lefts.shape[1]] = found_lefts
    own_class = of[items.item] if heads else np.zeros(0, np.int64)
    if sweep and heads > own:
        own_class = np.concatenate([own_class[:own], best_classes(lefts[own + 1 :].astype(float), transition, emission)])
    table = assign_rest(found.filter("word is not null").select("word", F.col("cell").alias("left"), "n"), of, transition, emission, sweep, 1 + own)
    pair, kinds = _rest_sums(table, k)
    pair, kinds = pair.astype(float), kinds + np.bincount(own_class, minlength=k)
    pair[:, 0] += lefts[0]
    np.add.at(pair.T, own_class, lefts[1:])
    transition, emission = _log_model(pair, kinds)
    discard(found)
    return Model(items, of, own_class, transition, emission, int(total["n"]) + ends, int(total["v"]) + (ends > 0), ends), table.select("word", "n", "class")


def score(docs: DataFrame, model: Model, table: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score (sums of log10 probabilities).

    Words of the head are scored where the text is read. Each other token goes, with its context, to a join with the
    table of words; frequent words never do, so no key of that join is hot. Null text is empty: its end alone is scored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_of("uid long, doc_id long, word string, context int, ending int, tokens long, known long, base double, own double")
    k = len(model.transition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        uid = TaskContext.get().partitionId() << 36
        base_log = np.log10(m.items.count + DELTA) - m.base_floor
        own_log = np.log10(m.items.count + DELTA) - m.emission[m.classes]
        end_known, end_log = int(m.ends > 0), float(np.log10(m.ends + DELTA)) - m.base_floor
        for batch in batches:
            ids = batch.column(0)
            for first, block in blocks(batch.column(1)):
                words, codes, sizes = coded(block)
                docs_here, at, item = np.repeat(np.arange(len(sizes)), sizes), *m.items.look_up(words)
                context = before(m.context[item[codes]], sizes)
                at_token = at[codes]
                known = at_token >= 0
                some, heads = docs_here[known], at_token[known]
                add = lambda values: np.bincount(some, weights=values, minlength=len(sizes))
                own = add(m.transition[context[: len(codes)][known], m.classes[heads]] + own_log[heads]) + m.transition[context[len(codes) :], 0]
                base = add(base_log[heads]) + end_log
                uids = uid + 1 + np.arange(len(sizes))
                uid += len(sizes)
                many = len(sizes)
                # no word begins with a space: the row of the text itself matches nothing
                yield arrow_batch({"uid": pa.array(uids), "doc_id": ids.slice(first, many), "word": pc.binary_join_element_wise("", pc.cast(pa.array(uids), pa.string()), " "), "context": pa.nulls(many, pa.int32()), "ending": pa.nulls(many, pa.int32()), "tokens": pa.array(sizes + 1), "known": pa.array(add(None).astype(np.int64) + end_known), "base": pa.array(base), "own": pa.array(own)}, schema)
                rare = np.flatnonzero(~known)
                many = len(rare)
                nothing, zero = pa.nulls(many, pa.int64()), pa.array(np.zeros(many))
                yield arrow_batch({"uid": pa.array(uids[docs_here[rare]]), "doc_id": nothing, "word": words.take(pa.array(codes[rare])), "context": pa.array(context[rare]), "ending": pa.array(m.context[item[codes[rare]]]), "tokens": pa.array(np.zeros(many, np.int64)), "known": pa.array(np.zeros(many, np.int64)), "base": zero, "own": zero}, schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
    met = rows.join(table, "word", "left")
    count = F.log10(F.coalesce("n", F.lit(0)) + F.lit(DELTA))
    own = F.coalesce("class", "ending")
    at = lambda values, place: F.element_at(F.array(*[F.lit(float(x)) for x in values]), (place + 1).cast("int"))
    is_token = F.col("context").isNotNull()
    return met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(F.col("n").isNotNull(), 1).otherwise(0)).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        F.sum(F.col("base") + F.when(is_token, count - F.lit(model.base_floor)).otherwise(F.lit(0.0))).alias("base_score"),
        F.sum(F.col("own") + F.when(is_token, at(model.transition.ravel(), F.col("context") * k + own) + count - at(model.emission, own)).otherwise(F.lit(0.0))).alias("score"),
    ).drop("uid")


def score_documents(docs: DataFrame, item_count: int = ITEMS, classes: int = CLASSES, head: int = HEAD, sweep: bool = True) -> DataFrame:
    """Learn from the documents outside the hold-out and score all of docs(doc_id, text), row by row.

    Rows with a null id are training rows. Without training rows every count is zero and scores stay finite.
    """
    held = crc_remainder(F.col("doc_id"), HOLD_OUT_MODULUS) == HOLD_OUT
    model, table = fit(docs.filter(~held).select(F.col("text").cast("string").alias("text")), item_count, classes, head, sweep)
    return score(docs, model, table).withColumn("held_out", held)
