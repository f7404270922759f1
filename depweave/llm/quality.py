"""Quality classifier: Naive Bayes support vectors.

Features are indicators of byte n-grams, and of repeats (word and line n-grams that say one thing over and over, whatever
it is). Each is scaled by the log ratio of its smoothed shares in the two classes, a
linear hinge-loss model is fitted on the scaled, length-normalised vectors by dual coordinate descent. A logistic curve, fitted on out-of-fold margins, turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import arrow_batch, crc_remainder, discard, schema_of, stage, unused

#: Two-byte grams have a place each; three-byte grams are hashed to 2 ** TRI_BITS places behind them.
TRI_BITS = 18
#: Then come the repeats: a word, and a line, that stands so many times in a row.
REPEATS = (2, 3, 4, 6, 10)
REPEAT_AT = 65_536 + (1 << TRI_BITS)
SIZE = REPEAT_AT + 2 * len(REPEATS)
#: Added to the squared length of every vector, so that a few n-grams of a very short text are weak evidence.
DAMPING = 20.0
#: Labelled rows that are fitted on, at most, and n-grams of all of them together: the rows with the least hash of their id.
MAX_ROWS, MAX_PLACES = 6_000, 24_000_000
C, ALPHA, EPOCHS, FOLDS = 1.0, 1.0, 20, 3
HOLD_OUT_MODULUS, HOLD_OUT = 4, 2
THRESHOLD = 0.7
#: Bytes looked at together: bounds the memory that a very long text takes.
BLOCK = 1 << 20


def grams(data: bytes | None, seen: np.ndarray) -> np.ndarray:
    """The rising places of the n-grams in a text. `seen` is a scratch array of SIZE zeros and is left so."""
    raw = np.frombuffer(data or b"", np.uint8)
    for i in range(0, max(len(raw) - 1, 0), BLOCK):
        part = raw[i : i + BLOCK + 2].astype(np.uint32)
        two = (part[:-1] << 8) | part[1:]
        seen[two] = True
        if len(part) > 2:
            three = (two[:-1] << 8) | part[2:]
            seen[65_536 + ((three * np.uint32(2654435761)) >> np.uint32(32 - TRI_BITS))] = True
    for kind, parts in enumerate(((data or b"").split(), [x for x in (data or b"").split(b"\n") if x])):
        run = _longest_run(parts)
        for k, least in enumerate(REPEATS):
            if run >= least:
                seen[REPEAT_AT + len(REPEATS) * kind + k] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


def _longest_run(parts: list[bytes]) -> int:
    """How often the same part stands in a row, at most."""
    same = list(map(eq, parts, islice(parts, 1, None)))
    if True not in same:
        return min(len(parts), 1)
    breaks = np.flatnonzero(~np.array([False, *same, False]))
    return int(np.diff(breaks).max())


@dataclass
class Model:
    """Weights and squared scales by place; margin = sum(weight) / sqrt(sum(scale ** 2) + DAMPING) + bias."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, places: np.ndarray) -> float:
        norm = float(self.square[places].sum()) + DAMPING
        return float(self.weight[places].sum()) / norm**0.5 + self.bias

    def score(self, places: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(places) + self.offset, -40, 40))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log ratio of the shares of label 1 and label 0 that have an n-gram. ALPHA rows, of either label as often as in the
    data, are added with each n-gram: one that was never seen is no evidence, however few rows a label has."""
    size, share = (labels > 0).sum(), (labels > 0).mean()
    sums = [np.zeros(SIZE), np.zeros(SIZE)]
    for places, y in zip(rows, labels, strict=True):
        sums[int(y > 0)][places] += 1
    return np.log((sums[1] + ALPHA * share) / (size + ALPHA)) - np.log((sums[0] + ALPHA * (1 - share)) / (len(labels) - size + ALPHA))


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + C sum max(0, 1 - y w x): one dual variable at a time, each kept in [0, C]."""
    rng, w, bias = np.random.default_rng(seed), np.zeros(SIZE), 0.0
    values = [ratio[p] / np.sqrt((ratio[p] ** 2).sum() + DAMPING) for p in rows]
    alpha, norm = np.zeros(len(rows)), np.array([float(v @ v) + 1 for v in values])
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = labels[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), C)
            if (step := (new - alpha[i]) * labels[i]) != 0:
                w[rows[i]] += step * values[i]
                bias += step
                moved, alpha[i] = moved + abs(step), new
        if moved < 1e-4 * len(rows):
            break
    return w, bias


def _logistic(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps on smoothed targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x = np.column_stack([margins, np.ones(len(margins))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        slope = x.T @ (p - target) + np.array([1e-3 * a, 0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-6
        step = np.linalg.solve(curve, slope)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], quality: np.ndarray) -> Model:
    """A model from feature rows and labels 0/1. Without rows of both classes every score is the smoothed share of label 1."""
    labels = np.where(np.asarray(quality) > 0, 1.0, -1.0)
    if len(labels) == 0 or abs(labels.sum()) == len(labels):
        share = (np.sum(labels > 0) + 1) / (len(labels) + 1)
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 0.0, float(np.log(share / max(1 - share, 1e-9))))

    def one(keep: np.ndarray) -> Model:
        own, y = [rows[i] for i in keep], labels[keep]
        ratio = log_count_ratio(own, y)
        w, bias = dual_coordinate_descent(own, y, ratio)
        return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, 1.0, 0.0)

    fold, margins = np.arange(len(rows)) % FOLDS, np.zeros(len(rows))
    for k in range(FOLDS):
        part = one(np.flatnonzero(fold != k))
        margins[fold == k] = [part.margin(rows[i]) for i in np.flatnonzero(fold == k)]
    out = one(np.arange(len(rows)))
    out.slope, out.offset = _logistic(margins, labels > 0)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_places: int = MAX_PLACES) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of labelled documents outside the hold-out. Repeated labels of a document: the least counts.

    At most max_rows documents by the hash of their id, and of their rows as many as hold max_places n-grams together
    (at least one): what meets on the driver is bounded also where texts are very long. Rows are ordered by id.
    """
    usable = labels.filter("doc_id is not null and quality is not null").filter(crc_remainder(F.col("doc_id"), HOLD_OUT_MODULUS) != HOLD_OUT)
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    picked = {r["doc_id"]: (k, int(r["quality"])) for k, r in enumerate(chosen.collect())}
    if not picked:
        return [], np.zeros(0)
    wanted = docs.filter("text is not null").join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in picked], "doc_id long")), "doc_id", "left_semi")
    schema = schema_of("doc_id long, n int, mark long, places array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SIZE, bool)
        for batch in batches:
            places = [grams(x, seen).astype(np.int32) for x in batch.column(1).to_pylist()]
            marks = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in places], np.uint64).view(np.int64)
            yield arrow_batch({"doc_id": batch.column(0), "n": [len(x) for x in places], "mark": pa.array(marks), "places": places}, schema)

    found = stage(wanted.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema), "quality-rows")
    # repeated rows of a document are rows of their own here as well; the bound on rows holds for them too
    heads = found.select("doc_id", "n", "mark").orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(max_rows).collect()
    heads.sort(key=lambda r: (picked[r["doc_id"]][0], r["mark"]))
    upto = np.cumsum([r["n"] for r in heads])
    last = heads[max(int(np.searchsorted(upto, max_places, side="right")), 1) - 1] if heads else None
    kept = {r["doc_id"] for r in heads if last is not None and picked[r["doc_id"]][0] <= picked[last["doc_id"]][0]}
    table = found.filter(F.col("doc_id").isin(list(kept))) if len(kept) < len({r["doc_id"] for r in heads}) else found
    rows = table.select("doc_id", "mark", "places").toArrow().combine_chunks()
    discard(found)
    order = sorted(range(len(rows)), key=lambda i: (rows["doc_id"][i].as_py(), rows["mark"][i].as_py()))[:max_rows]
    if not order:
        return [], np.zeros(0)
    lists = rows["places"].chunk(0)
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    ids = rows["doc_id"].to_pylist()
    return [flat[ends[i] : ends[i + 1]] for i in order], np.array([picked[ids[i]][1] for i in order])


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs plus a score in [0, 1] of each whole text; null texts count as empty. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, seen = sent.value, np.zeros(SIZE, bool)
        for batch in batches:
            yield pd.Series([own.score(grams(x, seen)) for x in batch], dtype="float64")

    return docs.withColumn(column, run(F.col("text").cast("binary")))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...) plus held_out, score and predicted (1 from `threshold` on).

    Learned from `labels`(doc_id, quality) outside the hold-out only; nothing but the text enters a score.
    """
    model = fit(*training_rows(docs.select("doc_id", "text"), labels, max_rows))
    plain = docs.drop("held_out", "score", "predicted")  # an earlier column of such a name is replaced
    out = score(plain, model).withColumn("held_out", crc_remainder(F.col("doc_id"), HOLD_OUT_MODULUS) == HOLD_OUT)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns as they were."""
    model = fit(*training_rows(docs.select("doc_id", "text"), labels))
    name = unused(docs, "__score")
    return score(docs, model, name).filter(F.col(name) >= threshold).select(*docs.columns)
