"""Quality rules: an ordered decision list, learned by sequential covering from labelled statistics of documents.

Every rule is a conjunction of thresholds on a few interpretable ratios. Rules for label 0 are grown on two thirds of
the labelled rows (by information gain), pruned on the rest, and kept while they are right more often than not there;
the rows a rule covers leave, and the next rule is learned on what remains. The list is emitted as one ordered Spark
conditional expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import arrow_batch, schema_of, stage

#: Labelled rows that rules are learned from, at most: those with the least rank, a hash of their id.
MAX_ROWS = 20_000
#: Thresholds tried a feature; bounds of the list's and a rule's length: rows of label 0 that twelve rules do not cover are kept.
CUTS, MAX_RULES, MAX_CONDITIONS, PRUNE_SHARE = 24, 12, 4, 3
SYMBOLS = b"#*$%&|<>"
_TAILS = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(0x41, 0x5B))

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_digits", "n_adjacent", "n_distinct_words")


def repeated_words(words: list[bytes]) -> tuple[int, int, int]:
    """Words in three-word windows found twice or more (the first included), adjacent equal words, distinct words."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    size = len(numbers)
    adjacent = int((ids[1:] == ids[:-1]).sum())
    if len(words) < 4 or size == len(words):
        return 0, adjacent, size
    pairs = ids[:-1] * size + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)  # so that no product overflows, however many words there are
    _, at, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[at] > 1)
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[starts + k] = True
    return int(hit.sum()), adjacent, size


def statistics(data: bytes | None) -> tuple[int, ...]:
    """STATISTICS of a UTF-8 text; null has no words and one empty line."""
    data = data or b""
    words, lines = data.split(), data.split(b"\n")
    seen: set[bytes] = set()
    repeated = 0
    for line in lines:
        if line.strip():
            repeated += line in seen
            seen.add(line)
    windows, adjacent, distinct = repeated_words(words)
    count = lambda chars: len(data) - len(data.translate(None, chars))
    chars = sum(map(len, words)) - count(_TAILS)
    return len(words), chars, count(SYMBOLS), repeated, windows, len(lines), count(_UPPER), data.count(b"!"), count(b"0123456789"), adjacent, distinct


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS...) of docs(doc_id, text), row by row. A null text has no words and no lines with words: all are 0 but n_lines."""
    schema = schema_of("doc_id long, " + ", ".join(f"{x} long" for x in STATISTICS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x) for x in batch.column(1).to_pylist()], np.int64).reshape(-1, len(STATISTICS))
            yield arrow_batch({"doc_id": batch.column(0)} | {x: pa.array(rows[:, i].copy()) for i, x in enumerate(STATISTICS)}, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


#: What rules may test, by name, as expressions over STATISTICS.
FEATURES = {
    "words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: F.coalesce(F.try_divide((F.col("word_chars") - F.col("n_symbols") - F.col("n_exclaim")).cast("double"), F.col("n_words").cast("double")), F.lit(0.0)),
    "symbols_per_word": lambda: _share("n_symbols", "n_words"),
    "upper_share": lambda: _share("n_upper", "word_chars"),
    "exclaims_per_word": lambda: _share("n_exclaim", "n_words"),
    "digit_share": lambda: _share("n_digits", "word_chars"),
    "repeat_share": lambda: _share("n_repeat_words", "n_words"),
    "dup_line_share": lambda: _share("n_dup_lines", "n_lines"),
    "adjacent_share": lambda: _share("n_adjacent", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] > self.threshold if self.above else table[self.feature] <= self.threshold

    def column(self) -> Column:
        value = FEATURES[self.feature]()
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, table: dict[str, np.ndarray], size: int) -> np.ndarray:
    out = np.ones(size, bool)
    for condition in rule:
        out &= condition.holds(table)
    return out


def grow(table: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    """Add the condition of the largest information gain until the rule covers label 0 only."""
    rule, inside = (), np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best = (1e-9, None)
        for feature, values in cuts.items():
            for threshold in values:
                high = table[feature] > threshold
                for above, mask in ((True, high), (False, ~high)):
                    p, n = (inside & mask & bad).sum(), (inside & mask & ~bad).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-12:
                            best = (gain, Condition(feature, above, float(threshold)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(table)
    return rule


def prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float]:
    """The prefix of the rule that is worth most on rows it was not grown on, and its precision there."""
    best = ((-2.0, 0), (), 0.0)
    for k in range(1, len(rule) + 1):
        inside = covers(rule[:k], table, len(bad))
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        best = max(best, (((p - n) / (p + n) if p + n else -1.0, p), rule[:k], p / (p + n) if p + n else 0.0), key=lambda x: x[0])
    return best[1], best[2]


def learn(table: dict[str, np.ndarray], quality: np.ndarray, min_precision: float = 0.9, max_rules: int = MAX_RULES) -> list[Rule]:
    """An ordered list of at most max_rules rules for label 0; empty without labelled rows of both classes."""
    bad = np.asarray(quality) == 0
    if not bad.any() or bad.all():
        return []
    held = np.arange(len(bad)) % PRUNE_SHARE == PRUNE_SHARE - 1
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < max_rules and (left & bad & ~held).sum() >= 2:
        part = lambda rows: ({k: v[rows] for k, v in table.items()}, bad[rows])
        own, y = part(left & ~held)
        cuts = {k: np.unique(np.concatenate([np.quantile(v, np.linspace(0.02, 0.98, CUTS)), np.quantile(v[y], np.linspace(0.05, 0.95, CUTS))])) for k, v in own.items()}
        rule = grow(own, y, cuts)
        if not rule:
            break
        rule, precision = prune(rule, *part(left & held))
        if not rule or precision < min_precision:
            break
        rules.append(rule)
        left &= ~covers(rule, table, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_rules(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Rule]:
    """Rules from at most max_rows labelled documents of a statistics table. Repeated labels of a document: the least counts."""
    usable = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    known = usable.count()
    if known > max_rows:  # the rows of least rank are all below this cut, but for chance of no account: what meets on the driver is bounded
        usable = usable.filter(rank <= ceil((1 << 20) * (1.1 * max_rows + 1_000) / known))
    rows = stats.select(F.col("doc_id"), *[f().alias(f"f_{k}") for k, f in FEATURES.items()]).join(usable, "doc_id")
    chosen = rows.orderBy(rank, "doc_id", *[f"f_{k}" for k in FEATURES]).limit(max_rows).toPandas()
    return learn({k: chosen[f"f_{k}"].to_numpy(float) for k in FEATURES}, chosen["quality"].to_numpy())


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, STATISTICS, base_failed and kept of docs(doc_id, text): kept is false where the base rules fail, else the list's verdict.

    Null and empty texts have no words, so the base rules reject them. Without labels of both classes the list is
    empty and keeps. Repeated rows are judged one by one. The texts are read once; the statistics are staged.
    """
    stats = stage(with_statistics(docs), "rule-statistics")
    rules = learn_rules(stats, labels, max_rows)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))
