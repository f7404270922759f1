"""Each operator against a brute-force version on a small corpus with nulls, empty texts, ties, repeated rows and clashing columns."""

import random
import re
import zlib
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from depweave.llm import brown, chat, common, decontam, html, linededup, packing, quality, rules, simhash, urls
from depweave.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPLIT.split((text or "").translate(LOWER)) if w]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    base = ["alpha", "Beta", "gamma", "DELTA", "über", "naïve", "one", "two", "three", "four", "five", "six,", "seven.", "x"]
    line = lambda n: " ".join(rng.choice(base) for _ in range(n))
    texts = ["\n".join(line(rng.randint(1, 25)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    long = line(4000)
    texts += [texts[0], texts[0], texts[1] + " tail", None, "", "   \n\t ", "x", "Short Line Shared\n" + texts[2], " short line shared \t\nother", "a\r\nb\x0bc", long, long + " z"]
    return list(enumerate(texts)) + [(3, texts[3]), (None, "null id text here is long enough"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", 1, 9.5) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score double")


def brute_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_fingerprint(corpus):
    for _, text in corpus[-16:]:
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_simhash(docs, corpus, empty):
    fps = [brute_fingerprint(t) for _, t in corpus]
    root = list(range(len(fps)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root[find(j)] = find(i)
    ids = {}
    for k, (i, _) in enumerate(corpus):
        ids.setdefault(find(k), []).append(i)
    want = sorted((str(i), f"{fps[k]:016x}", str(min((x for x in ids[find(k)] if x is not None), default=None))) for k, (i, _) in enumerate(corpus))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc"]), f"{r['fp'] & (1 << 64) - 1:016x}", str(r["component"])) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_posting_lists_large_and_small_agree():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 16, 3000).astype(np.uint64) << np.uint64(8)).view(np.int64)
    size = len(values)
    assert size > 512

    def parts(links):
        root = {int(v): int(v) for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(b)] = find(a)
        return {v: find(v) for v in root}

    raw = values.view(np.uint64)
    plain = [(int(values[i]), int(values[j])) for i in range(size) for j in np.flatnonzero(np.bitwise_count(raw[i + 1 :] ^ raw[i]) <= 2) + i + 1]
    left, right = parts(simhash.list_links(values, 2)), parts(plain)
    assert len(set(left.values())) == len(set(right.values()))
    assert len(simhash.list_links(values, 2)) < size


def test_tally_counts_shared_positional_bytes():
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(50)] + [0, (1 << 64) - 1]
    got = simhash.shared_bytes(np.array(values, np.uint64), np.uint64(values[3]))
    assert got.tolist() == [sum((v >> 8 * k & 255) == (values[3] >> 8 * k & 255) for k in range(8)) for v in values]


def test_every_pair_within_two_bits_meets():
    masks = [m & (1 << 64) - 1 for m in simhash._masks(2)]
    rng = random.Random(2)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any(a & m == b & m for m in masks)


def test_keep_first(docs, corpus):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len({r["doc_id"] for r in rows if r["doc_id"] is not None}) == len([r for r in rows if r["doc_id"] is not None])
    assert 0 in {r["doc_id"] for r in rows} and not {40, 41} & {r["doc_id"] for r in rows}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (3, 1), (9, 8), (8, 6)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 8: 6, 9: 6}
    path = spark.range(200).selectExpr("id u", "id + 1 v")
    assert {r["root"] for r in connected_components(path).collect()} == {0}
    assert connected_components(edges.limit(0)).count() == 0


def brute_lines(corpus, batches=None):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    last = 1 << 70
    owner = {}
    for i, t in corpus:
        for x in (t or "").split("\n"):
            i2 = last if i is None else i
            owner[key(x)] = min(owner.get(key(x), i2), i2)
    out = []
    for i, t in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == (last if i is None else i)]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup(docs, corpus, empty, batches, fanout):
    got = linededup.dedup_lines(docs, batches=batches, fanout=fanout)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute_lines(corpus)
    assert linededup.dedup_lines(empty).count() == 0
    clash = docs.withColumn("N_LINES", F.lit("x"))
    assert [c for c in linededup.dedup_lines(clash).columns if c.lower() == "n_lines"] == ["n_lines"]


def test_runs_hold_each_key_once(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(10 * b + d, k, 0) for d in range(3) for k in (0, b, b + 1)], "doc long, h1 long, h2 long"))
    plan = runs.spark.table(runs.names()[0]).join(runs.spark.table(runs.names()[-1]).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    table = runs.table()
    assert {(r["h1"], r["owner"]) for r in table.collect()} == {(0, 0), (1, 0), (2, 10), (3, 20), (4, 30), (5, 40)} and table.count() == 6
    assert sum(len(level) for level in runs.levels) <= 3
    runs.close()
    assert not spark.catalog.listTables() and runs.table().count() == 0


def brute_windows(corpus, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = {}
    for i, t in items:
        w = pattern.findall((t or "").translate(LOWER))
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if k and i is not None else 0):
            found.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    out = []
    for i, t in corpus:
        w = pattern.findall((t or "").translate(LOWER))
        hit, own = set(), set()
        for k in {len(x) for x in found}:
            for j in range(len(w) - k + 1):
                if f := found.get(tuple(w[j : j + k])):
                    own |= f
                    hit |= set(range(j, j + k))
        out.append((str(i), len(w), sorted(hit), sorted(own)))
    return sorted(out)


@pytest.mark.parametrize("block", [8_000_000, 150])
def test_decontamination(spark, docs, corpus, empty, block):
    flat = corpus[5][1].replace("\n", " ").split()
    items = [(1, " ".join(flat[:13])), (2, "Short, line! shared"), (3, None), (4, ""), (None, "x"), (5, corpus[6][1]), (6, "!!"), (10, "Short line SHARED")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.scan(docs, bench, block_bytes=block).collect()
    assert sorted((str(r["doc_id"]), r["__found"]["n_words"], r["__found"]["hit"], r["__found"]["items"]) for r in got) == brute_windows(corpus, items)
    assert decontam.scan(empty, bench).count() == 0 and decontam.scan(docs, bench.limit(0)).filter(F.size("__found.hit") > 0).count() == 0
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_hits(docs, bench, "text").collect()}
    assert cut[48] == "  \t\nother" and cut[5] != corpus[5][1] and cut[44] == ""


def test_window_index_is_small_and_exact():
    rng = random.Random(1)
    texts = [(str(i), " ".join(f"w{rng.randrange(50_000)}" for _ in range(200)).encode()) for i in range(500)]
    texts += [("again", texts[0][1]), ("0", texts[0][1]), ("short", b"w1 w2")]
    index = decontam.WindowIndex.build(texts)
    assert index.nbytes < 40 * sum(len(decontam.words_of(t)) for _, t in texts)
    hit, items = index.scan(decontam.words_of(b"x y " + texts[0][1] + b" z"))
    assert hit.tolist()[:200] == list(range(2, 202)) and items >= {"0", "again"}
    assert index.scan(decontam.words_of(b" ".join(texts[3][1].split()[5:17]))) [1] <= {"short"}
    assert decontam.WindowIndex.build([]).scan([b"a"])[1] == set()


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """Where hashes of different windows collide, the index hashes another way."""
    real, calls = decontam.WindowIndex.mixed, []

    def weak(self, ids, starts, size):
        calls.append(self.seed)
        return real(self, ids, starts, size) % np.uint64(2) if self.seed == 0 else real(self, ids, starts, size)

    monkeypatch.setattr(decontam.WindowIndex, "mixed", weak)
    index = decontam.WindowIndex.build([("1", b"a b c d e"), ("2", b"f g h i j")], window=2)
    assert set(calls) == {0, 1} and index.scan([b"x", b"g", b"h"])[1] == {"2"}


def test_ids_equal_the_library(monkeypatch):
    files = packing.tokenizer_files()
    own = packing.Ids(**files)
    rng = random.Random(4)
    texts = ["", " ", "  a", "a  b\n c", "a \n b", "don't 've <|endoftext|> x", " <|endoftext|>", "\n\n a\t b", "a b 　c", "é ü  ß", "x" * 300, "tail ", "tail  ", "12 3.4  %% a", "\x1c a \x1c b", "a\x85 b"]
    texts += ["".join(rng.choice(["a", " ", "\n", "'s", "é", "1", "%", "  ", "\t", "b c"]) for _ in range(60)) for _ in range(300)]
    texts += [" ".join(texts) * 40, "word " * 30_000 + "end"]
    want = [own.slow.encode(t, add_special_tokens=False).ids for t in texts]
    for block in (packing.BLOCK, 2000):
        monkeypatch.setattr(packing, "BLOCK", block)
        for ids, wanted, t in zip(own.many(pa.array([*texts, None])), [*want, []], [*texts, None], strict=True):
            assert ids.tolist() == wanted, repr(t)[:80]


def test_packing(spark, docs, corpus, empty):
    slow = packing.Ids(**packing.tokenizer_files()).slow
    rows = packing.pack_documents(docs, capacity=64).collect()
    have = {}
    for i, t in corpus:
        ids = slow.encode(t or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            have.setdefault(str(i), []).append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]))
    got = {}
    for r in rows:
        got.setdefault(str(r["doc_id"]), []).append((r["piece"], r["start"], r["length"], r["ids_crc32"], list(r["ids"])))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in have.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 64) + 2
    assert packing.pack_documents(empty).count() == 0


def test_genetic_steps_keep_all_pieces():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1024, 500).tolist()
    first = packing.best_fit(sizes, list(range(500)), [], 1024)
    second = packing.best_fit(sizes, sorted(range(500), key=lambda i: -sizes[i]), [], 1024)
    parents = [packing.Packing.of(sizes, x) for x in (first, second)]
    before = [[list(b) for b in x] for x in (first, second)]
    children = [packing.crossover(sizes, *parents, 1024, rng), packing.mutate(sizes, parents[0], 1024, rng)]
    assert all(x.filled == [sum(sizes[i] for i in b) for b in x.bins] for x in children) and [first, second] == before
    for bins in (first, second, *(x.bins for x in children), packing.evolve(sizes, [first], 1024, 1)):
        assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(sizes[i] for i in b) <= 1024 for b in bins)
    assert len(packing.evolve(sizes, [first, second], 1024, 1)) <= min(len(first), len(second))
    assert packing.evolve([], [], 1024, 1) == [] and packing.lower_bound([], 1024) == 0


def hard_sizes(kind, rng):
    """Pieces that best-fit-decreasing does not pack as well as can be."""
    if kind == "uniform":
        return rng.integers(100, 700, 1000).tolist()
    if kind == "wide":
        return rng.integers(1, 1024, 1000).tolist()
    out = []
    for _ in range(80):  # triplets that fill a bin to the last place
        a = int(rng.integers(389, 500))
        b = int(rng.integers(256, (1024 - a) // 2 + 1))
        out += [a, b, 1024 - a - b]
    return out


@pytest.mark.parametrize("kind", ["uniform", "triplets"])
def test_breeding_beats_best_fit_decreasing(kind):
    sizes = hard_sizes(kind, np.random.default_rng(5))
    plain = packing.best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), [], 1024)
    bred = packing.evolve(sizes, [], 1024, 1)
    assert packing.lower_bound(sizes, 1024) <= len(bred) < len(plain)


def test_lower_bound():
    assert packing.lower_bound([600, 600, 600], 1024) == 3 and packing.lower_bound([512, 512, 1], 1024) == 2 and packing.lower_bound([700, 400, 400], 1024) == 2
    for kind in ("uniform", "wide", "triplets"):
        sizes = hard_sizes(kind, np.random.default_rng(9))
        assert -(-sum(sizes) // 1024) <= packing.lower_bound(sizes, 1024) <= len(packing.evolve(sizes, [], 1024, 2))


def test_packing_beats_best_fit_decreasing(spark):
    """The whole operator, on pieces where one pass of best-fit-decreasing stays above the bound."""
    sizes = hard_sizes("uniform", np.random.default_rng(5))
    table = spark.createDataFrame([(i, 0, 0, x, 0, i, None) for i, x in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, sequence_id long")
    rows = packing.pack(table, 1024).collect()
    assert sorted(r["length"] for r in rows) == sorted(sizes)
    plain = packing.best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), [], 1024)
    assert len({r["sequence_id"] for r in rows}) < len(plain)


def brute_statistics(text):
    w = [x for x in SPLIT.split(text or "") if x]
    lines = (text or "").split("\n")
    seen, dup = set(), 0
    for x in lines:
        if [y for y in SPLIT.split(x) if y]:
            dup += x in seen
            seen.add(x)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_rule_statistics(corpus):
    more = ["a b a b a b", "a a a a", "x x x", "# | <é> && a\na\na\n \n ", "a b c d a b c", "w " * 3000]
    for text in [t for _, t in corpus] + more:
        assert rules.statistics(None if text is None else text.encode())[:5] == brute_statistics(text)


def labelled(spark, n=400):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, marks = [], []
    for i in range(n):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(55, 160))]
        bad = i % 5 == 0
        if bad:
            body = [w.upper() + "!!" for w in body] if i % 10 else [w + rng.choice(["***", "%%%"]) for w in body]
        rows.append((i, " ".join(body)))
        marks.append((i, int(not bad)))
    labels = spark.createDataFrame(marks + [(0, 1), (None, 0), (7, None)], "doc_id long, quality int")
    return spark.createDataFrame(rows + [(n, None), (n + 1, ""), (None, "text without an id")], "doc_id long, text string"), labels


def test_quality_rules(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in rules.apply_rules(docs, labels).collect()}
    assert sum(got[i]["kept"] == (i % 5 != 0) for i in range(400)) >= 396
    assert got[400]["base_failed"] and not got[400]["kept"] and got[401]["n_words"] == 0
    assert rules.apply_rules(docs, labels.limit(0)).filter("not base_failed and not kept").count() == 0
    assert rules.apply_rules(docs.limit(0), labels).count() == 0


def test_decision_list_reads_as_rules():
    table = {"symbols_per_word": np.array([0.0, 0.0, 2.0, 3.0] * 30), "words": np.array([60.0, 90.0, 70.0, 80.0] * 30)}
    found = rules.learn(table, np.array([1, 1, 0, 0] * 30))
    assert [str(c) for r in found for c in r] and found[0][0].feature == "symbols_per_word" and found[0][0].above
    assert rules.learn(table, np.ones(120)) == [] and rules.learn({k: v[:0] for k, v in table.items()}, np.zeros(0)) == []


def test_kept_follows_the_learned_list_on_brute_statistics(spark):
    """`kept` of every row, from statistics counted the plain way and the list read rule by rule."""
    docs, labels = labelled(spark)
    docs = docs.unionByName(spark.createDataFrame([(7, "again"), (900, "word " * 30_000), (901, "## a b c\n" * 40)], "doc_id long, text string"))
    stats = rules.with_statistics(docs)
    learned = rules.learn_rules(stats, labels)
    assert learned
    rows = {(r["doc_id"], r["text"]): r["text"] for r in docs.collect()}
    found = sorted((str(r["doc_id"]), r["kept"], r["base_failed"]) for r in rules.apply_rules(docs, labels).collect())
    values = {}
    for r in stats.select("doc_id", "n_words", *[f().alias(f"f_{k}") for k, f in rules.FEATURES.items()]).collect():
        values.setdefault(str(r["doc_id"]), []).append(r)
    want = []
    for (doc, text) in rows:
        n, *_, repeated = brute_statistics(text)
        failed = n < 50 or 100 * repeated > 50 * n
        mine = next(r for r in values[str(doc)] if r["n_words"] == n)
        hit = any(all((mine[f"f_{c.feature}"] > c.threshold) == c.above for c in rule) for rule in learned)
        want.append((str(doc), not failed and not hit, failed))
    assert found == sorted(want)


def plain_grams(text):
    """The places of a text's features, byte by byte."""
    data = (text or "").encode()
    out = {data[i] * 256 + data[i + 1] for i in range(len(data) - 1)}
    for i in range(len(data) - 2):
        three = (data[i] * 256 + data[i + 1]) * 256 + data[i + 2]
        out.add(65_536 + ((three * 2654435761) % (1 << 32) >> (32 - quality.TRI_BITS)))
    for kind, parts in enumerate((data.split(), [x for x in data.split(b"\n") if x])):
        run = max((len(list(g)) for _, g in groupby(parts)), default=0)
        out |= {quality.REPEAT_AT + len(quality.REPEATS) * kind + k for k, least in enumerate(quality.REPEATS) if run >= least}
    return out


def test_scores_follow_the_model(spark, corpus):
    """Every score from the model's weights and features found the plain way; very long and repeated texts too."""
    docs, labels = labelled(spark)
    model = quality.fit(*quality.training_rows(docs, labels))
    some = [t for _, t in corpus] + ["ab " * 200_000, "x", "a a a a a a a a a a a\n\nb\nb"]
    got = quality.score(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), model).collect()
    for r in got:
        places = np.array(sorted(plain_grams(some[r["doc_id"]])), int)
        margin = model.weight[places].sum(dtype=float) / np.sqrt(model.square[places].sum(dtype=float) + quality.DAMPING) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))), abs=1e-4)


def test_dual_coordinate_descent_reaches_the_optimum():
    """The primal value of the weights is within one percent of the dual value: no weights are much better."""
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(60) < (0.3 if i % 2 else 0.5)) + 100 for i in range(80)]
    y = np.where(np.arange(80) % 2, 1.0, -1.0)
    ratio = quality.log_count_ratio(rows, y)
    values = [ratio[p] / np.sqrt((ratio[p] ** 2).sum() + quality.DAMPING) for p in rows]
    w, bias = quality.dual_coordinate_descent(rows, y, ratio)
    margins = np.array([w[p] @ v + bias for p, v in zip(rows, values, strict=True)])
    primal = (w @ w + bias**2) / 2 + quality.C * np.maximum(0, 1 - y * margins).sum()
    better = []
    for _ in range(300):  # small steps in any direction do not lower it by more than that
        step = rng.normal(size=60) * 0.01
        own, b = w.copy(), bias + rng.normal() * 0.01
        own[100:160] += step
        m = np.array([own[p] @ v + b for p, v in zip(rows, values, strict=True)])
        better.append((own @ own + b**2) / 2 + quality.C * np.maximum(0, 1 - y * m).sum())
    assert min(better) >= primal * 0.99


def test_quality_classifier(spark):
    docs, labels = labelled(spark)
    docs = docs.withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(400))
    assert sum(got[i]["predicted"] == int(i % 5 != 0) for i in held) >= len(held) - 1
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not got[None]["held_out"]
    flipped = labels.withColumn("quality", F.when(common.crc_remainder(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs, flipped).collect()}
    assert again == {k: r["score"] for k, r in got.items()}
    assert quality.classify(docs, labels.limit(0)).filter("predicted = 1").count() == docs.count()
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_training_rows_are_bounded(spark):
    """Very long texts and repeated rows: the rows handed on stay within both bounds, by the same order every time."""
    docs = spark.createDataFrame([(i, f"{i} " + "abcdefghij klmnop "[i % 7 :] * (20_000 if i == 3 else 5)) for i in range(60)] + [(5, "again"), (5, "again"), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    every, y = quality.training_rows(docs, labels)
    usable = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(every) == len(usable) + 2 * (5 in usable) and len(y) == len(every)
    some, _ = quality.training_rows(docs, labels, max_places=300)
    assert 0 < len(some) < len(every) and sum(map(len, some)) <= 300 + max(map(len, every))
    assert len(quality.training_rows(docs, labels, max_rows=7)[0]) <= 7
    assert quality.classify(docs, labels).count() == docs.count()


def test_longest_runs():
    assert [quality._longest_run(x) for x in ([], [b"a"], [b"a", b"b"], [b"a", b"a"], [b"b", b"a", b"a", b"a", b"c", b"c"])] == [0, 1, 1, 2, 3]


def test_dual_coordinate_descent_separates():
    seen = np.zeros(quality.SIZE, bool)
    rows = [quality.grams(x, seen) for x in (b"aaa bbb", b"aab bbb", b"zzz yyy", b"zzy yyy")]
    y = np.array([1.0, 1.0, -1.0, -1.0])
    w, bias = quality.dual_coordinate_descent(rows, y, quality.log_count_ratio(rows, y))
    ratio = quality.log_count_ratio(rows, y)
    assert all(np.sign((w[r] * ratio[r]).sum() + bias) == s for r, s in zip(rows, y, strict=True))
    assert not seen.any()


def test_language_model(docs, corpus, empty):
    got = sorted(((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["held_out"], round(r["base_score"], 6)) for r in brown.score_documents(docs, item_count=5, classes=3, head=8).collect()))
    train = [words(t) for i, t in corpus if i is None or zlib.crc32(str(i).encode()) % 10 != 0]
    counts = {}
    for w in train:
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    n, v, ends = sum(counts.values()) + len(train), len(counts) + 1, len(train)
    want = []
    for i, t in corpus:
        c = [counts.get(x, 0) for x in words(t)] + [ends]
        base = sum(np.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c)
        want.append((str(i), len(c), sum(x > 0 for x in c), i is not None and zlib.crc32(str(i).encode()) % 10 == 0, round(float(base), 6)))
    assert got == sorted(want)
    assert brown.score_documents(empty).count() == 0


def two_classes(rng, most=40, nouns=8, verbs=8):
    return [" ".join(f"n{rng.randrange(nouns)}x{k % 3}" if k % 2 else f"v{rng.randrange(verbs)}y{k % 3}" for k in range(most)) for _ in range(80)]


@pytest.mark.parametrize("head,items", [(400, 400), (60, 12), (12, 12), (0, 0)])
def test_class_model_is_a_distribution_and_scores_by_it(spark, head, items):
    """Every training word, in the head or not, has a class; probabilities add up to one; scores follow the definition."""
    texts = two_classes(random.Random(6), nouns=20, verbs=20)
    model, table = brown.fit(spark.createDataFrame([(t,) for t in texts], "text string"), item_count=items, classes=3, head=head)
    counts = {}
    for t in texts:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    of = {w.as_py(): int(c) for w, c in zip(model.items.words, model.classes, strict=True)}
    rest = {r["word"]: r for r in table.collect()}
    assert {w: r["n"] for w, r in rest.items()} == {w: n for w, n in counts.items() if w not in of} and len(of) == min(head, len(counts))
    of |= {w: r["class"] for w, r in rest.items()}
    assert np.allclose((10**model.transition).sum(1), 1)
    for c in set(of.values()):  # known words of a class, and one unknown, share its mass
        own = [n for w, n in counts.items() if of[w] == c]
        assert np.log10(sum(own) + brown.DELTA * (len(own) + 1)) == pytest.approx(model.emission[c])

    def item(w):
        at, found = model.items.look_up(pa.array([w]))
        return int(found[0])

    for text in ("v1y0 n2x1 v3y2 new", "N2X1 v1y0\tnew2  n3x2", ""):
        total, ctx = 0.0, 0
        for w in words(text):
            c = of.get(w, int(model.context[item(w)]))
            total += model.transition[ctx, c] + np.log10(counts.get(w, 0) + 0.1) - model.emission[c]
            ctx = int(model.context[item(w)])
        row = brown.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, table).first()
        assert row["score"] == pytest.approx(total + model.transition[ctx, 0])


def test_rare_words_move_to_their_class(spark):
    """Words outside the items, whose ending says nothing, end in the class of their neighbours; the held-out score gains by it."""
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["the", "a"]) + f" n{rng.randrange(150)}z " + rng.choice(["we", "they"]) + f" v{rng.randrange(150)}z" for _ in range(12))
    docs = spark.createDataFrame([(i, line()) for i in range(200)], "doc_id long, text string")
    train = docs.select("text")
    gained = []
    for sweep in (False, True):
        model, table = brown.fit(train, item_count=4, classes=4, head=20, sweep=sweep)
        rows = brown.score_documents(docs, item_count=4, classes=4, head=20, sweep=sweep).filter("held_out").collect()
        gained.append(sum(r["score"] for r in rows))
        assert gained[-1] > sum(r["base_score"] for r in rows)
    found = {r["word"]: r["class"] for r in table.collect()}
    nouns, verbs = ({c for w, c in found.items() if w[0] == x} for x in "nv")
    assert len(nouns) == 1 and len(verbs) == 1 and nouns != verbs
    assert gained[1] > gained[0] + 50


def test_frequent_words_with_flat_counts(spark):
    table = spark.createDataFrame([(f"w{i}", 3) for i in range(50)] + [("top", 9)], "word string, n long")
    assert len(brown.frequent(table, 20)) == 20 and brown.frequent(table, 20)[0] == ("top", 9)
    assert brown.frequent(table, 20) == brown.frequent(table.repartition(3), 20) and len(brown.frequent(table, 100)) == 51 and brown.frequent(table.limit(0), 5) == []


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 6, (30, 30))

    def likelihood(of):
        one = np.zeros((30, of.max() + 1))
        one[np.arange(30), of] = 1
        p = one.T @ counts @ one
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(p) - f(p.sum(0)) - f(p.sum(1))

    start = np.concatenate([[0], np.arange(29) % 4 + 1])
    values = [likelihood(brown.exchange(counts, 4, s)) for s in (1, 2, 6)]
    assert values == sorted(values) and values[-1] >= likelihood(start) and (brown.exchange(counts, 4)[0] == 0)


def test_urls(spark):
    table = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    page = lambda i, u, h="": (i, u, h)
    rows = [
        page(1, "http://a.example.com/en/x?y"), page(2, "HTTP://WWW.Example.COM/en/"), page(3, "https://x.net/es/1"), page(4, "https://x.net/de/1", '<link rel="canonical" href="https://x.net/es/1">'),
        page(5, "https://y.org/a", "<meta http-equiv=refresh content='0;url=https://x.net/de/1#z'>"), page(6, None, None), page(7, "no scheme"), page(8, "https://z.org/q", "<link href='/r' rel=canonical>"),
        page(9, "https://b.com/ok", '<link rel="canonical" href="https://x.net/es/1">'), page(10, "https://w.org/", None), page(10, "https://w.org/", None), page(11, "http://com"), page(12, "https://notexample.com/en/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("https://w.org/", "https://y.org/a"), (None, "x")], "source string, target string")
    for given in (table, spark.createDataFrame(table, "verdict string, host string, path string")):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, given, redirects).collect()}
        assert got == {
            1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("x.net", "/es/1", "net/es/", "block"), 4: ("x.net", "/de/1", None, "block"),
            5: ("y.org", "/a", None, "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("z.org", "/q", None, "allow"), 9: ("b.com", "/ok", "com/", "allow"), 10: ("w.org", "/", None, "block"),
            11: ("com", "", None, "allow"), 12: ("notexample.com", "/en/", "com/", "allow"),
        }
    assert urls.judge(pages, table, redirects).count() == len(rows)
    assert urls.judge(pages.limit(0), table).count() == 0 and urls.judge(pages, []).filter("verdict = 'block'").count() == 0


def test_url_spellings(spark):
    same = ["https://x.net/a/q", "HTTPS://X.net:443/a/q", "https://x.net/a/./q#f", "https://x.net/b/../a/q", "https://x.net/../a/q"]
    roots = ["http://x.net", "http://x.net/", "http://X.NET:80", "http://x.net:/#z", "http://x.net/a/..", "http://x.net/."]
    other = ["http://x.net:8080/", "https://x.net/a/q?", "https://x.net/a/q/", "http://x.net?q", "http://x.net//"]
    rows = spark.createDataFrame([(u,) for u in same + roots + other], "u string").select("u", urls.node_of(F.col("u")).alias("n")).collect()
    got = {r["u"]: r["n"] for r in rows}
    assert {got[u] for u in same} == {"https://x.net/a/q"} and {got[u] for u in roots} == {"http://x.net/"}
    assert [got[u] for u in other] == ["http://x.net:8080/", "https://x.net/a/q?", "https://x.net/a/q/", "http://x.net/?q", "http://x.net//"]
    page = "https://h.org/a/b?c#d"
    cases = {"../q": "https://h.org/q", "./q": "https://h.org/a/q", "q": "https://h.org/a/q", "?z": "https://h.org/a/b?z", "": "https://h.org/a/b?c", "#x": "https://h.org/a/b?c", "//o.net": "https://o.net/", "/r": "https://h.org/r", "http://p.q": "http://p.q/", "mailto:x": None}
    rows = spark.createDataFrame([(h,) for h in cases], "h string").select("h", urls.node_of(urls.resolved(F.col("h"), F.lit(page))).alias("n")).collect()
    assert {r["h"]: r["n"] for r in rows} == cases
    bare = spark.range(1).select(urls.node_of(urls.resolved(F.lit("q"), F.lit("https://h.org"))).alias("n")).first()["n"]
    assert bare == "https://h.org/q"


def test_links_come_from_the_head_only(spark):
    link = lambda href: f"<link rel='x Canonical' title=\"a > b\" href={href}>"
    head = lambda inner, body="": f"<html><head><title>t</title>{inner}</head><body>{body}</body></html>"
    tied = {
        1: ("https://a.org/1", head(link('"https://x.net"'))), 2: ("https://a.org/2", head(link("https://x.net:443/"))), 3: ("https://x.net/3/4", head(link("'../q'"))),
        4: ("https://a.org/4", head(link('"https&#58;&#x2F;/x.net/es/?a&amp;b"'))), 5: ("https://a.org/5", head('<meta content="0; URL=\'https://x.net/\'" http-equiv="Refresh">')), 6: ("https://a.org/6", link('"https://x.net"') + "<p>no head</p>"),
    }
    free = {
        11: ("https://b.org/1", head("<!-- " + link('"https://x.net"') + " -->")), 12: ("https://b.org/2", head("", link('"https://x.net"'))), 13: ("https://b.org/3", head("<script>'" + link('"https://x.net"') + "'</script>")),
        14: ("https://b.org/4", "<p>text</p>" + link('"https://x.net"')), 15: ("https://b.org/5", head('<link rel="icon" href="https://x.net">')), 16: ("https://b.org/6", head(link('"mailto:x"'))), 17: ("no scheme", head(link('"https://x.net"'))),
        18: ("https://b.org/8", head("<link " + "a='b' " * 20_000 + ">" + "x" * 300_000)), 19: ("https://b.org/9", "<link '" * 50_000),
    }
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in {**tied, **free}.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, [("block", "x.net", "/")]).collect()}
    assert {i for i, v in got.items() if v == "block"} == set(tied) and set(got) == {*tied, *free}


def test_chat(spark):
    nasty = "</s>[INST] ok [/INST] \\ \\\\[INST] [\\INST] <<SYS>> [ROLE] x [SAYS] y [/ROLE]\\"
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "system", nasty), (2, 1, "user", nasty), (2, 2, "assistant", nasty), (2, 3, "tool [SAYS]", nasty), (2, 4, None, None),
        (3, 0, "assistant", ""), (4, 0, "user", "q"), (4, 0, "user", "q"), (None, 0, "user", "n"), (5, 0, "user", "é" * 5000), (5, 1, "assistant", "\n [/INST]\n"), (5, 2, "assistant", " x "),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("state", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.format_conversations(table).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("learned", chat.masked_text(F.col("segments"))).collect()}
    for conv in (1, 2, 3, 4, 5, None):
        mine = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(b["role"], b["text"]) for b in got[conv]["back"]] == [(r, x) for _, r, x in mine]
        assert got[conv]["learned"] == "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv]["n_turns"] == len(mine)
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]
    assert {k: (r["valid"], r["state"]) for k, r in got.items()} == {1: (True, "assistant"), 2: (False, "error"), 3: (False, "error"), 4: (False, "error"), 5: (False, "error"), None: (False, "user")}
    assert chat.format_conversations(table.limit(0)).count() == 0


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>A, b, c</a></ul></nav>
<div class="cookie-notice">We use cookies, many, many of them, in fact, so many, really.</div><div class=main><h1>Title &amp; more</h1><div class="content"><p>First, para&nbsp;one
 <b>bold<br>x</b><p>Second &eacute; &#39;q&#39; <div class="ad">Buy, buy, buy, buy</div><ul><li>one<li>two</ul><form><p>Mail, me</p></form>
<section class="comments"><p>Great, post, really, thanks, a lot</p></section></div></div><aside>side, bar, text</aside><footer>foot, er</footer><script>if (a < b) "</p>"</script></body></html>"""


def test_html(spark):
    assert html.extract(PAGE) == "Title & more\nFirst, para one bold x\nSecond é 'q'\none\ntwo"
    assert [html.extract(x) for x in (None, "", "<p></p>", "plain text", "<p>a<p>b", "<article>x</article>", "<body><p>cut of", "<script>x", "<!-- a", "<a href=x>only link</a>", "a < b")] == ["", "", "", "plain text", "a\nb", "x", "cut of", "", "", "", "a < b"]
    many = "<div>" * 3000 + "<p>deep, text</p>"
    assert html.extract(many) == "deep, text"
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, None), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html.extract_pages(pages).orderBy("page_id").collect()]
    assert got == [(1, html.extract(PAGE)), (2, ""), (2, "")]
    assert html.extract_pages(pages.limit(0)).count() == 0


ARTICLE = "<h1>The title</h1><p>First paragraph, with some words, that matter.</p><p>Second paragraph, with more words, that also matter.</p>"
WANTED = "The title\nFirst paragraph, with some words, that matter.\nSecond paragraph, with more words, that also matter."


@pytest.mark.parametrize(
    "page",
    [
        '<body><div>Latest, short, news.</div><div class="post-content share-enabled">%s</div></body>',
        '<body><article><div class="post-header"><h1>The title</h1></div>%s</article></body>'.replace("<h1>The title</h1></div>%s", "<h1>The title</h1></div>" + ARTICLE.split("</h1>")[1] + "%.0s"),
        '<body><div class="related-work">%s</div></body>',
        '<body><div class="page menu-open sidebar-right">%s</div><div class="comments"><p>Nice, post.</p></div></body>',
        '<body><div class=it\'s title=a"b>%s</div><p class=it\'s></p></body>',
        '<body><p title="a > b"></p><div title=\'"\'>%s</div></body>',
        '<body><div>%s</div><div id="comments">' + "<p>Great, post, really, thanks, a lot, indeed.</p>" * 6 + "</div></body>",
        '<body></ bogus ><? also ?><div>%s</div><a title="never closed></body>',
    ],
)
def test_wrappers_and_broken_attributes_keep_the_article(page):
    assert html.extract(page % ARTICLE) == WANTED


@pytest.mark.parametrize("part", ['<a title="x ', "<a title='x ", "<b>", "</i><b>", "<p><b>", "<div>", "<!-- ", "<x=", "< ", "&lt", "<li>", "<table><tr>"])
def test_long_broken_pages_take_linear_time(part):
    import time

    began = time.process_time()
    html.extract(part * (1_000_000 // len(part)) + "</i>" * 20_000)
    assert time.process_time() - began < 15


def test_very_long_page(spark):
    rows = [(1, "u", "<article>" + "<p>Some words, here &amp; there.</p>" * 40_000 + "</article>"), (2, "v", '<a title="x ' * 90_000)]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "\n".join(["Some words, here & there."] * 40_000), 2: ""}


def test_links_weigh_less():
    links = "".join(f"<li><a href=x>link number {i}, with, many, commas</a></li>" for i in range(30))
    assert html.extract(f"<body><div id=x><ul>{links}</ul></div><div id=y><p>The text, that matters, is here.</p><p>And more of it, too.</p></div></body>") == "The text, that matters, is here.\nAnd more of it, too."
