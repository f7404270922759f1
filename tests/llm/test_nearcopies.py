"""Near copies of the pipeline's stage against a comparison of all pairs."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from depweave.llm import nearcopies


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_firsts(rows):
    """Ids that are the least of their group."""
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if len(x & y) * 5 >= len(x | y) * 4:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i for i in parent if find(i) == i}


def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows = []
    for k in range(40):
        words = [rng.choice(vocabulary) for _ in range(200)]
        rows.append((10 * k, " ".join(words)))
        for j, changes in enumerate((1, 2, 3, 5, 8, 20), 1):  # Jaccard from about 0.95 to 0.3
            copy = list(words)
            for at in rng.sample(range(200), changes):
                copy[at] = rng.choice(vocabulary)
            rows.append((10 * k + j, " ".join(copy)))
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for k in range(30):  # each is close to the next only
        rows.append((1000 + k, " ".join(chain)))
        chain = chain[4:] + [rng.choice(vocabulary) for _ in range(4)]
    return [*rows, (2000, "One two"), (2001, "one  TWO"), (2002, "one three"), (2003, ""), (2004, None), (2005, " \n")]


def test_stage_drops_near_copies(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in kept} == brute_firsts(rows) and len(kept) == len(brute_firsts(rows))
    assert len(kept) < 200  # three or so of the six copies of each text go


def test_open_lists_are_compared_to_the_end(spark):
    """One list of unlike sets whose leader is like none of the others: the other links are found."""
    sets = {1: range(100), **{2 + k: range(1000 * (k // 2), 1000 * (k // 2) + 100 - k % 2) for k in range(2, 40)}}
    table = spark.createDataFrame([(k, len(v), list(v), nearcopies.bitmap(np.array(v, np.uint64)).tolist()) for k, v in sets.items()], "node long, n long, items array<long>, bits array<long>")
    members = spark.createDataFrame([(5, k, len(v), 200, len(sets), (1, 100, 200)) for k, v in sets.items()], "key long, node long, n long, most long, size long, lead struct<node: long, n: long, most: long>")
    links = {(r["u"], r["v"]) for r in nearcopies.set_links(members, table).collect()}
    assert links == {(k, k + 1) for k in range(4, 42, 2)}


def test_similar_sets_always_meet():
    """For any order, two sets at 0.8 share a posting under which neither rules the other out."""
    rng = random.Random(3)
    tried = 0
    while tried < 300:
        n = rng.randint(1, 60)
        x = rng.sample(range(10_000), n)
        kept = rng.sample(x, rng.randint(int(0.8 * n), n))
        y = kept + rng.sample(range(10_000, 20_000), rng.randint(0, n - int(0.8 * n)))
        if not len(set(x) & set(y)) * 5 >= len(set(x) | set(y)) * 4:
            continue
        tried += 1
        order = {k: rng.random() for k in {*x, *y}}
        posted = [dict(zip(sorted(s, key=order.get), nearcopies.largest_partners(len(s)).tolist(), strict=False)) for s in (x, y)]
        assert any(posted[0][k] >= len(y) and posted[1][k] >= len(x) for k in posted[0].keys() & posted[1].keys())


def test_bitmaps_never_rule_out_what_is_shared():
    rng = np.random.default_rng(4)
    for n in (1, 10, 200, 5000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.concatenate([x[: n - n // 5], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)])
        a, b = nearcopies.bitmap(x).view(np.uint64), nearcopies.bitmap(y).view(np.uint64)
        assert len(x) - int(np.bitwise_count(a & ~b).sum()) >= len(np.intersect1d(x, y)) <= len(y) - int(np.bitwise_count(b & ~a).sum())
        assert len(a) * 64 == nearcopies.BITS


def test_large_group_costs_about_one_comparison_each(spark):
    """Copies of one text, each with two words of its own, are like the text but not like each other."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 301):
        copy = list(base)
        for at in rng.sample(range(120), 2):
            copy[at] = f"x{i}y{at}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = nearcopies.stage(nearcopies.shingle_sets(docs), "t")
    firsts = nearcopies.postings(sets, nearcopies.counters(sets)).withColumnRenamed("doc", "first")
    leads = nearcopies.lists_of(firsts).select("lead.node").distinct().count()
    assert leads <= 3
    assert {r["component"] for r in nearcopies.near_copies(docs).collect()} == {0}


def test_empty_table(spark):
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
