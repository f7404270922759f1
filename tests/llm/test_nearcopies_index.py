"""The index of fingerprints inside the near-copies stage: what it links is verified, what it misses is found by the lists."""

import random
from itertools import combinations

import corpus_pipeline
from depweave.llm import nearcopies, simhash


def texts():
    rng = random.Random(11)
    rows = []
    for k in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows.append((100 * k, " ".join(words)))
        for j, changes in enumerate((1, 2, 8), 1):
            copy = list(words)
            for at in rng.sample(range(5, 395), changes):
                copy[at] = f"x{k}y{j}z{at}"
            rows.append((100 * k + j, " ".join(copy)))
    return rows


def test_stage_goes_through_the_index(spark, tmp_path, monkeypatch):
    asked, index = [], simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda fps, *a: asked.append(fps.count()) or index(fps, *a))
    rows = texts()
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {100 * k for k in range(20)}
    prints = {simhash.majority([nearcopies.shingle_set(t.encode())]) for _, t in rows}
    assert asked == [len(prints)]


def test_index_links_what_is_near_and_alike(spark):
    rows = texts()
    sets = nearcopies.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string")).localCheckpoint()
    found = {(r["u"], r["v"]) for r in nearcopies.fingerprint_links(sets).collect()}
    known = {r["node"]: (set(r["items"]), r["fp"] & (1 << 64) - 1) for r in sets.collect()}
    near = {p for p in combinations(sorted(known), 2) if (known[p[0]][1] ^ known[p[1]][1]).bit_count() <= 2}
    alike = {(a, b) for a, b in near if 5 * len(known[a][0] & known[b][0]) >= 4 * len(known[a][0] | known[b][0])}
    roots = nearcopies.connected_components(spark.createDataFrame(sorted(found), "u long, v long")).collect()
    root = {r["node"]: r["root"] for r in roots}
    assert alike and all(root[a] == root[b] for a, b in alike)
    assert {tuple(sorted(p)) for p in found} <= near


def test_equal_fingerprints_of_unlike_sets_are_not_linked(spark):
    table = spark.createDataFrame([(k, 10, 7, list(range(k, k + 10)), nearcopies.bitmap(nearcopies.np.arange(k, k + 10, dtype="uint64")).tolist()) for k in (1, 2, 50)], "node long, n long, fp long, items array<long>, bits array<long>")
    assert {(r["u"], r["v"]) for r in nearcopies.fingerprint_links(table).collect()} == {(1, 2)}
