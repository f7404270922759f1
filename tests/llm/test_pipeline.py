"""The stages one after the other on a small corpus: columns, decisions, nothing lost."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    text = lambda n=90: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(15)) for _ in range(n // 15))
    rows, labels, bench = [], [], []
    for i in range(300):
        body, good = text(), i % 6 != 0
        rows.append((i, body if good else body.upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    passages = [text(30).replace("\n", " ") for _ in range(5)]
    bench += [(k, p) for k, p in enumerate(passages)]
    rows += [(400 + k, text(60) + "\n" + p) for k, p in enumerate(passages)]
    rows += [(500, rows[1][1]), (501, rows[2][1].replace("a", "A")), (502, rows[3][1] + "\n" + rows[4][1].split("\n")[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __found string")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        tables[name] = docs = spark.createDataFrame(out.collect(), out.schema)
    ids = {k: {r["doc_id"] for r in t.select("doc_id").collect()} for k, t in tables.items()}
    good = {i for i in before if i >= 300 or i % 6}
    assert len(ids["quality_classifier"] ^ good) <= 2
    lines = {r["doc_id"]: r for r in tables["line_dedup"].collect()}
    assert lines[502]["text"] == "" and lines[500]["text"] == "" and lines[502]["n_chars"] == 0 and lines[1]["text"] == before[1]
    assert not ids["near_duplicates"] & {501, 502} and {1, 2, 3, 4} <= ids["near_duplicates"]
    assert ids["near_duplicates"] - ids["decontamination"] == {400, 401, 402, 403, 404}
    assert ids["best_fit_packing"] == ids["decontamination"]


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    filled = out.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in filled) <= 1024


def test_odd_rows_go_through_all_stages(spark, folder, tmp_path):
    """Null ids and texts, empty and repeated rows, and an empty table: no stage fails, nothing clean is lost."""
    root = str(tmp_path)
    good = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id between 1 and 5")
    odd = spark.createDataFrame([(None, None), (None, ""), (1, None), (7000, " \n "), (7000, " \n "), (7001, "")], "doc_id long, text string")
    docs = good.unionByName(good.filter("doc_id = 2")).unionByName(odd.selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars", "'more' __found"))
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").write.parquet(f"{root}/{table}.parquet")
    for rows in (docs, docs.limit(0)):
        now = spark.createDataFrame(rows.collect(), rows.schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, root)
            now = spark.createDataFrame(out.collect(), out.schema)
        kept = {r["doc_id"] for r in now.collect()}
        assert kept >= {1, 2, 3, 4, 5} if rows is docs else not kept


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_duplicates", "decontamination", "best_fit_packing"]
