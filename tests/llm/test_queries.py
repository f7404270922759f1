"""The registered queries on the smallest tables: their columns, and their rows against SQL where there is any."""

import os

import pytest

from depweave.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_quality_classifier": "doc_id held_out score predicted",
    "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op4_url_filter": "page_id host path rule verdict",
    "op5_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars valid",
    "op6_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op7_brown_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_simhash": "doc_id fingerprint component_id",
    "op10_html_text": "page_id url text n_chars",
    "rule_statistics": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed",
    "fingerprint_components": "fingerprint root",
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    out = queries.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) == set(out.columns)
    got = out.toArrow()
    table = {"op4": "pages", "op5": "conversations", "op10": "pages"}.get(name.split("_")[0], "documents")
    if name not in ("op5_chat_format", "op8_best_fit_packing", "fingerprint_components"):
        assert got.num_rows == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in queries.oracle_sql():
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "conversations"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        cell = lambda rows: sorted(tuple(str(r[c]) for c in sorted(r)) for r in rows)
        assert cell(got.to_pylist()) == cell(con.sql(queries.oracle_sql()[name]).to_arrow_table().to_pylist())


def test_native_queries_have_no_python_in_their_plans(spark):
    for name in ("op4_url_filter", "op5_chat_format"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas")), name
