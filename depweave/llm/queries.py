"""The queries opN_<name> over whole tables: each gets its rows through its operator and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm import brown, chat, decontam, html, linededup, oracles, packing, quality, rules, simhash, urls
from depweave.llm.common import read, stage
from depweave.llm.components import connected_components


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("__found.n_words").alias("n_words"),
        F.size("__found.hit").cast("long").alias("n_hit"),
        F.size("__found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__found.items").cast("binary"), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


#: The rules that op4 judges by: verdict, host, path.
URL_RULES: list[urls.Rule] = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(read(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tricky.alias("text"))
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    done = chat.format_conversations(rows).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("learned", chat.masked_text(F.col("segments")))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = brown.score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), keep_ids=False)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return near.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 that SQL can express."""
    stats = rules.with_statistics(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("base_failed", rules.base_failed())
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def fingerprint_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's index and components on given fingerprints (SQL has no XXH64)."""
    fps = stage(spark.sql(oracles.FINGERPRINTS, documents=read(spark, sf_dir, "documents")), "given-fingerprints")
    members = connected_components(simhash.fingerprint_links(fps), "given-edges")
    return members.select(F.col("node").alias("fingerprint"), "root")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_quality_classifier, op2_quality_rules, op3_decontaminate, op4_url_filter, op5_chat_format, op6_line_dedup, op7_brown_lm, op8_best_fit_packing, op9_simhash, op10_html_text)
    return {f.__name__: f for f in (*named, rule_statistics, fingerprint_components)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": oracles.OP3, "op4_url_filter": oracles.op4(URL_RULES), "op5_chat_format": oracles.OP5, "op6_line_dedup": oracles.OP6, "op10_html_text": oracles.OP10, "rule_statistics": oracles.RULE_STATISTICS, "fingerprint_components": oracles.FINGERPRINT_COMPONENTS}
