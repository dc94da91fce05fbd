"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import (
    chunks, common, conversations, decontaminate, html_text, language, merkle, mixing, ngram_join, personal_data,
    secret_scan, shard_tree, simhash, sql, toxicity)


def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(common.table(spark, folder, "pages"))


def op2_hash_tree(spark: SparkSession, folder: str) -> DataFrame:
    return shard_tree.sharded(common.table(spark, folder, "documents"))


def op3_chunk_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.compared(common.table(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    held = common.held_out(F.col("doc_id"), 3, 1)
    lexicon = toxicity.fit(docs, common.table(spark, folder, "labels"), held)
    found = toxicity.scored(docs, lexicon)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "matched")


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scanned(common.table(spark, folder, "documents"))


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.detected(common.table(spark, folder, "documents"))
    return found.select(
        "doc_id", *(personal_data.counted("base", k).alias(f"n_{k}") for k in personal_data.BASE),
        F.sha2(personal_data.joined("base"), 256).alias("base_sha256"), personal_data.joined("spans").alias("spans"))


def op7_fm_index(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(
        common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = common.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(language.training_rows(docs, held))
    found = language.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked(common.table(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    planned = mixing.plan(common.table(spark, folder, "documents"))
    return planned.select(F.col("id").alias("doc_id"), "size", "source_size", "target", mixing.taken().alias("taken"))


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.linked(common.table(spark, folder, "documents"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = common.table(spark, folder, "conversations")
    found, edits = conversations.repair(conversations.damaged(rows))
    every = rows.select(F.col("conv_id").alias("conv")).distinct()
    for part in (found, conversations.digested(edits)):
        kept = [c for c in part.columns if c != "conv"]
        every = every.join(conversations.other(part), conversations.same_conv(), "left").select(*every.columns, *kept)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.select(
        F.col("conv").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(common.table(spark, folder, "documents")).drop("source")


QUERIES = {f.__name__: f for f in (
    op1_main_text, op2_hash_tree, op3_chunk_fingerprints, op4_toxicity, op5_secrets,
    op6_personal_data, op7_fm_index, op8_language, op9_ngram_join, op10_mixing,
    op11_simhash, op12_conversation_repair, op13_merkle_manifest)}

#: Hashes of other engines, models and random draws have no SQL; the tests hold those against brute force.
SQL: dict[str, str] = {
    "op7_fm_index": sql.contamination(),
    "op9_ngram_join": sql.ngram_links(),
    "op13_merkle_manifest": sql.manifest(),
}
