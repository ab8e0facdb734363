"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from copycensus.llm import (
    bpe, chaining, chat, clustering, decontaminate, language, near_dedup, periodic, quality, secrets, suffix_dedup, token_counts, warc,
)
from copycensus.llm.common import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[function.__name__] = function
    return function


@query
def op1_warc_chunks(spark, sf):
    records = warc.checked_records(warc.round_trip(table(spark, sf, "pages")))
    return records.withColumnRenamed("record_id", "page_id")


@query
def op2_simhash_windows(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op3_chained_passages(spark, sf):
    return chaining.passages(table(spark, sf, "documents"))


@query
def op4_section_tokens(spark, sf):
    return token_counts.count_sections(table(spark, sf, "documents"))


@query
def op5_bottom_k(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op6_quality_cascade(spark, sf):
    return quality.judge(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_byte_bpe(spark, sf):
    return bpe.digest_documents(table(spark, sf, "documents"))


@query
def op8_suffix_columns(spark, sf):
    return suffix_dedup.digests(table(spark, sf, "documents"))


@query
def op9_nearest_centroid_language(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_chat_format(spark, sf):
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    written = chat.format_conversations(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    read = written.withColumns({
        "_turns": chat.read_turns(F.col("formatted")), "_loss": chat.read_loss(F.col("formatted"), F.col("loss"))})
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op11_ptolemaic_clusters(spark, sf):
    return clustering.summarised(table(spark, sf, "embeddings"))


@query
def op12_block_convolution(spark, sf):
    return periodic.digests(table(spark, sf, "documents"))


@query
def op13_secret_network(spark, sf):
    return secrets.digests(table(spark, sf, "documents"))


@query
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
