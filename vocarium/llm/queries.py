"""Registered queries of the operators, each over its whole table, with DuckDB texts where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vocarium.llm import (centroids, chat, decontamination, html_text, language_model, licences, mixing, rules, simhash, token_alignment, token_files, toxicity,
                          url_rules)
from vocarium.llm.rows import table
from vocarium.session import written

#: Tokenizer file of the contract; a parameter of the operator.
TOKENIZER = "byte_bpe_50k.json"

#: The other tokenizer of the alignment.
PIECES = "piece_bpe_32k.model"


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_chat_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    raw = written(chat.raw_transcripts(table(spark, folder, "conversations")), "transcripts")
    labelled = raw.filter(F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 != 0, F.lit(False)))
    found = chat.transcripts(raw.select("conv_id", "line_no", "line"), labelled)
    return found.select("conv_id", F.shiftright("line_no", 32).alias("turn"), "line_no", "role", "opens", "closes", "rendered")


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(table(spark, folder, "pages"))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op7_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op8_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.language_model(table(spark, folder, "documents"))


def op9_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    book = rules.apply_policy(rules.ledger(table(spark, folder, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       rules.failed(rules.mask_of(rules.POLICIES[1])).alias("base_failed"), "kept", "fail_bits")


def op11_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = url_rules.judge(table(spark, folder, "pages"), url_rules.SITES + url_rules.WORDS)
    return found.select("page_id", "host", "path", F.when(F.col("tier") == 0, F.col("name")).alias("rule"), "verdict")


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.alignment(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.described(*centroids.cluster(table(spark, folder, "embeddings")))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_chat_transcripts, op3_token_files, op4_toxicity, op5_main_text, op6_mix_sources, op7_licence_scan,
                                  op8_language_model, op9_simhash_groups, op10_rule_ledger, op11_url_rules, op12_token_alignment, op13_centroids)}

ORACLES: dict[str, str] = {"op10_rule_ledger": rules.oracle(), "op11_url_rules": url_rules.oracle(url_rules.SITES + url_rules.WORDS), "op13_centroids": centroids.oracle()}
