"""Named queries of this subpackage and their DuckDB oracles.

Each query applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, imatch, interactions, language, oracles, repeats, rules, secrets, sentence_pieces, simhash,
               token_output, toxicity, urls, whitening)
from .common import held_out, table

#: Tokenizer files: read by the driver, sent to the executors.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def tokenizer_json(path: str = BYTE_BPE) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def piece_model(path: str = PIECES) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), tokenizer_json(), end_id=0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    filters = language.train(docs.filter(~F.col("held_out")))
    return language.predict(docs, filters, "doc_id", "held_out")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=3, max_bits=3)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_decode(table(spark, sf_dir, "documents"), piece_model(),
                                         ("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.labelled_urls(spark))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    rated = toxicity.rate_toxicity(table(spark, sf_dir, "documents"), labels, threshold=0.3)
    return rated.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(table(spark, sf_dir, "documents"), size=35)


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_likeness(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened_components(table(spark, sf_dir, "embeddings"), components=8)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return interactions.audit_filters(table(spark, sf_dir, "documents"), marks, interactions.quality_filters())


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    rated = rules.rate_quality(table(spark, sf_dir, "documents"), labels, threshold=0.7)
    return rated.select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (
    op1_token_output, op2_decontamination, op3_language, op4_secrets, op5_simhash, op6_sentencepiece, op7_url_filter,
    op8_toxicity, op9_substring_dedup, op10_imatch, op11_whitening, op12_filter_audit, op13_quality)}
ORACLES = {"op12_filter_audit": oracles.FILTER_AUDIT, "op4_secrets": oracles.SECRETS, "op9_substring_dedup": oracles.REPEATS}
