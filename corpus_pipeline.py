"""Corpus pipeline: five operators in a row over ``documents``.

A stage is a function (spark, docs, sf_dir) -> DataFrame.  Its rows are written
as Parquet in the shared checkpoint folder and read again as the next stage's
``docs``.  All stages but the last return the columns of ``docs`` (more or
fewer than those of the table are fine, as long as doc_id and text are there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfront.llm import decontaminate, language, secrets, sentence_pieces, simhash
from shopfront.llm.common import held_out, prepare, scratch, table
from shopfront.llm.queries import piece_model


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters, or like none of them, go.

    The filters learn from the labelled rows of ``docs`` itself.
    """
    prepare(spark)
    return language.keep_identified(docs, docs.filter(~held_out()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: that with the smallest doc_id (null last), ties by the text's hash.

    Rows that share a doc_id but not the text are decided each by its own text; of equal rows one stays.
    """
    prepare(spark)
    return simhash.drop_near_duplicates(docs, words_per_shingle=3, max_bits=3)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no verified item of ``benchmark``."""
    prepare(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by ``[SECRET]`` (n_chars follows the text)."""
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every document that is left."""
    prepare(spark)
    return sentence_pieces.encode_decode(docs, piece_model(), ("n_tokens", "ids", "decoded_sha256"))


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates),
          ("decontamination", decontaminate_benchmark), ("secrets", redact_secrets), ("sentencepiece", encode_pieces)]

#: Bloom-filter classifiers, SimHash and SentencePiece have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
