"""A corpus pipeline over documents: five of the llm operators, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, langid, lines, mixing, ngrams
from marginalia.llm.common import forget, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: those that language ID calls und (a null text, or one without a letter).

    lang becomes the predicted language. A score is no ground for dropping: a clean text of one word has a low one.
    Where no document is labelled there is nothing to learn from: the same documents go, and lang stays as it is.
    """
    model = langid.train(docs.where(~langid.held_out()))
    return langid.labelled(docs, model).where("lang is null or lang <> 'und'").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that at least three documents hold from all but the largest; n_chars follows the text.

    A document that loses lines and keeps no letter or digit goes: larger documents hold all of its text. Others stay.
    """
    out = lines.line_dedup(docs, counts=("_lines", "_dropped"))
    out = out.where((F.col("_dropped") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    return out.withColumn("n_chars", F.when(F.col("_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that the n-gram Jaccard join links: the one with the smallest doc_id."""
    gone = ngrams.ngram_join(docs).where("not kept").select("doc_id").distinct()
    return docs.join(written(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents in the order of the source mixture: files and the rows in them follow one another by position."""
    return mixing.mix_sources(docs, in_order=True, names=("_block", "_slot", "_position")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of all documents, decoded again."""
    import public_tokenizers

    return bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dups", near_dups), ("mix", mix), ("encode", encode)]

#: A kernel regression, a probabilistic index and a scheduler aren't SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written in the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, old = written(stage(spark, docs, sf_dir), "stage"), before
        forget(old)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
