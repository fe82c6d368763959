"""From ``documents`` to token ids: language ID, line dedup, near duplicates, mixing, SentencePiece encoding.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns the columns of
``docs``; the last returns them with ``ids`` in place of the text.  Null texts leave in the first stage; an empty table passes
through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.llm import jaccard_join, language_id, line_dedup, mixing, pieces
from prismgrid.llm.common import stored

#: Part of what is usual in its best language that a text must know of it.
LEAST_FAMILIAR = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose words and n-grams their best language hardly knows, go."""
    return language_id.accepted(docs, language_id.train(docs, usual=True), LEAST_FAMILIAR)


def without_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of 50 words or more that an earlier document has go; a document that consists of them goes with them."""
    removed = "_removed"
    while removed in docs.columns:
        removed += "_"
    out = line_dedup.dedup_lines(docs, report=removed).where((F.col(removed) == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of connected near duplicates (five words, 0.8) exactly one row stays: the smallest id, null ids last."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as came in, with the sources half way between their own and even entropy, each at most four times."""
    return mixing.mix(docs, mixing.plan(docs)).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text that was drawn."""
    keep = tuple(c for c in docs.columns if c != "text")
    return pieces.encode(docs, str(public_tokenizers.path("piece_bpe_32k.model")), keep)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_copied_lines),
    ("jaccard_join", one_of_each_group),
    ("mixing", mixed),
    ("sentencepiece", token_ids),
]

#: Alignment, learned languages and encoding have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written once for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
