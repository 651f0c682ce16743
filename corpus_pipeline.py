"""The corpus pipeline: five stages over ``documents``, each one an operator of ``millrace.llm``.

Every stage but the last returns the columns of ``documents``; each works on
all rows that the one before has kept. Rows with a null id pass the
stages that compare documents unchanged; a null text has no words and fails
the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, language_id, packing, quality_rules, suffix_dedup
from millrace.llm.queries import TOKENIZER, held_out
from millrace.session import cut_lineage

#: A text goes if no language holds at least this share of its letters.
LEAST_LANGUAGE_SHARE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the certified thresholds."""
    return quality_rules.keep_passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is mostly in one known language."""
    model = language_id.train(docs.where(~held_out()))
    found = language_id.with_language(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts."""
    return jaccard_join.keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that earlier ones have."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 1024 tokens."""
    pieces = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", pack),
]

#: Automaton, Viterbi and packing have no SQL twin; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
