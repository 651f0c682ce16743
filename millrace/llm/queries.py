"""One query per operator over its whole table, with the SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    bpe, centroid_clusters, embedding_pairs, html_extract, jaccard_join, language_id, license_scan, oracles, packing, personal_data, quality_rules,
    suffix_dedup, vector_codes, warc,
)
from millrace.plans.registry import table

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict, and the certified verdict per language."""
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.concat_ws(",", "rejected_by").alias("rejected_by"),
    )


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    digests = bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return digests.withColumnRenamed("id", "doc_id")


@query("op3_embedding_pairs", oracles.EMBEDDING_PAIRS)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return embedding_pairs.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learnt from the texts that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out()))
    predicted = language_id.identify(docs, model, with_spans=False)
    return predicted.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


@query("op5_jaccard_join", oracles.JACCARD_JOIN)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op6_license_scan", oracles.LICENSE_SCAN)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and all licence labels of every text."""
    scanned = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    firsts = F.transform(base, lambda m: m["first_word"])
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    return scanned.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_warc", oracles.WARC)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, read back and assembled."""
    captures = warc.archive_round_trip(spark, table(spark, sf_dir, "pages"), with_payload=False)
    return captures.select(
        "page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.col("refers_to_page").alias("refers_to"), "url",
    )


@query("op9_html_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


@query("op10_suffix_dedup", oracles.SUFFIX_DEDUP)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that stand in a passage of an earlier one."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


@query("op11_personal_data")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base counts and spans, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = personal_data.find_personal(docs, personal_data.train(docs))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in personal_data.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op12_vector_codes", oracles.VECTOR_CODES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors."""
    codes, codebooks = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    numbers = F.flatten(F.flatten("codebooks"))
    digests = codebooks.select("dim", F.sha2(F.array_join(numbers.cast("array<string>"), ","), 256).alias("codebooks_sha256"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return vector_codes.with_label_errors(codes).join(digests, "dim", "left").select(
        F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", "codebooks_sha256"
    )


@query("op13_centroid_clusters", oracles.CENTROID_CLUSTERS)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertias of all vectors."""
    clusters = centroid_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return clusters.select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"),
    )
