"""One named query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwatch.llm import (
    bpe, collocations, decontamination, exact_dedup, licenses, merkle, packing, quality_crf, quality_rules, sharding,
    simhash, suffix_dedup, token_counts,
)
from parcelwatch.llm.common import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that whole texts are, and that their lines state."""
    return licenses.scan_licenses(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of SimHash fingerprints of 3-word shingles within 3 bits."""
    return simhash.near_duplicates(documents(spark, sf_dir), words=3, distance=3)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text; one id in five is held out from fitting."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_crf.score(docs, quality_crf.train(docs, labels, sample=4000), threshold=0.3)
    return scored.withColumn("held_out", F.coalesce(quality_crf.held_out(), F.lit(False)))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text they decode to, as digests."""
    return bpe.encode_documents(documents(spark, sf_dir), BYTE_BPE, keep_ids=False)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), BYTE_BPE, capacity=1024, end_id=0)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    placed, _ = sharding.shard_documents(documents(spark, sf_dir), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the line rules for every text."""
    return quality_rules.measure(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    return token_counts.count_tokens(documents(spark, sf_dir), PIECE_BPE, limit=4096)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the row with the largest doc_id stays."""
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that no 200-byte string found elsewhere covers."""
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), length=200, keep_text=False)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two or three words of every language."""
    return collocations.collocations(documents(spark, sf_dir), longest=3, least=10, top=2000, share=50)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words that documents share with the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contamination(documents(spark, sf_dir), items, window=10).drop("spans")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and recomputed root of every document; half of the texts are tampered with."""
    found = merkle.manifest(documents(spark, sf_dir), tampered=merkle.without_line_ends)
    return found.drop("proof")


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_simhash, op3_quality, op4_bpe_round_trip, op5_packing, op6_sharding,
        op7_quality_rules, op8_token_counts, op9_exact_dedup, op10_suffix_dedup,
        op11_collocations, op12_decontamination, op13_merkle_manifest,
    )
}
