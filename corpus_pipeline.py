"""Documents to packed training sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.
``run`` writes each stage's result as Parquet into the shared folder and reads it back for the next;
what a stage wrote on the way is deleted once its result is there.
Nulls and repeated rows are treated as the operators say; rows are told apart by id and text, so a
null or repeated ``doc_id`` does no harm, and an empty table goes through as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwatch.llm import exact_dedup, packing, quality_rules, simhash, suffix_dedup
from parcelwatch.llm.common import documents, passing_tables, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _stamped(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns), ``doc_id``, ``text`` and ``sha``.

    An id and the digest of a text say which row is meant in any later read.  A row number would not:
    it depends on how a table is split, and that on how many executors there are at the time.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.struct("*").alias("doc"), "doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("sha")
    )


def _match(rows: DataFrame, keys: DataFrame):
    return rows["doc_id"].eqNullSafe(keys["key_id"]) & (rows["sha"] == keys["key_sha"])


def _keep(rows: DataFrame, gone: DataFrame, twice: DataFrame) -> DataFrame:
    """Rows that are not ``gone``; of those that are there ``twice`` or more, one."""
    gone, twice = (k.toDF("key_id", "key_sha").distinct() for k in (gone, twice))
    rest = rows.join(gone, _match(rows, gone), "left_anti")
    twice = written(twice)
    if twice.isEmpty():
        return rest.select("doc.*")
    once = rest.join(twice, _match(rest, twice), "left_anti")
    one = rest.join(twice, _match(rest, twice), "left_semi").dropDuplicates(["doc_id", "sha"])
    return once.union(one).select("doc.*")


def rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that break a rule go; so do documents that are too short, repetitive or lose too much."""
    return quality_rules.clean(docs, "text", "n_chars")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    rows = _stamped(docs)
    found = written(exact_dedup.exact_duplicates(docs)).where(~F.col("kept"))
    last = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    pair = ["doc_id", "text_sha256"]
    return _keep(rows, found.where(~last).select(pair), found.where(last).select(pair))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the row with the smallest doc_id stays."""
    rows = _stamped(docs)
    # Rows without an id come last; the digest tells rows of one id apart.
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")
    found = simhash.near_duplicates(rows.select(key.alias("key"), "text"), words=3, distance=3, id_col="key")
    found = written(found.select(F.col("doc_id").alias("key"), "component_id"))
    first = F.col("key") == F.col("component_id")
    pair = ["key.doc_id", "key.sha"]
    twice = found.where(first).groupBy("key").count().where("count > 1")
    return _keep(rows, found.where(~first).select(pair), twice.select(pair))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that occur twice or more are cut out; every document stays."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = suffix_dedup.remove_repeats(docs, length=200, carry=others)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return found.select(*[new.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, VOCABULARY, capacity=1024, end_id=0)


STAGES = [
    ("quality rules", rule_filter),
    ("exact dedup", drop_exact),
    ("simhash near-dedup", drop_near),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack_sequences),
]

# Fingerprints, suffix order and token ids are beyond SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        with passing_tables(spark):
            docs = written(stage(spark, docs, sf_dir), lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
