"""A corpus in five stages: quality, near duplicates, decontamination, pseudonyms, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each
stage's rows as Parquet into the shared checkpoint folder and hands them to the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, decontaminate, jaccard, pii, quality
from folioflow.llm.queries import PII_KEY
from folioflow.session import kept


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.quality_cascade(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the smallest doc_id.

    Of rows with the same doc_id and text one stays; different texts of one doc_id
    all stay, as do rows without a doc_id.
    """
    found = jaccard.jaccard_components(docs)
    others = found.filter("component_id < doc_id").select("doc_id").distinct()
    left = docs.join(others, "doc_id", "left_anti").select(docs.columns)
    # Only doc_ids that have a text hash twice send their texts.
    hashes = docs.filter("doc_id IS NOT NULL").groupBy("doc_id", F.xxhash64("text").alias("hash")).count()
    again = hashes.filter("count > 1").select("doc_id").distinct()
    one = left.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean_documents(docs, benchmark).select(docs.columns)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data."""
    return pii.pseudonymised(docs, PII_KEY).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_ok): ids as little-endian 32-bit numbers, and whether they decode to the text."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.round_trip(docs, path, pattern, "text")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", (F.col("data") == text).alias("decoded_ok"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", no_benchmarks),
    ("pseudonyms", no_personal_data),
    ("token_ids", token_ids),
]
# The cascade's and the join's rules could be SQL, the keyed permutation and byte-pair merges can't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
