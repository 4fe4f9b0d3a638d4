"""From raw documents to token ids: filter, deduplicate, redact, mix, encode.

Each stage takes the rows that the one before it kept and returns ``documents`` rows (the last
one: ids). Results between stages are Parquet in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamquality.llm import bpe, credentials, jaccard, mixing, quality
from streamquality.llm.common import table
from streamquality.session import ship_package
from streamquality.staging import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, measured against those labelled as good."""
    return quality.filtered(docs, table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80% of its five-word shingles: the smallest id."""
    ship_package(spark)
    # at this width many texts may meet many others: large cells, so that each is shipped to few of them
    return jaccard.distinct(docs, width=5, percent=80, cell=1 << 23)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret and its linked parts replaced by a mark."""
    ship_package(spark)
    return _counted(credentials.redact(docs), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mixture takes of each document, repeats included."""
    ship_package(spark)
    return _counted(mixing.mixed_texts(docs), docs)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: the ids, and a digest of what they decode to."""
    ship_package(spark)
    merges = bpe.compile_merges(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.round_trip(docs.select("doc_id", "text"), merges, digest=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


def _counted(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``n_chars`` of the new texts, where the table has such a column."""
    if "n_chars" in like.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return rows.select(*like.columns)


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", near_duplicates), ("secret_scans", secret_scan),
          ("source_mixing", source_mix), ("byte_level_bpe", bpe_ids)]

#: The ids of a tokenizer and hashed scores are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
