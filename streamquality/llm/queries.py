"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

import uuid

import pyarrow as pa
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staging_root
from . import (bpe, check_sql, credentials, decontaminate, extract, fingerprints, jaccard, licenses, merkle, mixing, negatives, packed,
               quality, substrings, vocab)
from .common import release, table

QUERIES: dict = {}
SQL: dict[str, str] = check_sql.SQL


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = bpe.compile_merges(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), merges, digest=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       "decoded_sha256")


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = vocab.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    path = f"{staging_root(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    packed.write_tokens(vocab.encode(ordered, vocabulary, end=2), path, vocabulary.size)

    def digest(batches):
        release()
        for batch in batches:
            lists = batch.column("ids")
            values, offsets = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])
    return packed.read_tokens(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, slots = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = slots.groupBy("no", "offset").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    taken = taken.select(F.col("no").alias("of"), F.col("offset").alias("at"), "taken")
    same = (F.col("no") == F.col("of")) & (F.col("offset") == F.col("at")) & (F.col("size") > 0)
    return items.join(taken, same, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


@query
def op7_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.compare_edited(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    rows = quality.rules(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return rows.drop("score")


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.struct("page_id", "url").alias("page"), "html")
    rows = extract.extract(pages, "page")
    return rows.select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = credentials.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{credentials.KINDS[kind]}")
    counts = map(count, (credentials.ASSIGN, credentials.ACCESS, credentials.HEX))
    return rows.select("doc_id", *counts, F.sha2(credentials.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       credentials.written(F.col("spans")).alias("spans"))


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=85).drop("first", "tie")


@query
def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    def leaf(text):
        return merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    text = F.col("text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.unhex(leaf(F.translate(text, upper, lower))))
    rows = merkle.manifest(docs.select("doc_id", "source", leaf(text).alias("leaf"), tampered.alias("tampered")))
    steps = F.transform("proof", lambda s: F.concat(s["before"], s["after"]))
    found = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(steps, "").cast("binary"), 256).alias("proof_sha256"),
                        merkle.fold(F.coalesce(F.lower(F.hex("tampered")), "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(names.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)
