"""The registered queries of the llm folder and the pipeline, on the smallest tables."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from streamquality.llm.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("op13_")))
def test_query_covers_its_table(spark, name):
    table = "pages" if name.startswith("op2_") else "documents"
    assert QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("extra", F.lit(1))
    first = docs
    for name, apply in corpus_pipeline.STAGES[:-1]:
        after = apply(spark, docs, DATA).cache()
        assert after.columns == first.columns, name
        assert 0 < after.count() <= docs.count()
        docs = after
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert ids.count() == docs.count()
    digests = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("d"))
    assert ids.join(digests, "doc_id").filter("d = decoded_sha256").count() == docs.count()


def test_the_mix_broadcasts_no_slots(spark):
    """Their number grows with the words, and all would pass through the driver."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    mixed = corpus_pipeline.source_mix(spark, docs, DATA)
    assert mixed.collect()
    joins = re.findall(r"\w+Join \[[^\]]*block[^\]]*\]", mixed._jdf.queryExecution().executedPlan().toString())
    assert joins and all(j.startswith("SortMergeJoin") for j in joins)


def test_stages_of_no_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, apply in corpus_pipeline.STAGES:
        after = apply(spark, docs, DATA)
        assert after.count() == 0
        docs = after if "text" in after.columns else docs
