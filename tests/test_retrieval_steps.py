"""What a batch of queries costs: no index is written for it, and of texts only those that are hit move."""

import os

from pyspark.sql import functions as F

from millrace.operators.retrieval import texts_of
from millrace.plans.queries import QUERIES
from millrace.session import shared_folder

SF = "/root/testdata/sf0.001"


def test_keyword_search_of_a_batch_writes_no_index(spark):
    QUERIES["bm25_topk"](spark, SF).collect()
    folder = shared_folder(spark).removeprefix("file:")
    assert not [d for d, _, _ in os.walk(folder) if "text-index" in d and d.endswith("/blocks")]


def test_texts_of_hits_are_found_without_a_shuffle(spark):
    docs = spark.range(1000).select("id", F.repeat(F.lit("x"), 100).alias("content"))
    hits = spark.createDataFrame([(1, 3), (2, 3), (2, 5000)], "query_id int, id long")
    found = texts_of(hits, docs)
    assert [r.id for r in found.collect()] == [3]
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
