"""The physical plans are the ones meant: pruned scans, limits before shuffles, no cross products of data."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from millrace.operators.retrieval import postings, term_stats, vector_topk
from millrace.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def scans(df):
    return [line for line in plan(df).splitlines() if "ReadSchema" in line]


def test_scans_read_what_is_asked(spark):
    assert all("props" not in s and "value" not in s for s in scans(QUERIES["latest_per_key"](spark, SF)))
    assert all("text:string" not in s for s in scans(QUERIES["unparsed_documents"](spark, SF)))
    assert all("embedding:array" not in s for s in scans(QUERIES["embedding_statuses"](spark, SF)) if "label" not in s)


def test_filters_reach_the_scan(spark):
    text = plan(vector_topk(spark.read.parquet(f"{SF}/embeddings.parquet"), [0.0] * 64, 5, F.col("label") == 3))
    assert re.search(r"PushedFilters: \[.*EqualTo\(label,3\)", text) and "TakeOrderedAndProject" in text


def test_latest_is_limited_before_the_shuffle(spark):
    text = plan(QUERIES["latest_per_key"](spark, SF))
    assert text.count("WindowGroupLimit") >= 2


def test_term_counts_shuffle_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert plan(term_stats(docs)).split("== Physical Plan ==")[1].split("\n\n")[0].count("Exchange") == 1
    assert plan(postings(docs)).split("== Physical Plan ==")[1].split("\n\n")[0].count("Exchange") == 1


def test_chunking_needs_no_shuffle_of_its_own(spark):
    from millrace.operators.chunking import window_chunks

    assert "Exchange" not in plan(window_chunks(spark.read.parquet(f"{SF}/documents.parquet")))
