"""What a run of the pipeline removes, finds again, and leaves to others."""

import glob

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm.common import scratch, shared_dir, staged, table
from millrace.llm.mixing import mix

SF = "/root/testdata/sf0.001"


def _few(docs):
    return docs.where("doc_id < 40")


@pytest.fixture
def short(monkeypatch):
    """Two stages that count how often they run."""
    ran = []

    def stage(name):
        def run(spark, docs, sf_dir):
            ran.append(name)
            return staged(docs.withColumn("n_chars", F.col("n_chars") + 1), name)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage(n)) for n in ("a", "b")])
    return ran


def test_a_held_result_survives_a_run(spark, short):
    held = mix(_few(table(spark, SF, "documents")), (5, 2, 1), 1.5, 2.0)
    made = corpus_pipeline.run(spark, SF)
    assert held.count() == 40 and made.count() == table(spark, SF, "documents").count()


def test_a_run_removes_what_it_staged(spark, short):
    there = f"{shared_dir(spark).removeprefix('file:')}/*"
    before = set(glob.glob(there))
    corpus_pipeline.run(spark, SF)
    after = set(glob.glob(there)) - before
    assert len(after) == 1 and "pipeline-" in after.pop()


def test_scratch_removes_its_own_tables_after_failures_too(spark):
    outer = staged(spark.range(3), "outer")
    with pytest.raises(RuntimeError), scratch(spark):
        inner = staged(spark.range(5), "inner")
        with scratch(spark):
            deeper = staged(spark.range(7), "deeper")
        assert inner.count() == 5 and outer.count() == 3
        raise RuntimeError
    assert outer.count() == 3
    for gone in (inner, deeper):
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
            gone.count()


def test_named_runs_follow_their_input(spark, short, tmp_path, monkeypatch):
    docs = table(spark, SF, "documents")
    folder = str(tmp_path)
    _few(docs).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder, "x").count() == 40 and short == ["a", "b"]
    assert corpus_pipeline.run(spark, folder, "x").count() == 40 and short == ["a", "b"]
    assert corpus_pipeline.run(spark, SF, "x").count() == docs.count() and len(short) == 4
    docs.where("doc_id < 50").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder, "x").count() == 50 and len(short) == 6
    monkeypatch.setitem(corpus_pipeline.SETTINGS, "capacity", 1024)
    corpus_pipeline.run(spark, folder, "x")
    assert len(short) == 8
