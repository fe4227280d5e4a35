"""Operator 4 sends few copies of a vector, and gives the same whatever its chunks and rounds."""

import numpy as np

from millrace.llm import embedding_dedup
from millrace.llm.embedding_dedup import embedding_near_duplicates


def table(spark, x, labels=1):
    return spark.createDataFrame([(i, [float(c) for c in v], i % labels) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>, label int")


def shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_a_label_without_structure_is_not_sent_many_times(spark):
    """6000 vectors of a label, of 256 bytes each: they were sent 60 times and more, the oftener the more there are."""
    df = table(spark, np.random.default_rng(1).standard_normal((6000, 64))).repartition(4).localCheckpoint()
    before = shuffled(spark)
    assert embedding_near_duplicates(df).where("n_links > 0").count() == 0
    assert shuffled(spark) - before < 6000 * 3000


def test_chunks_and_rounds_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    near = rng.standard_normal((1, 32)) + 0.05 * rng.standard_normal((150, 32))
    some = rng.standard_normal((200, 32))
    df = table(spark, np.concatenate([near, some, some[:100] + 0.2 * rng.standard_normal((100, 32))]), labels=2)
    whole = sorted(map(tuple, embedding_near_duplicates(df).collect()))
    assert sum(r[1] > 0 for r in whole) > 200
    monkeypatch.setattr(embedding_dedup, "ROUND_COPIES", 8)
    monkeypatch.setattr(embedding_dedup, "HELD_LINKS", 100)
    assert sorted(map(tuple, embedding_near_duplicates(df, chunk_rows=30).collect())) == whole
