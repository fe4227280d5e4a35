"""Documents replaced by the batches of a stream: once each, whatever fails in between and in whatever order revisions come."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.errors import EngineError
from millrace.operators import versions
from millrace.operators.chunking import window_chunks
from millrace.operators.document_table import compact, open_table, replace_documents
from millrace.streaming.ingest import read_documents, refresh

DOCS = "doc_id long, text string, revision long"


def held(table):
    return sorted((r.document_id, r.chunk_index, r.content) for r in table.rows().collect())


def expected(rows, size=1000, step=900):
    last = {}
    for i, text, revision in rows:
        if i is not None and (i not in last or revision >= last[i][0]):
            last[i] = (revision, text)
    return sorted((i, n, text[n * step : n * step + size]) for i, (_, text) in last.items() if text and text.strip() for n in range(1 + max(0, -(-(len(text) - size) // step))))


def put(spark, table, rows, **more):
    return replace_documents(table, spark.createDataFrame(rows, DOCS), window_chunks, **more)


def test_revisions_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, 4, 5, None]), rng.choice([None, "", "a" * 2000, f"t{n}"]), n) for n in range(40)]
    want = expected(sorted(rows, key=lambda r: r[2]))
    rng.shuffle(rows)
    table = open_table(spark, str(tmp_path / "t"))
    assert table.version == 0 and table.rows().count() == 0
    for a in range(0, 40, 10):
        table = put(spark, table, rows[a : a + 10])
    assert held(table) == want and len(table.commits) == 4
    whole = compact(table)
    assert held(whole) == want and len(whole.commits) == 1 and compact(whole) is whole and whole.rows().columns == table.rows().columns
    late = put(spark, whole, [(i, "late", -1) for i in range(1, 6)])  # of documents without a text too
    assert held(late) == want and held(open_table(spark, str(tmp_path / "t"), 4)) == want
    assert held(put(spark, late, [])) == want


def test_a_batch_counts_once(spark, tmp_path):
    table = open_table(spark, str(tmp_path))
    one = put(spark, table, [(1, "a", 1), (1, "a", 1), (1, None, None)], stream="s", batch=0)
    assert put(spark, one, [(1, "b", 2)], stream="s", batch=0) is one and held(one) == [(1, 0, "a")]
    assert put(spark, one, [(1, "b", 2)], stream="other", batch=0).batches == {"s": 0, "other": 0}
    with pytest.raises(EngineError):
        put(spark, one, [(2, "c", 1)], stream="s", batch=1)  # another writer was faster
    assert held(open_table(spark, str(tmp_path))) == [(1, 0, "b")]


@pytest.mark.parametrize("after", [False, True])
def test_a_stream_dies_at_the_switch(spark, tmp_path, monkeypatch, after):
    """Between a batch's rows and its version, and between the version and the stream's own commit."""
    path, source, real = str(tmp_path / "t"), str(tmp_path / "in"), versions.switch
    batches = [[(1, "one", 1), (2, "two", 1)], [(1, "uno" * 700, 2), (3, "three", 1)], [(2, None, 2), (1, "stale", 1)]]
    died = []

    def dying(spark, path, version, holds):
        if version == 2 and not died:
            died.append(version)
            if after:
                real(spark, path, version, holds)
            raise RuntimeError("killed")
        real(spark, path, version, holds)

    monkeypatch.setattr(versions, "switch", dying)

    def run():
        schema = spark.createDataFrame([], DOCS).schema
        refresh(read_documents(spark, source, schema, 1), path, str(tmp_path / "state"), "s").awaitTermination()

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(source)
        if n == 1:
            with pytest.raises(Exception, match="killed"):
                run()
            assert held(open_table(spark, path)) == expected(batches[0] + batches[1] if after else batches[0])
        run()
        assert held(open_table(spark, path)) == expected(sorted((r for b in batches[: n + 1] for r in b), key=lambda r: r[2]))
    table = open_table(spark, path)
    assert died and (table.version, len(table.commits), table.batches) == (3, 3, {"s": 2})
    run()  # nothing new
    assert open_table(spark, path) == table and table.rows().where(F.col("content") == "stale").count() == 0
