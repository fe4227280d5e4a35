"""Deep pages are those of a whole sort, and only a range around them is sorted."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.errors import EngineError
from millrace.operators import paging
from millrace.operators.paging import deep_page, page_after, page_range, sort_columns


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "a", "b", "", "é"]), rng.choice([None, float("nan"), -0.0, 0.0, 1.5, float("-inf")]), rng.choice([None, 1, 2])) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, s string, x double, n int").repartition(5).cache()


@pytest.mark.parametrize("order", [["id desc"], ["s", "id"], ["s desc", "x", "id desc"], ["n", "x desc", "s", "id"]])
def test_pages_are_those_of_a_sort(table, order):
    every = [r.id for r in table.orderBy(*sort_columns(order)).collect()]
    rows = {r.id: r for r in table.collect()}
    for offset in (30, 1503, 2995):
        got = deep_page(table, order, 10, offset, most=100).collect()
        assert [r.id for r in got] == every[offset : offset + 10] and all(r.total == 3000 for r in got)
    for at in (0, 2995):
        last = rows[every[at]]
        assert [r.id for r in page_after(table, order, [last[o.split()[0]] for o in order], 10).collect()] == every[at + 1 : at + 11]


def test_a_range_is_sorted(spark, monkeypatch):
    monkeypatch.setattr(paging, "MARKS", 64)
    rows = spark.range(0, 2_000_000, 1, 8).select((F.col("id") * 7919 % 2_000_003).alias("id"))
    found, before, total = page_range(rows, ["id"], 50, 1_700_000, most=5000)
    assert total == 2_000_000 and before <= 1_700_000 and 50 <= found.count() <= 5000 and rows.join(found.agg(F.min("id").alias("first")), F.col("id") < F.col("first")).count() == before
    plan = deep_page(rows, ["id"], 50, 1_700_000, most=5000)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "TakeOrdered" in plan


def test_equal_rows_and_none(spark):
    same = spark.range(500).select(F.lit(1).alias("k"))
    assert deep_page(same, ["k"], 10, 300, most=20).count() == 10 and deep_page(same, ["k"], 10, 495, most=20).count() == 5
    assert deep_page(same.limit(0), ["k"], 10, 300, most=20).count() == 0
    for bad in (lambda: deep_page(same, ["k"], 0, 300, most=20), lambda: page_after(same, ["k"], [1, 2], 5), lambda: deep_page(same, ["k"], 5, -1)):
        with pytest.raises(EngineError):
            bad()
