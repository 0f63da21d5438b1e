"""Large views and windows run in as many tasks as their rows ask for, with the same results."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import blocks
from tidemark.operators import climatology as cl
from tidemark.operators import grid
from tidemark.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("view", [tables.stack, tables.sites])
def test_views_spread_by_their_lines(spark, monkeypatch, view):
    plain = sorted(map(tuple, view(spark, SF).collect()), key=str)
    lines = tables.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(blocks, "TASK_ROWS", 300)
    spread = view(spark, SF)
    assert spread.rdd.getNumPartitions() == -(-lines // 300) == tables.line_tasks(spark, SF)
    got = sorted(map(tuple, spread.collect()), key=str)
    assert [r[:2] for r in got] == [r[:2] for r in plain]
    assert all(x == pytest.approx(y) for a, b in zip(got, plain, strict=True) for x, y in zip(a, b, strict=True) if isinstance(x, float))


def test_opening_and_brackets_in_tasks(spark):
    mask = spark.range(4000).select((F.col("id") % 2).alias("k"), (F.col("id") % 37).cast("int").alias("row"), (F.col("id") % 29).cast("int").alias("col"), F.xxhash64("id").alias("h")).where("h % 5 != 0").drop("h").distinct()
    assert blocks.tasks_for(mask) is None
    eroded = grid.erode(mask, ["k"], 1, 13)
    assert eroded.rdd.getNumPartitions() == 13
    plain, many = (sorted(map(tuple, grid.opening(mask, ["k"], 1, 37, 29, t).collect())) for t in (None, 13))
    assert plain == many and plain
    series = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).alias("t"), F.col("id").alias("v"))
    targets = spark.range(100).select((F.col("id") % 3).alias("k"), (F.col("id") * 11).alias("target"))
    plain, many = (sorted(map(tuple, cl.asof_bracket(series, targets, ["k"], "t", ["v"], F.floor(F.col("t") / 100), t).collect()), key=str) for t in (None, 13))
    assert plain == many and len(plain) == 100
