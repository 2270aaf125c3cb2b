"""The samples of a window or box join are never broadcast, however small Spark takes them for."""

import pytest
from pyspark.sql import functions as F

from lumifield.functions import lookup
from lumifield.functions.lookup import box_join, window_join

POINTS = [(i, 3 + 5 * (i % 6), 2 + 7 * (i % 4)) for i in range(24)]


@pytest.fixture
def px(spark, tmp_path):
    """32 x 32 samples in 12 planes, made from 1,024 stored rows."""
    spark.range(1024).write.parquet(str(tmp_path / "sites"))
    sites = spark.read.parquet(str(tmp_path / "sites")).selectExpr("id div 32 AS y", "id % 32 AS x")
    return sites.withColumn("cycle", F.explode(F.array(*map(F.lit, range(3))))).withColumn(
        "channel", F.explode(F.array(*map(F.lit, range(4))))).selectExpr("*", "y * 100 + x + cycle + channel AS v")


def points(spark, more=1):
    """More points than samples, as far as Spark can tell from the stored bytes."""
    return spark.range(24 * more).selectExpr("id", "3 + 5 * (id % 6) AS py", "2 + 7 * (id % 4) AS px")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def joined(kind, pts, px):
    if kind == "window":
        return window_join(pts, px, 4, 4)
    return box_join(pts.selectExpr("id", "py - 4 AS y0", "py + 4 AS y1", "px - 4 AS x0", "px + 4 AS x1"), px)


@pytest.mark.parametrize("kind", ["window", "box"])
def test_few_points_are_broadcast_and_not_the_samples(spark, px, kind):
    plan = final_plan(joined(kind, points(spark, 400), px).groupBy("id").count())
    assert "BroadcastHashJoin" in plan and "BuildRight" not in plan


@pytest.mark.parametrize("kind", ["window", "box"])
def test_many_points_are_merged(spark, px, kind, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 50)
    plan = final_plan(joined(kind, points(spark), px).groupBy("id").count())
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("most", [0, 200_000])
@pytest.mark.parametrize("kind", ["window", "box"])
def test_same_samples_either_way(spark, px, kind, most, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", most)
    got = sorted(tuple(r) for r in joined(kind, points(spark), px).select("id", "y", "x", "cycle", "channel", "v").collect())
    want = sorted((i, y, x, k, c, y * 100 + x + k + c) for i, py, qx in POINTS for k in range(3) for c in range(4)
                  for y in range(max(py - 4, 0), min(py + 4, 32)) for x in range(max(qx - 4, 0), min(qx + 4, 32)))
    assert got == want


def test_no_point_at_all(spark, px):
    assert joined("window", points(spark, 0), px).count() == 0
