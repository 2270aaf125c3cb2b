import numpy as np
from pyspark.sql import functions as F

from lumifield.functions.lookup import attach, window_join
from lumifield.functions.stats import grouped_median, percentiles, running_index
from lumifield.functions.storage import shared_folder


def test_grouped_median_is_exact_with_one_hot_group(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.normal(300, 2, 4001)] + [(f"g{k % 40}", float(v)) for k, v in enumerate(rng.uniform(-50, 9000, 1500))]
    got = {r.k: r.m for r in grouped_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m").collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    assert got.keys() == by.keys()
    for k, vs in by.items():
        assert abs(got[k] - np.median(vs)) < 1e-12


def test_percentiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(4)
    vals = rng.integers(0, 500, 3000)
    df = spark.createDataFrame([(0, int(v)) for v in vals], "p int, v bigint")
    row = percentiles(df, ["p"], "v", {"a": 2, "b": 98, "c": 50}).first()
    assert np.allclose([row.a, row.b, row.c], np.percentile(vals, [2, 98, 50]))


def test_running_index_counts_inside_groups(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "(id * 7919) % 5000 AS k")
    out = running_index(df, ["g"], [F.col("k")], "i").toPandas()
    for _, part in out.groupby("g"):
        assert part.sort_values("k")["i"].tolist() == list(range(len(part)))


def test_attach_gives_the_same_rows_small_and_large(spark):
    rows = spark.range(2000).selectExpr("id % 5 AS k", "id AS y", "id * 3 AS x")
    table = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k bigint, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        small = attach(rows, table, ["k"], how)
        large = attach(rows, table, ["k"], how, max_rows=0)
        assert sorted(map(str, small.collect())) == sorted(map(str, large.select(*small.columns).collect()))
    assert "Broadcast" not in attach(rows, table, ["k"], max_rows=0).where("y > 3")._jdf.queryExecution().optimizedPlan().toString()


def test_window_join_equals_range_condition(spark):
    px = spark.range(400).selectExpr("id div 20 AS y", "id % 20 AS x", "id AS v")
    pts = spark.createDataFrame([(1, 0, 0), (2, 7, 13), (3, 19, 19), (4, 10, 4)], "id int, py bigint, px bigint")
    got = {(r.id, r.v) for r in window_join(pts, px, 3, 4).select("id", "v").collect()}
    want = {(i, y * 20 + x) for i, py, qx in ((1, 0, 0), (2, 7, 13), (3, 19, 19), (4, 10, 4))
            for y in range(20) for x in range(20) if py - 3 <= y < py + 4 and qx - 3 <= x < qx + 4}
    assert got == want


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
