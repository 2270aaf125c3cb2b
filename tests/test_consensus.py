import numpy as np
import pytest
from pyspark.sql import functions as F

from lumifield.functions.storage import store
from lumifield.operators import registration as reg

SCHEMA = "tile_id int, rank int, x double, y double, u double, v double"


def point_pairs(sizes, share, seed):
    """Pairs of a known affine with a given share of inliers, the rest anywhere."""
    rng = np.random.default_rng(seed)
    rows = []
    for tile, n in enumerate(sizes):
        for r in range(1, n + 1):
            x, y = rng.uniform(0, 400, 2)
            u, v = (1.02 * x - 0.03 * y + 4, 0.01 * x + 0.97 * y - 2) if rng.random() < share else rng.uniform(0, 400, 2)
            rows.append((tile, r, float(x), float(y), float(u), float(v)))
    return rows


def some_models(rows, seed, n=80):
    """Matrices near to and far from the known one, some of them equal."""
    rng = np.random.default_rng(seed)
    out = []
    for tile in sorted({r[0] for r in rows}):
        for t in range(n):
            off = 0 if t in (11, 40) else rng.normal(scale=rng.choice([0.5, 5, 100]))
            out.append((tile, t, 1.02, -0.03, 4.0 + off, 0.01, 0.97, -2.0))
    return out


def full_votes(rows, models, px):
    best = {}
    for tile, t, a, b, tx, c, d, ty in models:
        n = sum((a * x + b * y + tx - u) ** 2 + (c * x + d * y + ty - v) ** 2 <= px * px for g, _, x, y, u, v in rows if g == tile)
        if tile not in best or (n, -t) > (best[tile][1], -best[tile][0]):
            best[tile] = (t, n)
    return best


@pytest.mark.parametrize("pack", [40, 4096])
@pytest.mark.parametrize("share", [0.2, 0.9])
def test_same_winner_as_full_voting(spark, pack, share):
    rows = point_pairs([30, 150, 400, 41], share, 1)
    models = some_models(rows, 2)
    pairs = spark.createDataFrame(rows, SCHEMA)
    m = spark.createDataFrame(models, "tile_id int, try int, a double, b double, tx double, c double, d double, ty double")
    sizes = store(pairs.groupBy("tile_id").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    want = full_votes(rows, models, 3.0)
    got = {r.tile_id: (r["try"], r.inliers) for r in reg.most_inliers(m, pairs, sizes, ["tile_id"], 3.0, pack=pack).collect()}
    assert got == want
    # with a count to arrive at, only models that do can win
    known = spark.createDataFrame([(t, n + (t == 1)) for t, (_, n) in want.items()], "tile_id int, inliers bigint")
    again = {r.tile_id: (r["try"], r.inliers) for r in reg.most_inliers(m, pairs, sizes, ["tile_id"], 3.0, known, pack).collect()}
    assert {t: w for t, w in again.items() if t != 1} == {t: w for t, w in want.items() if t != 1}
    assert again.get(1, (0, 0))[1] <= want[1][1]


@pytest.mark.parametrize("pack", [50, 4096])
def test_affine_among_four_fifths_outliers(spark, pack):
    rows = point_pairs([160, 3], 0.2, 4)
    got = reg.fit_affine_robust(spark.createDataFrame(rows, SCHEMA), pack=pack).collect()
    assert [m.tile_id for m in got] == [0]
    a, b, tx, c, d, ty = (got[0][k] for k in reg.MATRIX)
    # within 3 px lie some of the 128 outliers too, so corners are held to half a pixel, not coefficients to many digits
    for x, y in ((0, 0), (400, 0), (0, 400), (400, 400)):
        want = (1.02 * x - 0.03 * y + 4, 0.01 * x + 0.97 * y - 2)
        assert np.hypot(a * x + b * y + tx - want[0], c * x + d * y + ty - want[1]) < 0.5


def test_no_pairs(spark):
    assert reg.fit_affine_robust(spark.createDataFrame([], SCHEMA)).count() == 0
