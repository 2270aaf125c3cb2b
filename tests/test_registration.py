import numpy as np
import pytest
from pyspark.sql import functions as F

from lumifield.functions.stats import plane_size
from lumifield.operators import registration as reg
from lumifield.operators import tiles


def image(spark, arr, **keys):
    cols = list(keys)
    rows = [(*keys.values(), y, x, int(arr[y, x])) for y in range(arr.shape[0]) for x in range(arr.shape[1])]
    kinds = ", ".join(f"{c} {'string' if isinstance(keys[c], str) else 'int'}" for c in cols)
    return spark.createDataFrame(rows, f"{kinds + ', ' if cols else ''}y bigint, x bigint, v bigint")


def array(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.y, r.x] = r.v
    return out


@pytest.mark.parametrize("chunk", [7, 2000])
def test_two_nearest_equals_brute_force(spark, chunk):
    rng = np.random.default_rng(0)
    groups = np.where(rng.random(120) < 0.5, 0, rng.integers(1, 4, 120))  # one hot group
    vecs = rng.normal(size=(120, 6))
    noisy = vecs + rng.normal(scale=0.3, size=vecs.shape)
    q = spark.createDataFrame([(int(g), i, v.tolist()) for i, (g, v) in enumerate(zip(groups, noisy))], "tile_id int, q_id int, q_vec array<double>")
    c = spark.createDataFrame([(int(g), i, v.tolist()) for i, (g, v) in enumerate(zip(groups, vecs))], "tile_id int, c_id int, c_vec array<double>")
    near = {}
    for r in reg.two_nearest(q, c, chunk=chunk).collect():
        near.setdefault(r.q_id, {})[r["rank"]] = (r.c_id, r.dist)
    good = {r.q_id: r.c_id for r in reg.ratio_matches(reg.two_nearest(q, c, chunk=chunk)).collect()}
    want_good, per_group = {}, {}
    for i in range(120):
        ids = np.flatnonzero(groups == groups[i])
        d = np.sqrt(((noisy[i] - vecs[ids]) ** 2).sum(1))
        order = np.argsort(d)
        for k in range(min(2, len(ids))):
            assert near[i][k + 1][0] == ids[order[k]] and abs(near[i][k + 1][1] - d[order[k]]) < 1e-9
        if len(ids) > 1 and d[order[0]] < 0.7 * d[order[1]]:
            want_good[i] = ids[order[0]]
            per_group[groups[i]] = per_group.get(groups[i], 0) + 1
    assert good == {i: c for i, c in want_good.items() if per_group[groups[i]] >= 4}


def test_shift_search_finds_the_planted_shift(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1000, (24, 24))
    moved = np.roll(base, (1, -2), axis=(0, 1))
    inner = image(spark, moved, tile_id=0).where("y BETWEEN 3 AND 20 AND x BETWEEN 3 AND 20")
    scores = reg.shift_search(image(spark, base), inner, radius=2)
    best = reg.best_shift(scores).first()
    assert (best.dy, best.dx) == (1, -2) and abs(best.ncc - 1) < 1e-12
    assert scores.where("abs(ncc) > 1.0000001").count() == 0 and scores.count() == 25


def test_warp_by_whole_pixels_is_a_shift(spark):
    arr = np.random.default_rng(3).integers(1, 99, (12, 12))
    px = image(spark, arr, file="a", channel=0)
    m = spark.createDataFrame([("a", 1.0, 0.0, 2.0, 0.0, 1.0, -3.0)], "file string, a double, b double, tx double, c double, d double, ty double")
    got = array(reg.warp(px, m, plane_size(px, ["file"]), ["file", "channel"], ["file"]), (12, 12))
    want = np.zeros((12, 12))
    want[:9, 2:] = arr[3:, :10]
    assert np.allclose(got, want)


def test_align_undoes_tile_shifts_and_identity_keeps_the_image(spark):
    arr = np.random.default_rng(4).integers(1, 5000, (40, 40))
    px = image(spark, arr, file="a", channel=0)
    windows = tiles.tile_windows(tiles.tile_grid(plane_size(px, ["file"]), 4, ["file"]), 3)
    none = windows.select("file", "tile_id", *[F.lit(None).cast("double").alias(c) for c in reg.MATRIX])
    same = reg.align_stack(px, windows, none, ["file", "channel"], ["file"], 4)
    assert np.array_equal(array(same, (40, 40)), arr)
    moved = image(spark, np.roll(arr, (1, 1), axis=(0, 1)), file="a", channel=0)
    back = windows.select("file", "tile_id", *[F.lit(v).alias(c) for c, v in zip(reg.MATRIX, (1.0, 0.0, -1.0, 0.0, 1.0, -1.0))])
    got = array(reg.align_stack(moved, windows, back, ["file", "channel"], ["file"], 4), (40, 40))
    assert np.array_equal(got[:39, :39], arr[:39, :39])
    parts = tiles.pixels_by_tile(px, plane_size(px, ["file"]), 4, 3, ["file", "channel"], ["file"])
    assert np.array_equal(array(tiles.stitch(parts, windows, px, ["file", "channel"], ["file"]), (40, 40)), arr)


def test_robust_affine_ignores_outliers(spark):
    rng = np.random.default_rng(5)
    rows = []
    for tile in (0, 1):
        for r in range(1, 41):
            x, y = map(float, rng.uniform(0, 100, 2))
            u, v = 1.02 * x - 0.03 * y + 4 + tile, 0.01 * x + 0.97 * y - 2
            if r % 4 == 0:
                u += 40
            rows.append((tile, r, x, y, u, v))
    pairs = spark.createDataFrame(rows, "tile_id int, rank int, x double, y double, u double, v double")
    for m in reg.fit_affine_robust(pairs).collect():
        assert np.allclose([m.a, m.b, m.tx, m.c, m.d, m.ty], [1.02, -0.03, 4 + m.tile_id, 0.01, 0.97, -2], atol=1e-6)
    plain = reg.fit_affine(pairs).where("tile_id = 0").first()
    assert abs(plain.tx - 4) > 1


def test_staged_choice_and_early_stop_agree(spark):
    ncc = {0: (0.9, 0.95, 0.99), 1: (0.4, 0.7, 0.9), 2: (0.4, 0.3, 0.8), 3: (-0.2, -0.1, -0.3), 4: (0.55, 0.9, 0.5), 5: (0.2, 0.55, 0.56)}
    want = {0: (1, 0.9), 1: (2, 0.7), 2: (3, 0.8), 3: (None, 0.0), 4: (1, 0.55), 5: (3, 0.56)}
    rows = [(t, s + 1, float(s), v) for t, vs in ncc.items() for s, v in enumerate(vs)]
    cand = spark.createDataFrame(rows, "tile_id int, stage int, a double, ncc double")
    got = {r.tile_id: (r.stage, r.ncc) for r in reg.pick_candidate(cand).collect()}
    assert got == want
    asked = []

    def stage(number):
        def run(todo):
            asked.append(sorted(r.tile_id for r in todo.collect()))
            return cand.where(F.col("stage") == number).drop("stage").join(todo, "tile_id", "left_semi")
        return run

    out = reg.cascade(cand.select("tile_id"), [stage(1), stage(2), stage(3)])
    assert {r.tile_id: (r.stage, r.ncc) for r in out.collect()} == want
    assert asked == [[0, 1, 2, 3, 4, 5], [1, 2, 3, 5], [2, 3, 4, 5]]


def test_weak_tiles_take_the_last_good_transform(spark):
    rows = [("f", t, float(t), n) for t, n in enumerate((0.1, 0.8, 0.2, 0.29, 0.5, 0.0))]
    df = spark.createDataFrame(rows, "file string, tile_id int, a double, ncc double")
    out = reg.carry_forward(df, ["file"], ["a"]).orderBy("tile_id").collect()
    assert [r.a for r in out] == [None, 1.0, 1.0, 1.0, 4.0, 4.0]


def test_pairing_needs_enough_points(spark):
    pts = lambda n: spark.createDataFrame([(t, r, r, r) for t, k in ((0, n), (1, 3)) for r in range(1, k + 1)], "tile_id int, rank int, x int, y int")
    out = reg.pair_by_rank(pts(6), pts(5))
    assert out.count() == 5 and out.where("tile_id = 1").count() == 0


def test_robust_affine_finds_one_clean_pair_in_five(spark):
    rng = np.random.default_rng(8)
    rows = []
    for tile in range(3):
        for r in range(1, 61):
            x, y = map(float, rng.uniform(0, 400, 2))
            u, v = (1.02 * x - 0.03 * y + 4, 0.01 * x + 0.97 * y - 2) if rng.random() < 0.2 or r <= 6 else rng.uniform(0, 400, 2)
            rows.append((tile, r, x, y, float(u), float(v)))
    pairs = spark.createDataFrame(rows, "tile_id int, rank int, x double, y double, u double, v double")
    got = reg.fit_affine_robust(pairs).collect()
    assert len(got) == 3
    for m in got:
        assert np.allclose([m.a, m.b, m.tx, m.c, m.d, m.ty], [1.02, -0.03, 4, 0.01, 0.97, -2], atol=1e-6)


def every_shift(fixed, known, moving, there, y0, x0, reach):
    """(dy, dx, ncc) of the best shift, by trying each."""
    best = None
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            a, b = [], []
            for i, j in np.argwhere(there):
                y, x = i + y0 - dy, j + x0 - dx
                if 0 <= y < fixed.shape[0] and 0 <= x < fixed.shape[1] and known[y, x]:
                    a.append(fixed[y, x])
                    b.append(moving[i, j])
            if a:
                a, b = np.array(a, float), np.array(b, float)
                va, vb = ((v - v.mean()) ** 2 for v in (a, b))
                ncc = round(float(((a - a.mean()) * (b - b.mean())).sum() / np.sqrt(va.sum() * vb.sum())), 9) if va.sum() > 0 and vb.sum() > 0 else 0.0
                if best is None or ncc > best[2]:
                    best = dy, dx, ncc
    return best


@pytest.mark.parametrize("depth", [200, 65535])
def test_best_of_all_shifts(spark, depth):
    rng, rows = np.random.default_rng(depth), []
    fixed = rng.integers(0, depth, (23, 31))
    want = {}
    for tile, (y0, x0, h, w) in enumerate([(0, 0, 9, 8), (14, 20, 9, 11), (5, 7, 6, 6), (10, 0, 5, 31)]):
        moving, there = rng.integers(0, depth, (h, w)), rng.random((h, w)) < 0.8
        if tile == 2:
            moving[:] = 7  # no contrast: all shifts are alike
        rows += [(tile, int(y0 + i), int(x0 + j), int(moving[i, j])) for i, j in np.argwhere(there)]
        want[tile] = every_shift(fixed, np.ones(fixed.shape, bool), moving, there, y0, x0, 4)
    moving = spark.createDataFrame([*rows, (9, 500, 500, 3)], "tile_id int, y long, x long, v long")  # tile 9 meets nothing
    got = {r.tile_id: (r.dy, r.dx, r.ncc, r.on_rim) for r in reg.search_shifts(image(spark, fixed), moving, reach=4).collect()}
    assert got.keys() == want.keys()
    for t, (dy, dx, ncc) in want.items():
        assert got[t][:2] == (dy, dx) and abs(got[t][2] - ncc) < 2e-9 and got[t][3] == (max(abs(dy), abs(dx)) == 4)


def test_shift_of_a_tile_at_full_reach(spark):
    """A tile of 100 pixels and a reach of 250: the sums equal those of the shifts compared one by one."""
    rng = np.random.default_rng(12)
    fixed = rng.integers(0, 65536, (640, 620))
    dy, dx = -231, 198
    y0, x0 = 270, 270  # nearer to the edge a few pixels that happen to agree would win
    moved = np.clip(fixed[y0 - dy : y0 - dy + 100, x0 - dx : x0 - dx + 100] + rng.integers(-4000, 4000, (100, 100)), 0, 65535)
    b, known = np.zeros((600, 600), np.int64), np.zeros((600, 600), bool)
    ys, xs = np.arange(y0 - 250, y0 + 350), np.arange(x0 - 250, x0 + 350)
    oky, okx = (ys >= 0) & (ys < 640), (xs >= 0) & (xs < 620)
    b[np.ix_(oky, okx)], known[np.ix_(oky, okx)] = fixed[np.ix_(ys[oky], xs[okx])], True
    ncc = reg.correlations(moved, np.ones((100, 100), bool), b, known)[::-1, ::-1]
    assert np.unravel_index(np.nanargmax(ncc), ncc.shape) == (dy + 250, dx + 250)
    for sy, sx in [(dy, dx), (0, 0), (250, -250), (-250, 250), (37, -12), (250, 250)]:
        ok = known[250 - sy : 350 - sy, 250 - sx : 350 - sx]
        f, m = b[250 - sy : 350 - sy, 250 - sx : 350 - sx][ok].astype(float), moved[ok].astype(float)
        got = ncc[sy + 250, sx + 250]
        assert np.isnan(got) if not ok.any() else abs(got - np.corrcoef(f, m)[0, 1]) < 1e-9


def test_search_reaches_sixty_pixels_and_reports_the_rim(spark):
    arr = np.random.default_rng(6).integers(1, 5000, (160, 160))
    smooth = sum(np.roll(arr, (i, j), axis=(0, 1)) for i in range(6) for j in range(6)) // 36
    fixed = image(spark, smooth)
    moved = image(spark, np.roll(smooth, (60, -37), axis=(0, 1))).where("y >= 60 AND x < 123").withColumn("tile_id", F.lit(0))
    got = reg.search_shifts(fixed, moved, reach=64).first()
    assert (got.dy, got.dx, got.on_rim) == (60, -37, False)


def test_planes_with_gaps_are_refused(spark):
    from lumifield.operators import stencil

    px = image(spark, np.ones((6, 6), int), file="a").where("x <> 2")
    for width in (3, 27):
        with pytest.raises(Exception, match="gaps"):
            stencil.blur(px, stencil.box(width), ["file"]).collect()
    with pytest.raises(Exception, match="gaps"):
        reg.shift_search(px.drop("file"), px.withColumn("tile_id", F.lit(0)), radius=1).collect()
