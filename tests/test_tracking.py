"""Dense blocks and the key-point tracker: pyramids, known warps, and a plain tracker on whole images."""

import numpy as np
import pandas as pd
import pytest

from lumifield.functions import blocks as B
from lumifield.operators import tracking as T


def smooth(n, seed, grain=3):
    """A soft random image of n x n, 8 bits."""
    a = np.random.default_rng(seed).random((n, n))
    for _ in range(grain):
        a = sum(np.roll(a, k, 0) for k in (-1, 0, 1)) / 3
        a = sum(np.roll(a, k, 1) for k in (-1, 0, 1)) / 3
    a -= a.min()
    return np.round(a / a.max() * 255)


def table(spark, img, **keys):
    y, x = np.indices(img.shape)
    pdf = pd.DataFrame({**{k: v for k, v in keys.items()}, "y": y.ravel(), "x": x.ravel(), "v": img.ravel().astype(np.int64)})
    return spark.createDataFrame(pdf)


def sample(img, y, x):
    y, x = np.clip(y, 0, img.shape[0] - 1), np.clip(x, 0, img.shape[1] - 1)
    i, j = np.minimum(y.astype(int), img.shape[0] - 2), np.minimum(x.astype(int), img.shape[1] - 2)
    fy, fx = y - i, x - j
    return (img[i, j] * (1 - fx) + img[i, j + 1] * fx) * (1 - fy) + (img[i + 1, j] * (1 - fx) + img[i + 1, j + 1] * fx) * fy


def half(img):
    a = np.pad(img, 2, mode="reflect").astype(float)
    k = np.array([1, 4, 6, 4, 1]) / 16
    a = np.apply_along_axis(lambda r: np.convolve(r, k, "valid"), 0, a)
    return np.floor(np.apply_along_axis(lambda r: np.convolve(r, k, "valid"), 1, a)[::2, ::2] + 0.5)


def plain(source, target, y, x, side, levels, most, eps=0.03):
    """One point, by the book."""
    pyr = [(source, target)]
    for _ in range(levels):
        pyr.append(tuple(half(i) for i in pyr[-1]))
    v = np.zeros(2)
    k = np.arange(-(side // 2), side // 2 + 1.0)
    for level in reversed(range(levels + 1)):
        s, t = pyr[level]
        py, px = y / 2**level, x / 2**level
        dy, dx = np.meshgrid(k, k, indexing="ij")
        at = lambda a, b: sample(s, py + dy + a, px + dx + b)
        gx = (3 * (at(-1, 1) - at(-1, -1)) + 10 * (at(0, 1) - at(0, -1)) + 3 * (at(1, 1) - at(1, -1))) / 32
        gy = (3 * (at(1, -1) - at(-1, -1)) + 10 * (at(1, 0) - at(-1, 0)) + 3 * (at(1, 1) - at(-1, 1))) / 32
        g = np.array([[np.mean(gx * gx), np.mean(gx * gy)], [np.mean(gx * gy), np.mean(gy * gy)]])
        if np.linalg.eigvalsh(g)[0] < 0.1024:
            return None
        last = np.zeros(2)
        for _ in range(most):
            off = at(0, 0) - sample(t, py + dy + v[1], px + dx + v[0])
            step = np.linalg.solve(g, [np.mean(off * gx), np.mean(off * gy)])
            if (abs(step + last) < 0.01).all():
                v += step / 2
                break
            v, last = v + step, step
            if step @ step <= eps * eps:
                break
        if level:
            v = 2 * v
    return v


def test_blocks_hold_the_margin_and_refuse_gaps(spark):
    img = smooth(70, 1)
    px = table(spark, img, file="a").unionByName(table(spark, img[:33, :50] + 1, file="b"))
    for r in B.blocks(px, ["file"], 5, 32).collect():
        whole = img if r.file == "a" else img[:33, :50] + 1
        a = np.frombuffer(r.data, "<f4").reshape(r.ny, r.nx)
        y0, x0 = max(0, r.ky * 32 - 5), max(0, r.kx * 32 - 5)
        assert (r.oy, r.ox, r.h, r.w) == (y0, x0, *whole.shape)
        assert (a == whole[y0 : r.ky * 32 + 37, x0 : r.kx * 32 + 37]).all()
    with pytest.raises(Exception, match="gaps"):
        B.blocks(px.where("NOT (y = 3 AND x = 4)"), ["file"], 5, 32)
    assert B.blocks(px.where("false"), ["file"], 5, 32).count() == 0


@pytest.mark.parametrize("shape", [(70, 301), (5, 3), (256, 256)])
def test_pyramid_level(spark, shape):
    img = smooth(301, 2)[: shape[0], : shape[1]]
    got = T.halve(table(spark, img), []).toPandas()
    want = half(img)
    out = np.full(want.shape, -1.0)
    out[got.y, got.x] = got.v
    assert len(got) == want.size and (out == want).all()


MAPS = {"shift": ((1, 0, 2.6), (0, 1, -1.3)), "turn": ((1.01, 0.015, 3.2), (-0.012, 0.99, 4.1)), "far": ((1, 0, 21.5), (0, 1, -17.25))}


@pytest.mark.parametrize("name", list(MAPS))
def test_known_warps_are_found(spark, name):
    n, m = 200, np.array(MAPS[name])
    big = smooth(n + 80, 5, 120 if name == "far" else 6)  # far steps need coarse texture
    y, x = np.indices((n, n))
    back = np.linalg.inv(m[:, :2])
    u, v = np.stack([x - m[0, 2], y - m[1, 2]]), None
    sx, sy = np.tensordot(back, u, 1)
    source, target = np.round(sample(big, y + 40.0, x + 40.0)), np.round(sample(big, sy + 40, sx + 40))
    rng = np.random.default_rng(6)
    pts = pd.DataFrame({"tile_id": 0, "rank": np.arange(1, 61), "x": rng.integers(50, 150, 60), "y": rng.integers(50, 150, 60)})
    got = T.track(spark.createDataFrame(pts), table(spark, source), table(spark, target)).toPandas()
    want = np.stack([got.x, got.y, np.ones(len(got))], 1) @ m.T
    off = np.hypot(got.u - want[:, 0], got.v - want[:, 1])
    best = got[got.set == 2].index
    assert len(best) >= 60 and (off[best] < 0.1).mean() > 0.97
    for r in got.iloc[:: max(1, len(got) // 12)].itertuples():  # and as a plain tracker finds it
        side, levels, most = T.TRACK_SETS[r.set]
        p = plain(source, target, r.y, r.x, side, levels, most)
        assert abs(r.x + p[0] - r.u) < 2e-3 and abs(r.y + p[1] - r.v) < 2e-3
    fit = T.tracked_affine(spark.createDataFrame(got)).first()
    assert fit.inliers >= 55 and np.allclose([fit.a, fit.b, fit.c, fit.d], m[:, :2].ravel(), atol=2e-3)
    assert np.allclose([fit.tx + 100 * fit.a + 100 * fit.b, fit.ty + 100 * fit.c + 100 * fit.d], m @ [100, 100, 1], atol=0.1)


def test_points_without_gradient_and_outside_are_lost(spark):
    img = np.zeros((90, 90))
    img[40:50, 40:50] = 200
    pts = spark.createDataFrame([(0, 1, 45, 45), (0, 2, 10, 80), (0, 3, 400, 45), (0, 4, 45, 20)], "tile_id int, rank int, x int, y int")
    got = T.track(pts, table(spark, img), table(spark, np.roll(img, 2, 1)), sets=[(15, 0, 10)]).collect()
    assert [r.rank for r in got] == [1] and abs(got[0].u - 47) < 0.1 and abs(got[0].v - 45) < 0.1
    assert T.track(pts.where("false"), table(spark, img), table(spark, img)).count() == 0


def test_planes_are_followed_apart(spark):
    a, b = smooth(80, 11, 5), smooth(80, 12, 5)
    move = lambda i, s: sample(i, *np.meshgrid(np.arange(80.0), np.arange(80) - s, indexing="ij"))
    source = table(spark, a, slide=1, cycle=1).unionByName(table(spark, b, slide=2, cycle=1))
    target = table(spark, np.round(move(a, 1.5)), slide=1).unionByName(table(spark, np.round(move(b, -2.25)), slide=2))
    pts = spark.createDataFrame([(s, 1, 0, k, 30 + 4 * k, 40) for s in (1, 2) for k in range(1, 6)], "slide int, cycle int, tile_id int, rank int, x int, y int")
    for r in T.track(pts, source, target, ["slide", "cycle", "tile_id"], ["slide", "cycle"], ["slide"], sets=[(21, 2, 20)]).collect():
        assert abs(r.u - r.x - (1.5 if r.slide == 1 else -2.25)) < 0.1 and abs(r.v - r.y) < 0.1
