"""The elastic step: known bends are undone, and the composed transform is applied by the stitch."""

import numpy as np

from lumifield.operators import elastic as E
from lumifield.operators import registration as reg
from lumifield.operators import tiles
from tests.test_tracking import sample, smooth, table


def bent(n, seed, size=4.0, move=(0, 0)):
    """(fixed, moving, bend) with fixed(p) = moving(p + bend(p)), away from the edges."""
    y, x = np.indices((n, n)).astype(float)
    uy, ux = size * np.sin(np.pi * y / n) * np.sin(2 * np.pi * x / n) + move[0], size * np.cos(np.pi * x / n) * np.sin(np.pi * y / n) + move[1]
    moving = smooth(n, seed, 12)
    return np.round(sample(moving, y + uy, x + ux)), moving, (uy, ux)


def test_known_bend_is_undone():
    fixed, moving, (uy, ux) = bent(160, 3)
    before = E.correlation(fixed, moving)
    wy, wx, ncc = E.fit_bend(fixed, moving)
    got = [reg.bend_at(w.ravel(), np.arange(160), np.arange(160), 160, 160) for w in (wy, wx)]
    core = (slice(16, -16),) * 2
    assert ncc > before + 0.1
    assert np.abs(got[0] - uy)[core].mean() < 0.02 and np.abs(got[1] - ux)[core].mean() < 0.02


def test_nothing_to_bend():
    flat, img = np.full((40, 30), 7.0), smooth(40, 1)[:, :30]
    for a, b in ((flat, img), (img, flat), (flat, flat), (img[:1], img[:1])):
        wy, wx, ncc = E.fit_bend(a, b)
        assert not wy.any() and not wx.any() and np.isfinite(ncc)
    wy, wx, ncc = E.fit_bend(img, img)
    assert ncc > 1 - 1e-9 and np.abs(wy).max() < 0.05


def test_splines_are_a_partition_of_one():
    b = reg.spline_basis(np.arange(33), 33, 8)
    assert b.shape == (33, 11) and np.allclose(b.sum(1), 1) and (b >= 0).all()


def test_composed_bends_are_applied_by_the_stitch(spark):
    n, overlap = 120, 10
    fixed, moving, _ = bent(n, 9, 3.0, (1.0, -2.0))
    px = table(spark, moving, file="f", channel=0).unionByName(table(spark, moving * 2 + 5, file="f", channel=1))
    windows = tiles.tile_windows(tiles.tile_grid(spark.createDataFrame([("f", n, n)], "file string, h int, w int"), 2, ["file"]), overlap)
    start = windows.selectExpr("file", "tile_id", "1.0D AS a", "0.0D AS b", "2.0D AS tx", "0.0D AS c", "1.0D AS d", "-1.0D AS ty")
    target = E.tile_images(table(spark, fixed, file="f"), windows, None, ["file"], ["file"])
    moved = E.tile_images(px.where("channel = 0").drop("channel"), windows, start, ["file"], ["file"])
    plain = {r.tile_id: r.ncc for r in E.compare(target, moved, ["file", "tile_id"]).collect()}
    bends = E.bend(target, moved, ["file", "tile_id"]).cache()
    after = {r.tile_id: r.ncc for r in bends.collect()}
    assert len(plain) == 4 and all(after[t] > plain[t] for t in plain)
    out = reg.align_stack(px, windows, start.join(bends.drop("ncc"), ["file", "tile_id"]), ["file", "channel"], ["file"], 2).toPandas()
    for c, want in ((0, fixed), (1, fixed * 2 + 5)):
        img = np.zeros((n, n))
        part = out[out.channel == c]
        img[part.y, part.x] = part.v
        core = (slice(12, -12),) * 2
        assert len(part) == n * n and E.correlation(img[core], want[core]) > 0.98
