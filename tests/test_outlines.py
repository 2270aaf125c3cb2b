"""Outlines of regions and holes against a plain border tracer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumifield.operators import outlines as O
from lumifield.operators import regions as R
from tests.test_regions import BY, flood, table

RING = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))  # clockwise on the screen


def trace(inside, start, came):
    """Pixels of the border of ``inside`` from ``start``, walked with the pixel ``came`` outside it on one hand."""
    out, at, look = [], start, RING.index((came[0] - start[0], came[1] - start[1]))
    while True:
        for turn in range(1, 9):
            d = RING[(look + turn) % 8]
            if inside(at[0] + d[0], at[1] + d[1]):
                break
        else:
            return [start]
        step = (at, d)
        if out and step == out[0]:
            return [p for p, _ in out]
        out.append(step)
        back = RING[(look + turn - 1) % 8]
        free = at[0] + back[0], at[1] + back[1]
        at = at[0] + d[0], at[1] + d[1]
        look = RING.index((free[0] - at[0], free[1] - at[1]))


def polygon(points):
    """Area, first moments and length of a closed walk."""
    a = mx = my = length = 0.0
    for (y, x), (v, u) in zip(points, points[1:] + points[:1]):
        c = x * v - u * y
        a, mx, my, length = a + c / 2, mx + c * (x + u) / 6, my + c * (y + v) / 6, length + np.hypot(x - u, y - v)
    s = -1 if a < 0 else 1
    return (s * a, s * mx, s * my, length)


def background(mask):
    """Least pixel of each 4-connected piece of the background, with a ring of background around the image."""
    free = np.pad(~mask, 1, constant_values=True)
    label = np.full(free.shape, -1, np.int64)
    for y, x in np.argwhere(free):
        if label[y, x] < 0:
            stack, label[y, x] = [(y, x)], (y - 1) * R.ROW_STRIDE + x - 1
            while stack:
                a, b = stack.pop()
                for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                    if 0 <= c < free.shape[0] and 0 <= d < free.shape[1] and free[c, d] and label[c, d] != label[y, x]:
                        label[c, d] = label[y, x]
                        stack.append((c, d))
    return label


def traced(mask):
    """(label, hole, parent, m00, m10, m01, length) of every region and hole."""
    label, free, out = flood(mask), background(mask), {}
    outside = free[0, 0]
    at = lambda y, x: 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x]
    for k in np.unique(label[label >= 0]):
        y, x = divmod(int(k), R.ROW_STRIDE)
        inside = lambda a, b: at(a, b) and label[a, b] == k
        up = free[y, x + 1]  # of the pixel above
        out[int(k)] = (False, None if up == outside else int(up), *polygon(trace(inside, (y, x), (y - 1, x))))
    for k in np.unique(free[(free >= 0) & (free != outside)]):
        y, x = divmod(int(k), R.ROW_STRIDE)
        owner = label[y - 1, x]
        inside = lambda a, b: at(a, b) and label[a, b] == owner
        out[int(k)] = (True, int(owner), *polygon(trace(inside, (y - 1, x), (y, x))))
    return out


def rings(n, *radii):
    y, x = np.mgrid[:n, :n] - n // 2
    m = np.zeros((n, n), bool)
    for r in radii:
        m |= np.maximum(abs(y), abs(x)) == r
    return m


def drawn(text):
    return np.array([[c == "#" for c in row] for row in text.split()])


def masks():
    rng = np.random.default_rng(3)
    diamond = np.add.outer(abs(np.arange(11) - 5), abs(np.arange(11) - 5)) == 4
    return [rings(9, 3), rings(23, 10, 6, 2), rings(15, 6, 0), diamond, *(rng.random((26, 33)) < p for p in (0.3, 0.5, 0.62, 0.75)),
            drawn("##### #...# #.#.# #...# #####"), drawn(".#. #.# .#."), drawn(".##.. #..#. .##.# ..#.# ...#."), drawn("#"), drawn("###### #.##.# ##..## ######"),
            rng.random((40, 7)) < 0.6]


@pytest.mark.parametrize("block", [5, 16, 128])
def test_outlines_equal_a_border_tracer(spark, block):
    every = masks()
    got = {}
    for r in O.outlines(R.components(table(spark, *every), BY, block=7), BY, block).collect():
        got.setdefault(int(r.file[1:]), {})[r.label] = (r.hole, r.parent, r.m00, r.m10, r.m01, r.length)
    for k, m in enumerate(every):
        want = traced(m)
        assert got[k].keys() == want.keys()
        for label, w in want.items():
            assert got[k][label][:2] == w[:2] and np.allclose(got[k][label][2:], w[2:], atol=1e-9), (k, label)


def test_no_regions(spark):
    none = spark.createDataFrame([], "file string, y bigint, x bigint, label bigint")
    assert O.outlines(none, BY).collect() == []


def test_hollow_blobs_are_key_points_and_what_lies_in_them_is_not(spark):
    got = [(r.x, r.y, r.area, round(r.circularity, 2)) for r in O.top_blobs(R.components(table(spark, rings(9, 3), rings(15, 6, 0)), BY), BY).collect()]
    assert sorted(got) == [(4, 4, 36.0, 0.79), (7, 7, 144.0, 0.79)]


def test_holes_make_beads_in_the_second_pass(spark):
    n = 48
    img = np.zeros((n, n), int)
    img[8:26, 20:38] = 250
    img[12:20, 23:31] = 0  # a hole off the middle of the blob
    px = spark.createDataFrame([("f0", y, x, int(img[y, x])) for y in range(n) for x in range(n)], "file string, y bigint, x bigint, v bigint")
    known = spark.createDataFrame([("f0", 40, 5)], "file string, y bigint, x bigint")
    assert {(r.x, r.y) for r in O.second_pass(px, known, BY).collect()} == {(5, 40), (28, 16), (26, 16)}


def test_outline_of_known_shapes(spark):
    m = np.zeros((30, 30), bool)
    m[2:7, 2:7] = True                       # 5 x 5 square: outline 4 x 4
    for dy, dx in [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4]:
        m[15 + dy, 15 + dx] = True           # disc: diamond with diagonal 4
    m[25, 3:9] = True                        # line: no area, length there and back
    m[25, 20] = True                         # point
    out = {r.label: r for r in O.contour_moments(R.components(table(spark, m), BY), BY).collect()}
    sq, disc = out[2 * R.ROW_STRIDE + 2], out[13 * R.ROW_STRIDE + 15]
    assert (sq.m00, sq.length) == (16.0, 16.0) and abs(sq.m10 / sq.m00 - 4) < 1e-9
    assert disc.m00 == 8.0 and abs(disc.length - 8 * 2 ** 0.5) < 1e-9 and abs(disc.m01 / disc.m00 - 15) < 1e-9
    line, point = out[25 * R.ROW_STRIDE + 3], out[25 * R.ROW_STRIDE + 20]
    assert (line.m00, line.length, point.m00, point.length) == (0.0, 10.0, 0.0, 0.0)



def test_second_pass_finds_what_was_left(spark):
    n = 40
    img = np.zeros((n, n), int)
    for cy, cx in ((10, 10), (25, 30)):
        img[cy - 2:cy + 3, cx - 2:cx + 3] = 250
    px = spark.createDataFrame([("f0", y, x, int(img[y, x])) for y in range(n) for x in range(n)],
                               "file string, y bigint, x bigint, v bigint")
    known = spark.createDataFrame([("f0", 10, 10)], "file string, y bigint, x bigint")
    got = {(r.x, r.y) for r in O.second_pass(px, known, BY).collect()}
    assert got == {(10, 10), (30, 25)}
    assert px.agg(F.count("*")).first()[0] == n * n
