import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumifield.operators import regions as R

BY = ["file"]


def flood(mask):
    """Least (y, x) of each 8-connected region, by plain search."""
    label = np.full(mask.shape, -1, dtype=np.int64)
    for y, x in np.argwhere(mask):
        if label[y, x] >= 0:
            continue
        stack, label[y, x] = [(y, x)], y * R.ROW_STRIDE + x
        while stack:
            a, b = stack.pop()
            for c in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                for d in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                    if mask[c, d] and label[c, d] < 0:
                        label[c, d] = y * R.ROW_STRIDE + x
                        stack.append((c, d))
    return label


def table(spark, *masks):
    rows = [(f"f{k}", int(y), int(x)) for k, m in enumerate(masks) for y, x in np.argwhere(m)]
    return spark.createDataFrame(rows, "file string, y bigint, x bigint")


def snake(n):
    """One region winding through the whole image: crosses every block border many times."""
    m = np.zeros((n, n), bool)
    m[::2] = True
    for k, y in enumerate(range(1, n, 2)):
        m[y, -1 if k % 2 == 0 else 0] = True
    return m


def test_components_across_blocks_and_files(spark):
    rng = np.random.default_rng(1)
    masks = [rng.random((40, 40)) < p for p in (0.15, 0.4, 0.7)] + [snake(40)]
    got = R.components(table(spark, *masks), BY, block=8).collect()
    labels = [flood(m) for m in masks]
    assert len(got) == sum(m.sum() for m in masks)
    for r in got:
        assert r.label == labels[int(r.file[1:])][r.y, r.x]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.floats(0.2, 0.6))
def test_block_size_does_not_matter(spark, seed, density):
    mask = np.random.default_rng(seed).random((18, 18)) < density
    want = flood(mask)
    got = R.components(table(spark, mask), BY, block=5).collect()
    assert all(r.label == want[r.y, r.x] for r in got)


def test_border_and_area_filters(spark):
    m = np.zeros((20, 20), bool)
    m[0:3, 0:3] = m[5:8, 5:8] = m[10, 10] = m[17:20, 4] = True
    lab = R.components(table(spark, m), BY, block=4)
    size = spark.createDataFrame([("f0", 20, 20)], "file string, h int, w int")
    inner = {(r.y, r.x) for r in R.clear_border(lab, size, BY).collect()}
    assert inner == {(y, x) for y in range(5, 8) for x in range(5, 8)} | {(10, 10)}
    big = {(r.y, r.x) for r in R.area_at_least(lab, 4, BY).collect()}
    assert len(big) == 18 and (10, 10) not in big


@pytest.mark.parametrize("size", [1, 2, 3, 31])
def test_closing(spark, size):
    rng = np.random.default_rng(5)
    m = np.zeros((300, 280), bool)
    m[:40, :40] = rng.random((40, 40)) < 0.35  # up to the border
    m[110:140, 120:150] = rng.random((30, 30)) < 0.2  # across blocks
    m[299, 279] = m[280, 250] = True
    lo, hi, pad = size // 2, size - size // 2 - 1, 2 * size
    wide, grow = np.pad(m, pad), np.zeros(np.array(m.shape) + 2 * pad, bool)
    for y, x in np.argwhere(wide):
        grow[y - lo:y + hi + 1, x - lo:x + hi + 1] = True
    seen = np.lib.stride_tricks.sliding_window_view(grow, (size, size)).all((2, 3))
    want = {(int(y) + lo - pad, int(x) + lo - pad) for y, x in np.argwhere(seen)}
    assert {(q.y, q.x) for q in R.binary_close(table(spark, m, np.zeros((3, 3), bool)), size, BY).collect()} == want
    assert R.binary_close(table(spark, m).where("false"), size, BY).count() == 0


def test_equal_centres_keep_the_lowest_label(spark):
    ring = [(y, x) for y in range(0, 7) for x in range(0, 7) if max(abs(y - 3), abs(x - 3)) == 3]
    rows = [("f0", y, x, 5) for y, x in ring + [(3, 3)]]
    df = spark.createDataFrame(rows, "file string, y bigint, x bigint, v bigint")
    beads = R.bead_table(R.components(df, BY), BY).collect()
    assert [(b.x, b.y, b.label) for b in beads] == [(3, 3, 0)]


def test_edge_and_range_forms(spark):
    b = spark.createDataFrame([(4, 50), (5, 50), (95, 50), (96, 50)], "x int, y int")
    xs = lambda df: sorted(r.x for r in df.collect())
    assert xs(R.inside_edges(b, 2, 100)) == [5, 95]
    assert xs(R.inside_edges(b, 2, 100, closed_low=True)) == [4, 5, 95]
    assert xs(R.range_filter(b, 4, 96)) == [5, 95]
    assert xs(R.range_filter(b, 4, 96, literal=True)) == [0, 4, 5, 95]
