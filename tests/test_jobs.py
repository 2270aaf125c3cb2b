"""Whole jobs over several slides must equal the same jobs slide by slide."""

import numpy as np
import pytest

from lumifield.operators import decode
from lumifield.plans import jobs


def slide_arrays(seed, n=64):
    """Brightfield with discs, three fluorescent channels, three cycles; cycles 1 and 2 are shifted."""
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[:n, :n]
    bf = rng.integers(900, 1100, (n, n))
    stack = [[bf] + [rng.integers(300, 400, (n, n)) for _ in range(3)] for _ in range(3)]
    for cy in range(6, n - 6, 9):
        for cx in range(6, n - 6, 9):
            jy, jx = cy + int(rng.integers(-1, 2)), cx + int(rng.integers(-1, 2))
            disc = (yy - jy) ** 2 + (xx - jx) ** 2 <= 4
            bf[disc] = 20000 + rng.integers(0, 900)
            for k in range(3):
                stack[k][1 + rng.integers(0, 3)][disc] = 9000
    return stack


def pixels(spark, slides):
    rows = [(s, k, c, y, x, int(a[y, x])) for s, stack in slides.items() for k, cy in enumerate(stack)
            for c, a in enumerate(cy) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "slide string, cycle int, channel int, y bigint, x bigint, v bigint")


def catalogue(spark, slides):
    return spark.createDataFrame([(s, k, 0, 4) for s in slides for k in range(3)], "slide string, cycle int, reference_channel int, n_channels int")


@pytest.fixture(scope="module")
def slides():
    return {"a": slide_arrays(1), "b": slide_arrays(2, 48)}


def test_beads_of_two_slides(spark, slides):
    got = {tuple(r) for r in jobs.generate_beads(pixels(spark, slides), 3, cutoff=-100).select("slide", "x", "y", "cy0", "cy1", "cy2", "bbox").collect()}
    assert {r[0] for r in got} == {"a", "b"}
    for s in slides:
        alone = decode.decode_regions(pixels(spark, {s: slides[s]}).drop("slide"), 3, cutoff=-100)
        assert {r[1:] for r in got if r[0] == s} == {tuple(r) for r in alone.select("x", "y", "cy0", "cy1", "cy2", "bbox").collect()}


def test_alignment_undoes_a_shift_per_cycle(spark, slides):
    shift = {1: (3, -2), 2: (-4, 5)}
    moved = {s: [st[0]] + [[np.roll(a, shift[k], axis=(0, 1)) for a in st[0]] for k in (1, 2)] for s, st in slides.items()}
    px = pixels(spark, moved)
    out = jobs.align_to_reference(px, catalogue(spark, moved), n=2, overlap=8, levels=3)
    got = {}
    for r in out.collect():
        got.setdefault((r.slide, r.cycle, r.channel), {})[(r.y, r.x)] = r.v
    for s, st in slides.items():
        n = st[0][0].shape[0]
        for k in (0, 1, 2):
            for c, a in enumerate(st[0]):
                plane = got[(s, k, c)]
                assert len(plane) == n * n
                assert all(plane[(y, x)] == a[y, x] for y in range(6, n - 6) for x in range(6, n - 6))


def test_shading_flattens_a_gradient(spark, slides):
    n = 63
    ramp = np.tile(np.linspace(2000, 60000, n), (n, 1)).astype(int) + np.random.default_rng(0).integers(0, 4000, (n, n))
    px = pixels(spark, {"a": [[np.clip(ramp, 0, 65535)]]})
    out = jobs.correct_shading(px, catalogue(spark, ["a"]).where("cycle = 0"))
    img = np.zeros((n, n))
    for r in out.collect():
        img[r.y, r.x] = r.v
    left, right = img[:, 5:20].mean(), img[:, -20:-5].mean()
    assert abs(right - left) < 0.7 * abs(ramp[:, -20:-5].mean() - ramp[:, 5:20].mean())
    assert img.max() <= 255 * 256 and (img % 256 == 0).all()


def test_cells_of_two_slides(spark):
    img = np.full((40, 40), 100)
    img[8:13, 8:13], img[28:33, 28:33] = 400, 800
    slides = ("a", "b")
    protein = spark.createDataFrame([(s, y, x, int(img[y, x]) * (2 if s == "b" else 1)) for s in slides for y in range(40) for x in range(40)], "slide string, y bigint, x bigint, v bigint")
    labels = spark.createDataFrame([(s, y, x, 1 if y < 20 else 2) for s in slides for y in range(40) for x in range(40)], "slide string, y bigint, x bigint, label bigint")
    code = spark.createDataFrame([("A", 0), ("B", 1)], "protein string, cy0 int")
    beads = spark.createDataFrame([("a", 10, 10, 0), ("a", 30, 30, 1), ("b", 10, 10, 1)], "slide string, x bigint, y bigint, cy0 int")
    got = {(r.slide, r.label, r.protein): r.value for r in jobs.cell_proteins(beads, labels, protein, code, 40).collect()}
    assert got == {("a", 1, "A"): 400, ("a", 2, "B"): 800, ("a", 1, "B"): 800, ("a", 2, "A"): 400, ("b", 1, "B"): 800, ("b", 2, "B"): 800}


def test_each_file_has_its_own_reference_working_image_and_size(spark, slides):
    """Slide b keeps its brightfield in channel 2 in cycle 1; slide c lists a channel that it doesn't have."""
    swap = [slides["b"][0], [slides["b"][1][c] for c in (2, 1, 0, 3)], slides["b"][2]]
    px = pixels(spark, {"a": slides["a"], "b": swap, "c": slides["b"]})
    files = spark.createDataFrame(
        [(s, k, 2 if (s, k) == ("b", 1) else 9 if s == "c" else 0, 4, 40 if s == "a" else 10_000, 2 if (s, k) == ("a", 0) else 0)
         for s in "abc" for k in range(3)], "slide string, cycle int, reference_channel int, n_channels int, max_size int, working_ndim int")
    work = px.where("slide = 'a' AND cycle = 0 AND channel = 0").withColumn("v", px.v + 100)
    got = jobs.generate_beads(px, 3, files=files, working=work, cutoff=-100)
    rows = {tuple(r) for r in got.select("slide", "x", "y", "cy0", "cy2").collect()}
    plain = jobs.generate_beads(pixels(spark, {"b": slides["b"]}), 3, cutoff=-100)
    assert {r[1:] for r in rows if r[0] == "b"} == {tuple(r) for r in plain.select("x", "y", "cy0", "cy2").collect()}
    assert {r[0] for r in rows} == {"a", "b"} and all(r[1] < 40 and r[2] < 40 for r in rows if r[0] == "a")
    done = {(r.slide, r.status is not None) for r in jobs.mark_generated(files, got).collect()}
    assert done == {("a", True), ("b", True), ("c", False)}


def test_pixels_of_unlisted_images_stop_the_job(spark, slides):
    from lumifield.operators import catalog

    px = pixels(spark, {"a": [[np.zeros((4, 4), int)]]})
    files = spark.createDataFrame([("b", 0, 0, 5)], "slide string, cycle int, reference_channel int, working_ndim int")
    with pytest.raises(Exception, match="no such image"):
        catalog.with_working_image(px, px.where("false"), files, jobs.FILE).collect()


def test_stored_tables_can_be_removed(spark, slides):
    import os

    from lumifield.functions.storage import scratch, shared_folder

    def tables():
        return set(os.listdir(shared_folder(spark).removeprefix("file:")))

    spark.range(1).count()
    before = tables() if os.path.isdir(shared_folder(spark).removeprefix("file:")) else set()
    with scratch(spark):
        assert jobs.generate_beads(pixels(spark, {"b": slides["b"]}), 3).count() >= 0
        assert tables() - before
    assert tables() <= before


def test_transforms_are_tracked_then_bent(spark):
    """Cycle 1 is turned and moved by fractions of a pixel; cycle 2 has nothing in common with the fixed image."""
    from tests.test_tracking import sample, smooth

    n, m = 110, np.array([[1.004, 0.01, 1.6], [-0.008, 0.997, -2.3]])
    fixed, turned = smooth(n, 21, 4), None
    y, x = np.indices((n, n)).astype(float)
    turned = np.round(sample(fixed, m[1, 0] * x + m[1, 1] * y + m[1, 2], m[0, 0] * x + m[0, 1] * y + m[0, 2]))  # moving(p) = fixed(m p)
    noise = np.random.default_rng(5).integers(0, 255, (n, n))
    stack = [[(img * 40).astype(int)] for img in (fixed, turned, noise)]
    px, files = pixels(spark, {"s": stack}), spark.createDataFrame([("s", k, 0, 1) for k in range(3)], "slide string, cycle int, reference_channel int, n_channels int")
    found = {(r.cycle, r.tile_id): r for r in jobs.find_transforms(px, files, n=2, overlap=10, reach=3).collect()}
    assert len(found) == 8
    for (cycle, _), r in found.items():
        if cycle == 1:
            assert r.stage == 1 and r.ncc > 0.8 and np.allclose([r.a, r.b, r.c, r.d], m[:, :2].ravel(), atol=0.01)
        else:
            assert r.ncc < 0.5 and r.stage in (None, 1, 2, 3)
