import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumifield.operators import cells, decode, intensity
from lumifield.operators.inspect import bead_at, grow_bbox, parse_bbox


def planes(spark, stack):
    """stack[cycle][channel] -> pixel table"""
    rows = [(k, c, y, x, int(a[y, x])) for k, cy in enumerate(stack) for c, a in enumerate(cy)
            for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "cycle int, channel int, y bigint, x bigint, v bigint")


def mock(seed=42, n=48, cycles=2, channels=4, beads=12):
    """Noise with a bright 6 x 6 patch per bead in one random fluorescent channel of each cycle."""
    rng = np.random.default_rng(seed)
    spots = sorted({(int(x), int(y)) for x, y in rng.integers(6, n - 6, (beads, 2))})
    stack = [[rng.integers(0, 4096, (n, n)) for _ in range(channels)] for _ in range(cycles)]
    for cy in stack:
        for x, y in spots:
            cy[rng.integers(1, channels)][y - 3:y + 3, x - 3:x + 3] += rng.integers(1000, 3000)
    return stack, spots


def plain_decode(stack, spots, thresholds, cutoff, noise, gate):
    out = {}
    for x, y in spots:
        calls = []
        for cy in stack:
            ref, b, snr, over = None, [], [], []
            for ch, img in enumerate(cy[1:], start=1):
                img = img.astype(float)
                if ref is None:
                    ref = img
                else:
                    sv, si, sc = np.unique(img, return_inverse=True, return_counts=True)
                    tv, tc = np.unique(ref, return_counts=True)
                    img = np.interp(np.cumsum(sc) / img.size, np.cumsum(tc) / ref.size, tv)[si].reshape(img.shape)
                roi = img[y - 2:y + 2, x - 2:x + 2]
                med, bg = np.median(roi), np.percentile(roi, 10)
                b.append(int(med))
                snr.append((med - bg) / bg if bg > 0 else 0)
                over.append(med > thresholds.get(ch, 0))
            bad = min(snr) > 1 - cutoff if noise == "every_high" else max(snr) < cutoff
            bad |= not all(over) if gate == "all_over" else not any(over)
            calls.append(255 if bad else int(np.argmax(b)))
        out[(x, y)] = tuple(calls)
    return out


@pytest.mark.parametrize("noise,gate", [("every_high", "all_over"), ("none_high", "any_over"), ("none_high", "all_over")])
def test_decode_equals_plain_arrays(spark, noise, gate):
    stack, spots = mock()
    thresholds = {1: 1500, 2: 1900, 3: 1200}
    beads = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "bead_id int, x bigint, y bigint")
    got = decode.decode_square(beads, planes(spark, stack), 2, thresholds=thresholds, cutoff=0.5, noise=noise, gate=gate)
    assert {(r.x, r.y): (r.cy0, r.cy1) for r in got.collect()} == plain_decode(stack, spots, thresholds, 0.5, noise, gate)


def test_gates_agree_only_when_all_channels_agree(spark):
    rows = [(b, 0, c, c - 1, 10 * c, 0.9, o) for b, flags in ((1, (True, True)), (2, (True, False)), (3, (False, False)))
            for c, o in zip((1, 2), flags)]
    sig = spark.createDataFrame(rows, "bead_id int, cycle int, channel int, chan_rank int, brightness int, snr double, over boolean")
    call = lambda g: {r.bead_id: r.call for r in decode.call_colours(sig, noise="off", gate=g).collect()}
    assert call("all_over") == {1: 1, 2: None, 3: None}
    assert call("any_over") == {1: 1, 2: 1, 3: None}
    wide = decode.calls_wide(decode.call_colours(sig, noise="off", gate="any_over"), 1, ["bead_id"])
    assert sorted(r.cy0 for r in wide.collect()) == [1, 1, 255]
    assert decode.drop_uncalled(wide).count() == 2 and decode.drop_uncalled(wide, compat=True).count() == 3


def test_first_of_equally_bright_channels_wins(spark):
    sig = spark.createDataFrame([(1, 0, r, 50, 0.0, True) for r in (2, 0, 1)], "bead_id int, cycle int, chan_rank int, brightness int, snr double, over boolean")
    assert decode.call_colours(sig, noise="off", gate="off").first().call == 0


def test_intensity_edge_cases(spark):
    flat = planes(spark, [[np.full((6, 6), 7)]])
    by = ["cycle", "channel"]
    assert {r.v for r in intensity.minmax_8bit(flat, by).collect()} == {0}
    assert {r.v for r in intensity.minmax_scale(flat, by).collect()} == {None}
    assert {r.v for r in intensity.contrast_unit(flat, by).collect()} == {0.0}
    kept = intensity.minmax_8bit(flat, by, already_8bit=F.lit(True))
    assert {r.v for r in kept.collect()} == {7}
    rng = np.random.default_rng(0)
    a, b = (planes(spark, [[rng.integers(0, 65535, (9, 9))]]) for _ in range(2))
    ncc = lambda p, q: intensity.ncc(p, q, by).first().ncc
    assert ncc(a, flat) == 0.0 and abs(ncc(a, a) - 1) < 1e-12 and abs(ncc(a, b) - ncc(b, a)) < 1e-12 and abs(ncc(a, b)) <= 1
    deep = planes(spark, [[np.array([[0, 65535], [65535, 0]] * 3)]])
    assert abs(ncc(deep, deep) - 1) < 1e-12


def test_nearest_site_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    pts = [(0, int(x), int(y)) for x, y in rng.integers(0, 30, (300, 2))] + [(1, 900, 900), (1, 5, 800)] + [(0, 700, 3)]
    qs = [(i, p, int(x), int(y)) for i, (p, x, y) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 1000, 60), rng.integers(0, 1000, 60)))]
    sites = spark.createDataFrame(pts, "protein_idx int, x int, y int")
    queries = spark.createDataFrame([(i, int(p), x, y) for i, p, x, y in qs], "label int, protein_idx int, gx int, gy int")
    got = {r.label: (r.d2, r.x, r.y) for r in cells.nearest_site(queries, sites, ["label"], ["protein_idx"], cell=8).collect()}
    want = {i: min(((x - a) ** 2 + (y - b) ** 2, a, b) for q, a, b in pts if q == p) for i, p, x, y in qs if any(q == p for q, _, _ in pts)}
    assert got == want


@pytest.mark.parametrize("side, shift", [(40, 0), (23000, 0), (300, -150), (2_000_000, -1_000_000)])
def test_nearest_site_at_every_image_side(spark, side, shift, monkeypatch):
    rng = np.random.default_rng(side)
    corner = [(0, int(x) + shift, int(y) + shift) for x, y in rng.integers(0, 30, (700, 2))]  # a hot protein in one corner
    wide = [(1, int(x) + shift, int(y) + shift) for x, y in rng.integers(0, side, (80, 2))]
    ring = [(2, 20 + 5 * a, 20 + 5 * b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))] * 2  # equal distances, repeated rows
    pts = corner + wide + ring
    qs = [(i, i % 4, int(x) + shift, int(y) + shift) for i, (x, y) in enumerate(rng.integers(0, side, (120, 2)))] + [(500, 2, 20, 20)]
    sites = spark.createDataFrame(pts, "protein_idx int, x int, y int")
    queries = spark.createDataFrame(qs, "label int, protein_idx int, gx int, gy int")
    stored = []
    keep = cells.store_observed
    monkeypatch.setattr(cells, "store_observed", lambda *a, **k: stored.append(a[1]) or keep(*a, **k))
    got = {r.label: (r.d2, r.x, r.y) for r in cells.nearest_site(queries, sites, ["label"], ["protein_idx"]).collect()}
    want = {i: min(((x - a) ** 2 + (y - b) ** 2, a, b) for q, a, b in pts if q == p) for i, p, x, y in qs if p < 3}
    assert got == want
    assert stored == ["sites", "boxes", "boxes", "boxes"]  # as many rounds at any side


@pytest.mark.parametrize("empty", ["queries", "sites"])
def test_nearest_site_of_nothing(spark, empty):
    sites = spark.createDataFrame([(0, 1, 1)], "protein_idx int, x int, y int")
    queries = spark.createDataFrame([(1, 0, 2, 2)], "label int, protein_idx int, gx int, gy int")
    none = {"queries": (queries.where("false"), sites), "sites": (queries, sites.where("false"))}[empty]
    out = cells.nearest_site(*none, ["label"], ["protein_idx"])
    assert out.count() == 0 and out.columns == ["label", "protein_idx", "d2", "x", "y"]


def adjusted(img, x, y, compat=False):
    core, ring = img[y - 2:y + 3, x - 2:x + 3], img[y - 7:y + 8, x - 7:x + 8].astype(float)
    med = np.median(core)
    if ring.shape != (15, 15):
        return med
    if compat:
        ring[y - 2:y + 3, x - 2:x + 3] = np.nan
    else:
        ring[5:10, 5:10] = np.nan
    around = np.nanmean(ring)
    if around > 1.5 * core.mean() and med > 5000:
        med = med - (0.8266 * core.mean() ** 2 / around + 3970.1) + 2000
    return max(med, 1)


@pytest.mark.parametrize("compat", [False, True])
def test_adjusted_median(spark, compat):
    rng = np.random.default_rng(9)
    img = rng.integers(9000, 20000, (40, 40))
    img[8:14, 8:14] = rng.integers(5000, 6000, (6, 6))
    img[25:30, 25:30] = 0
    spots = [(10, 10), (9, 12), (27, 27), (20, 9), (36, 20)]
    pos = spark.createDataFrame(spots, "x bigint, y bigint")
    protein = spark.createDataFrame([(y, x, int(img[y, x])) for y in range(40) for x in range(40)], "y bigint, x bigint, v bigint")
    got = {(r.x, r.y): r.intensity for r in cells.bead_intensity(pos, protein, compat=compat).collect()}
    for x, y in spots:
        assert abs(got[(x, y)] - adjusted(img, x, y, compat)) < 1e-6


def test_position_whose_core_lies_outside_the_image(spark):
    pos = spark.createDataFrame([(5, 22), (5, 21), (23, 23), (5, 27), (60, 60)], "x bigint, y bigint")
    protein = spark.createDataFrame([(y, x, 100) for y in range(20) for x in range(20)], "y bigint, x bigint, v bigint")
    got = {(r.x, r.y): r.intensity for r in cells.bead_intensity(pos, protein).collect()}
    assert got == {(5, 22): None, (5, 21): 100.0, (23, 23): None}


@pytest.mark.parametrize("side", [26, 29])
def test_adjusted_median_equals_sql_where_beads_stand_over_the_edge(spark, tmp_path, side):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as contract

    n = side * side - 3
    spark.range(n).selectExpr("id AS event_id", "CAST(id % 173 AS DOUBLE) AS value").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT x, y, intensity FROM ({contract.oracle_sql()['c07_adjusted_median']})").fetchall()
    got = contract.queries()["c07_adjusted_median"](spark, str(tmp_path)).select("x", "y", "intensity").collect()
    place = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got), key=place) == sorted(want, key=place)
    assert (None in {v for _, _, v in want}) == (side == 26)


def test_cell_table_by_hand(spark):
    img = np.full((60, 60), 100)
    img[10:15, 10:15], img[30:35, 30:35] = 400, 800
    protein = spark.createDataFrame([(y, x, int(img[y, x])) for y in range(60) for x in range(60)], "y bigint, x bigint, v bigint")
    labels = spark.createDataFrame([(y, x, 1 if y < 20 else 4 if y >= 28 else 0) for y in range(60) for x in range(60)], "y bigint, x bigint, label bigint")
    code = spark.createDataFrame([("A", 0, None, 0), ("B", 1, None, 1), (None, None, None, None)], "protein string, cy0 int, note string, cy1 int")
    beads = spark.createDataFrame([(12, 12, 0, 0), (32, 32, 1, 1), (12, 12, 0, 0)], "x bigint, y bigint, cy0 int, cy1 int")
    out = {r.cell_id: r for r in cells.build_cell_table(beads, labels, protein, code, max_size=60).collect()}
    assert set(out) == {1, 4}
    assert out[1].__fields__ == ["cell_id", "global_x", "global_y", "A", "Protein_1", "Protein_2", "B"]
    assert (out[1].A, out[1].B, out[4].A, out[4].B) == (400, 800, 400, 800)  # two of them filled from afar
    assert out[1].Protein_1 is None and (out[1].global_x, out[1].global_y) == (29, 9)


def test_cell_inputs_are_checked(spark):
    ok = spark.createDataFrame([(1, 1, 1)], "y int, x int, label int")
    img = spark.createDataFrame([(1, 1, 1)], "y int, x int, v int")
    code = spark.createDataFrame([("A", 0)], "protein string, cy0 int")
    beads = spark.createDataFrame([(1, 1, 0)], "x int, y int, cy0 int")
    cells.check_inputs(beads, ok, img, code)
    with pytest.raises(ValueError, match="empty"):
        cells.check_inputs(beads.where("false"), ok, img, code)
    with pytest.raises(ValueError, match="lacks"):
        cells.check_inputs(beads.drop("cy0"), ok, img, code)
    with pytest.raises(TypeError):
        cells.check_inputs(beads, ok, img, code.withColumn("cy0", F.lit("red")))


def test_code_words_stay_apart_beyond_ten_colours(spark):
    code = spark.createDataFrame([("A", 11, 0), ("B", 1, 10)], "protein string, cy0 int, cy1 int")
    words = cells.code_words(code)
    assert words.count() == 144 and words.select("code").distinct().count() == 144


def test_word_index_and_digits_are_inverse(spark):
    cols = ["cy0", "cy1", "cy2"]
    words = list(itertools.product(range(4), repeat=3))
    df = spark.createDataFrame([(i, *w) for i, w in enumerate(words)] + [(-1, 0, 4, 0), (-1, 255, 0, 0), (-1, None, 0, 0)], "i int, cy0 int, cy1 int, cy2 int")
    rows = df.withColumn("idx", cells.word_index(cols, 4)).collect()
    assert all(r.idx == (r.i if r.i >= 0 else None) for r in rows)
    back = spark.range(64).select("id", *cells.word_digits("id", cols, 4)).collect()
    assert all((r.cy0, r.cy1, r.cy2) == words[r.id] for r in back)
    big = spark.createDataFrame([(10 ** 8 - 1,)], "id bigint").select(*cells.word_digits("id", [f"c{i}" for i in range(8)], 10)).first()
    assert tuple(big) == (9,) * 8


def long_code_case(spark, named):
    """8 cycles of 10 colours: 10^8 words, of which three beads have one each."""
    cols = [f"cy{i}" for i in range(8)]
    img = np.full((40, 40), 100)
    img[5:20, 5:20], img[5:20, 21:36], img[22:37, 5:20] = 300, 500, 700
    protein = spark.createDataFrame([(y, x, int(img[y, x])) for y in range(40) for x in range(40)], "y bigint, x bigint, v bigint")
    labels = spark.createDataFrame([(y, x, 1) for y in range(40) for x in range(40)], "y bigint, x bigint, label bigint")
    schema = ", ".join(f"{c} int" for c in cols)
    code = spark.createDataFrame([(f"P{i}", *[(i // 10 ** k) % 10 for k in range(7, -1, -1)]) for i in named], f"protein string, {schema}")
    digits = lambda i: [(i // 10 ** k) % 10 for k in range(7, -1, -1)]
    beads = spark.createDataFrame(
        [(12, 12, *digits(7)), (28, 12, *digits(12345678)), (12, 29, *digits(99999999)), (28, 29, *[255] * 8)], f"x bigint, y bigint, {schema}")
    return beads, labels, protein, code


def test_long_codes_need_no_row_or_column_per_word(spark, monkeypatch):
    monkeypatch.setattr(cells, "code_words", None)  # not called
    beads, labels, protein, code = long_code_case(spark, [7, 99999999, 5])
    out = cells.build_cell_table(beads, labels, protein, code, max_size=40)
    assert out.columns == ["cell_id", "global_x", "global_y", "P5", "P7", "P99999999", "other_proteins"]
    r = out.first()
    assert (r.P5, r.P7, r.P99999999, r.other_proteins) == (None, 300, 700, {"Protein_12345678": 500})
    medians, centroids, names = cells.cell_protein_values(beads, labels, protein, code, max_size=40)
    assert {(n.protein_idx, n.code, n["name"]) for n in names.collect()} == {
        (7, 7, "P7"), (12345678, 12345678, "Protein_12345678"), (99999999, 99999999, "P99999999")}
    narrow = cells.cell_table(medians, centroids, code, max_columns=2).first()
    assert narrow.__fields__ == ["cell_id", "global_x", "global_y", "other_proteins"]
    assert narrow.other_proteins == {"P7_7": 300, "P99999999_99999999": 700, "Protein_12345678": 500}


def test_codes_beyond_64_bits_are_refused(spark):
    cols = ", ".join(f"cy{i} int" for i in range(20))
    code = spark.createDataFrame([("A", *[9] * 20)], f"protein string, {cols}")
    with pytest.raises(ValueError, match="64 bits"):
        cells.code_space(code)
    with pytest.raises(ValueError, match="empty"):
        cells.code_space(code.where("false"))


def test_inspector(spark):
    beads = spark.createDataFrame([(5, 3, 4, "(-2, 1, 9, 50)"), (2, 3, 4, "(0, 0, 1, 1)")], "bead_id int, x int, y int, bbox string")
    ask = spark.createDataFrame([(1, 3, 4), (2, 9, 9)], "request_id int, x int, y int")
    hit = bead_at(ask, beads, ["bbox"]).collect()
    assert [(h.request_id, h.bead_id) for h in hit] == [(1, 2)]
    box = parse_bbox(beads.where("bead_id = 5"), F.lit(20), F.lit(30))
    r = box.first()
    assert (r.y1, r.x1, r.y2, r.x2) == (0, 1, 9, 29)
    g = grow_bbox(box, 2.0).first()
    assert (g.x1, g.x2, g.y1, g.y2) == (int(15.0 - 28), int(15.0 + 28), int(4.5 - 9), int(4.5 + 9))
