"""Registered queries: one per operator, each over whole tables derived from the given ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumifield.functions import constants as K
from lumifield.functions.stats import grouped_median, plane_size
from lumifield.functions.storage import shared_folder
from lumifield.operators import catalog, cells, clahe, decode, elastic, inspect, intensity, outlines, regions, registration, stencil, tiles, tracking
from lumifield.plans import fixtures as fx
from lumifield.sources import stacks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PLANE = ("cycle", "channel")
THRESHOLDS = {1: 320, 2: 340, 3: 360}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(column: str):
    return (F.round(F.col(column).cast("double"), 6) + F.lit(0.0)).alias(column)


# ---- shared steps ---------------------------------------------------------------------------
def gray8(spark: SparkSession, sf: str) -> DataFrame:
    return intensity.minmax_8bit(fx.brightfield(spark, sf), PLANE)


def bright_regions(spark: SparkSession, sf: str) -> DataFrame:
    return regions.components(intensity.above_otsu(fx.brightfield(spark, sf), PLANE), PLANE)


def bead_signal(spark: SparkSession, sf: str) -> DataFrame:
    px = fx.pixels(spark, sf, channels=[1, 2, 3])
    sig = decode.signal(decode.square_samples(fx.beads(spark, sf), px), ("bead_id",), THRESHOLDS)
    return sig.withColumn("chan_rank", F.col("channel") - 1)


def called_beads(spark: SparkSession, sf: str) -> DataFrame:
    calls = decode.call_colours(bead_signal(spark, sf), noise="every_high", gate="off")
    wide = decode.drop_uncalled(decode.calls_wide(calls, 3, ["bead_id"]))
    return fx.beads(spark, sf).join(wide, "bead_id")


def share_of_side(spark: SparkSession, sf: str, part: int, whole: int) -> Column:
    """A share of the image side, as a single value of the plan."""
    side = fx.brightfield(spark, sf).agg((F.max("y") + 1).alias("w"))
    return side.select(F.floor(F.col("w") * part / whole).alias("s")).scalar()


def grid4(spark: SparkSession, sf: str) -> DataFrame:
    """4 x 4 tiles of every cycle's image."""
    size = plane_size(fx.pixels(spark, sf, channels=[0]), ["cycle"])
    return tiles.tile_grid(size, 4, ["cycle"])


def tile4(df: DataFrame) -> DataFrame:
    return df.withColumn("tile_id", (F.col("tile_i") * 4 + F.col("tile_j")).cast("int")).drop("tile_i", "tile_j")


def shifts(spark: SparkSession, sf: str, radius: int = 2) -> DataFrame:
    return registration.shift_search(
        fx.brightfield(spark, sf).drop(*PLANE), tile4(fx.moving_pixels(spark, sf)), ["tile_id"], radius)


def key_points(px: DataFrame, k: int = 500) -> DataFrame:
    """Key points per 4 x 4 tile from thresholded samples (columns y, x, tile_id)."""
    return outlines.top_blobs(regions.components(px, ["tile_id"]), ["tile_id"], k)


def tiled_brightfield(spark: SparkSession, sf: str) -> DataFrame:
    bf = fx.brightfield(spark, sf)
    w = bf.agg((F.max("y") + 1).alias("w")).scalar()
    return bf.select(*bf.columns, w.alias("w")).selectExpr(
        "y", "x", "v", "CAST((x*4 div w)*4 + y*4 div w AS INT) AS tile_id")


# ---- sources and sinks ----------------------------------------------------------------------
@query
def s01_list_stacks(spark, sf):
    paths = fx.listing(spark, sf)
    return stacks.not_seen(stacks.in_folder(paths.select("path"), "/d"), paths.where("seen"))


@query
def s02_stack_info(spark, sf):
    return stacks.stack_info(fx.pixels(spark, sf), ["cycle"])


@query
def s03_load_stack(spark, sf):
    """Cycle 1, read back from the stored stacks of all cycles."""
    path = f"{shared_folder(spark)}/stacks-{uuid.uuid4().hex}"
    stacks.write_stack(fx.pixels(spark, sf).withColumn("file", F.lit("f")), path)
    return stacks.read_stack(spark, path, cycles=[1]).select("y", "x", "cycle", "channel", "v")


@query
def s04_crop(spark, sf):
    return stacks.crop(fx.pixels(spark, sf, [0]), share_of_side(spark, sf, 9, 10))


def _export(spark, sf):
    files = catalog.with_defaults(fx.stack_files(spark, sf))
    return stacks.export_rows(fx.pixels(spark, sf), fx.working_pixels(spark, sf), files, ["cycle"])


@query
def s05_export_stacks(spark, sf):
    return _export(spark, sf)


@query
def s06_bead_export(spark, sf):
    box = regions.bbox_text(F.col("y") - 2, F.col("x") - 2, F.col("y") + 1, F.col("x") + 1)
    return tables.bead_rows(called_beads(spark, sf).withColumn("bbox", box), 3)


@query
def s08_bead_reload(spark, sf):
    rows = tables.parse_bead_lines(tables.bead_lines(s06_bead_export(spark, sf), 3), 3)
    beads, boxes = tables.split_bbox(rows)
    return beads.join(boxes, ["x", "y"])


# ---- catalogue ------------------------------------------------------------------------------
@query
def m01_apply_metadata(spark, sf):
    files = fx.files(spark, sf)
    edits = files.where("slide % 4 = 1").selectExpr(
        "path", "'run' AS prefix", "CASE WHEN is_reference THEN 50 END AS max_size", "'red' AS colour")
    return catalog.apply_metadata(files, edits)


@query
def m02_same_metadata(spark, sf):
    return catalog.same_metadata(fx.files(spark, sf), ["n_channels", "prefix"], ["slide"])


@query
def m03_status(spark, sf):
    files = fx.files(spark, sf)
    chosen = files.where("slide % 3 > 0").groupBy("slide").agg(F.min("path").alias("path"))
    return catalog.set_reference(files, chosen).select("path", "slide", "is_reference", "status")


@query
def m04_cycle_order(spark, sf):
    return catalog.cycle_order(fx.files(spark, sf)).select("slide", "path", "cycle")


@query
def m05_fluorescent_channels(spark, sf):
    return catalog.fluorescent_channels(fx.files(spark, sf))


@query
def m06_check_reference(spark, sf):
    return catalog.check_reference(fx.files(spark, sf)).select(
        "path", "valid", catalog.fallback_channel().alias("used_channel"))


@query
def m07_sort_files(spark, sf):
    return catalog.sort_files(fx.files(spark, sf), "max_size")


@query
def m08_working_image(spark, sf):
    return catalog.with_working_image(
        fx.pixels(spark, sf), fx.working_pixels(spark, sf), fx.stack_files(spark, sf), ["cycle"])


@query
def m09_channel_index(spark, sf):
    named = fx.files(spark, sf).selectExpr(
        "path", "reference_channel", "CASE WHEN max_size % 3 = 0 THEN 'BF' ELSE concat('Channel ', max_size, 'x2') END AS name")
    return catalog.with_channel_index(named, "name", "reference_channel")


# ---- intensity ------------------------------------------------------------------------------
@query
def p01_to_8bit(spark, sf):
    return intensity.minmax_8bit(fx.pixels(spark, sf), PLANE)


@query
def p02_scale(spark, sf):
    return intensity.minmax_scale(fx.pixels(spark, sf), PLANE)


@query
def p03_contrast_unit(spark, sf):
    return intensity.contrast_unit(fx.pixels(spark, sf), PLANE).select("y", "x", *PLANE, r6("v"))


@query
def p04_contrast_8bit(spark, sf):
    return intensity.contrast_8bit(fx.pixels(spark, sf), PLANE, 50, 99)


@query
def p05_contrast_clean(spark, sf):
    dirty = fx.pixels(spark, sf).withColumn("v", F.expr(
        "CASE (y*31 + x*17) % 97 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity')"
        " WHEN 2 THEN double('-Infinity') ELSE double(v) END"))
    return intensity.contrast_clean(dirty, PLANE)


@query
def p06_binary_threshold(spark, sf):
    return intensity.binary_threshold(fx.pixels(spark, sf), 1500)


@query
def p07_percentile_threshold(spark, sf):
    return intensity.percentile_threshold(fx.pixels(spark, sf), 80, PLANE)


@query
def p08_otsu(spark, sf):
    px = fx.pixels(spark, sf)
    above = intensity.above_otsu(px, PLANE).groupBy(*PLANE).agg(F.count(F.lit(1)).alias("n_above"))
    return intensity.otsu_level(px, PLANE).join(above, list(PLANE))


@query
def p09_shading(spark, sf):
    return clahe.correct_shading(fx.brightfield(spark, sf), PLANE).select("y", "x", "v")


@query
def p10_match_histograms(spark, sf):
    px = fx.pixels(spark, sf, channels=[1, 2, 3])
    return intensity.match_histograms(px, ["cycle"]).select("y", "x", *PLANE, r6("v"))


@query
def p11_background(spark, sf):
    return stencil.subtract_background(fx.pixels(spark, sf, [0], [1]), 0.5, 101, PLANE).select("y", "x", "v")


@query
def p12_stencils(spark, sf):
    bank = {
        "box3": (stencil.box(3), stencil.box(3)), "mean225": ([1 / 15.0] * 5, [1 / 15.0] * 5),
        "gauss3": (stencil.gaussian(3), stencil.gaussian(3)), "gauss5": (stencil.gaussian(5, 1.0), stencil.gaussian(5, 1.0)),
        "gauss11": (stencil.gaussian(11), stencil.gaussian(11)),
    }
    # 4 places: sums of doubles may be taken in any order
    return stencil.filter_bank(fx.brightfield(spark, sf), bank, PLANE).select("y", "x", *[F.round(k, 4).alias(k) for k in bank])


@query
def p13_unsharp(spark, sf):
    return stencil.unsharp(gray8(spark, sf), PLANE).select("y", "x", "v")


@query
def p14_bead_mask(spark, sf):
    return stencil.bead_mask(gray8(spark, sf), PLANE).select("y", "x", "v")


@query
def p15_adaptive_threshold(spark, sf):
    px = gray8(spark, sf).withColumn("g", F.col("v"))
    mean = stencil.adaptive_threshold(px, stencil.box(11), 50, PLANE, keep=("g",))
    both = stencil.adaptive_threshold(mean.withColumnsRenamed({"v": "by_mean", "g": "v"}), stencil.gaussian(11), 2, PLANE, keep=("by_mean",))
    return both.select("y", "x", "by_mean", F.col("v").alias("by_gauss"))


@query
def p16_tissue_mask(spark, sf):
    return stencil.tissue_mask(fx.protein_pixels(spark, sf), ["cycle"], min_area=3).select("y", "x", "keep")


@query
def p17_ncc(spark, sf):
    fixed = tiled_brightfield(spark, sf)
    return intensity.ncc(fixed, tile4(fx.moving_pixels(spark, sf)), ["tile_id"]).select("tile_id", r6("ncc"))


@query
def p18_fit_to_shape(spark, sf):
    bf = fx.brightfield(spark, sf)
    return intensity.fit_to_shape(stacks.crop(bf, share_of_side(spark, sf, 3, 5)), bf, PLANE).select("y", "x", "v")


@query
def p19_black_out(spark, sf):
    return intensity.black_out(fx.brightfield(spark, sf), fx.beads(spark, sf)).select("y", "x", "v")


@query
def p19_overlay(spark, sf):
    gray = intensity.minmax_8bit(intensity.contrast_unit(gray8(spark, sf), PLANE, 30, 99), PLANE)
    return intensity.paint(gray, fx.beads(spark, sf), K.MARK)


@query
def p20_tint(spark, sf):
    return intensity.tint(intensity.minmax_8bit(fx.pixels(spark, sf, [0]), PLANE)).drop("cycle")


# ---- regions --------------------------------------------------------------------------------
@query
def g01_closing(spark, sf):
    return regions.binary_close(intensity.above_otsu(fx.brightfield(spark, sf), PLANE), 3, PLANE).select("y", "x")


@query
def g02_clear_border(spark, sf):
    size = plane_size(fx.brightfield(spark, sf), PLANE)
    return regions.clear_border(bright_regions(spark, sf), size, PLANE).select("label", "y", "x")


@query
def g03_components(spark, sf):
    # blocks whose borders cut through beads, so that pieces have to be joined
    fg = intensity.above_otsu(fx.brightfield(spark, sf), PLANE)
    return regions.components(fg, PLANE, block=60).select("label", "y", "x")


@query
def g04_measures(spark, sf):
    m = regions.measure(bright_regions(spark, sf), PLANE)
    return m.select("label", "area", "y1", "x1", "y2", "x2", *[r6(c) for c in ("cy", "cx", "wy", "wx")])


@query
def g05_area_opening(spark, sf):
    return regions.area_at_least(bright_regions(spark, sf), 10, PLANE).select("label", "y", "x")


@query
def g06_contour_centres(spark, sf):
    found = outlines.outlines(bright_regions(spark, sf), PLANE)
    return found.join(outlines.centres(found, PLANE), [*PLANE, "label", "hole"]).select(
        "label", "hole", "parent", "m00", r6("m10"), r6("m01"), r6("length"), "x", "y")


@query
def g07_key_points(spark, sf):
    fg = tiled_brightfield(spark, sf).where("v > 10000").select("tile_id", "y", "x")
    return key_points(fg).select("tile_id", "rank", "x", "y", "area", r6("circularity"))


@query
def g07_find_points(spark, sf):
    return outlines.find_points(fx.brightfield(spark, sf), PLANE).select("rank", "x", "y", "area", r6("circularity"))


@query
def g08_distinct_beads(spark, sf):
    found = regions.bead_table(bright_regions(spark, sf), PLANE).select("x", "y")
    return regions.distinct_beads(found.unionByName(fx.beads(spark, sf).select("x", "y")))


@query
def g09_second_pass(spark, sf):
    beads, _ = decode.find_beads(fx.brightfield(spark, sf), PLANE)
    return outlines.second_pass(gray8(spark, sf), beads, PLANE).select("x", "y")


@query
def g10_edge_filter(spark, sf):
    w = share_of_side(spark, sf, 1, 1)
    beads = fx.beads(spark, sf)
    strict = regions.inside_edges(beads, 2, w).select("bead_id", F.lit("strict").alias("form"))
    return strict.unionByName(regions.inside_edges(beads, 2, w, True).select("bead_id", F.lit("mask").alias("form")))


@query
def g11_range_filter(spark, sf):
    beads = fx.beads(spark, sf)
    low, high = share_of_side(spark, sf, 1, 10), share_of_side(spark, sf, 4, 5)
    tag = lambda df, form: df.select("bead_id", "x", "y", F.lit(form).alias("form"))
    return tag(regions.range_filter(beads, low, high), "meant").unionByName(
        tag(regions.range_filter(beads, low, high, literal=True), "literal"))


# ---- tiles and registration -----------------------------------------------------------------
@query
def t01_tile_grid(spark, sf):
    return grid4(spark, sf).select("cycle", "tile_id", "i", "j", "cx", "cy", "half")


@query
def t02_pixels_by_tile(spark, sf):
    bf = fx.brightfield(spark, sf)
    return tiles.pixels_by_tile(bf, plane_size(bf, ["cycle"]), 4, 3, PLANE, ["cycle"]).select("tile_id", "y", "x", "v")


@query
def t03_tile_windows(spark, sf):
    return tiles.tile_windows(grid4(spark, sf), 3).select(
        "cycle", "tile_id", "y0", "y1", "x0", "x1", "ymin", "ymax", "xmin", "xmax")


@query
def t04_pair_tiles(spark, sf):
    return tiles.pair_tiles(tiled_brightfield(spark, sf), tile4(fx.moving_pixels(spark, sf)))


@query
def t05_pair_points(spark, sf):
    fixed = key_points(tiled_brightfield(spark, sf).where("v > 10000").select("tile_id", "y", "x"))
    moving = key_points(tile4(fx.moving_pixels(spark, sf)).where("v > 10000").select("tile_id", "y", "x"))
    return registration.pair_by_rank(fixed, moving)


@query
def t06_two_nearest(spark, sf):
    fixed, moving = fx.descriptors(spark, sf)
    near = registration.two_nearest(moving, fixed, ["label"])
    return registration.ratio_matches(near, ["label"]).select("label", "q_id", "c_id", r6("d1"), r6("d2"))


@query
def t07_affine(spark, sf):
    fit = registration.fit_affine(fx.point_pairs(spark, sf))
    return fit.select("tile_id", *[r6(c) for c in registration.MATRIX])


@query
def t07_affine_robust(spark, sf):
    order = Window.partitionBy("tile_id").orderBy("bead_id")  # at most 25 points per 40-pixel tile
    pairs = fx.point_pairs(spark, sf).withColumn("rank", F.row_number().over(order))
    return registration.fit_affine_robust(pairs).select("tile_id", *[r6(c) for c in registration.MATRIX])


@query
def t08_shift_search(spark, sf):
    return registration.best_shift(shifts(spark, sf)).select("tile_id", "dy", "dx", r6("ncc"))


@query
def t08_shift_pyramid(spark, sf):
    found = registration.search_shifts(
        fx.brightfield(spark, sf).drop(*PLANE), tile4(fx.moving_pixels(spark, sf)), ["tile_id"], reach=6)
    return found.select("tile_id", "dy", "dx", r6("ncc"))


@query
def t08_track_points(spark, sf):
    """Key points of the moved image followed into the fixed one; real positions, so there is no SQL for them."""
    eight = lambda df: df.selectExpr("y", "x", "v div 100 AS v")
    moving = tile4(fx.moving_pixels(spark, sf))
    points = key_points(moving.where("v > 10000").select("tile_id", "y", "x"))
    found = tracking.track(points, eight(moving), eight(fx.brightfield(spark, sf)), fill=0)
    return found.select("tile_id", "set", "rank", "x", "y", *[F.round(c, 3).alias(c) for c in ("u", "v", "error")])


@query
def t09_bend(spark, sf):
    """Bends of the moved image's tiles; fitted, so there is no SQL for them."""
    stack = fx.moving_stack(spark, sf).where("channel = 0").drop("channel")
    fixed = fx.brightfield(spark, sf).drop("channel")
    windows = tiles.tile_windows(tiles.tile_grid(plane_size(stack, ["cycle"]), 4, ["cycle"]), 3)
    target, moving = (elastic.tile_images(px, windows, None, ["cycle"], ["cycle"]) for px in (fixed, stack))
    far = lambda c: F.round(F.array_max(F.transform(c, F.abs)), 2).alias(f"{c}_most")
    return elastic.bend(target, moving, ["cycle", "tile_id"]).select("cycle", "tile_id", F.round("ncc", 3).alias("ncc"), far("bend_y"), far("bend_x"))


@query
def t09_cascade(spark, sf):
    all_tiles = tile4(fx.moving_pixels(spark, sf))
    fixed = fx.brightfield(spark, sf).drop(*PLANE)
    def within(radius):
        def stage(todo):
            scores = registration.shift_search(fixed, all_tiles.join(todo, "tile_id", "left_semi"), ["tile_id"], radius)
            return registration.best_shift(scores)
        return stage
    return registration.cascade(all_tiles.select("tile_id"), [within(0), within(1), within(2)]).select(
        "tile_id", "stage", "dy", "dx", r6("ncc"))


@query
def t10_carry_transform(spark, sf):
    still = registration.best_shift(shifts(spark, sf, 0)).select("tile_id", F.col("ncc").alias("still"))
    found = registration.shift_matrix(registration.best_shift(shifts(spark, sf))).drop("ncc")
    t = found.join(still, "tile_id").withColumnRenamed("still", "ncc").withColumn("cycle", F.lit(1))
    return registration.carry_forward(t, ["cycle"]).select("tile_id", "a", "tx", "ty", r6("ncc"))


@query
def t11_warp(spark, sf):
    px = fx.pixels(spark, sf, channels=[0])
    m = px.select("cycle").distinct().selectExpr(
        "cycle", "1.0D + cycle * 0.02D AS a", "0.05D AS b", "1.25D - cycle AS tx", "-0.04D AS c", "0.97D AS d", "2.5D AS ty")
    return registration.warp(px, m, plane_size(px, ["cycle"]), PLANE, ["cycle"]).select(
        "cycle", "y", "x", F.round("v", 4).alias("v"))


@query
def t12_stitch(spark, sf):
    bf = fx.brightfield(spark, sf)
    parts = tiles.pixels_by_tile(bf, plane_size(bf, ["cycle"]), 4, 3, PLANE, ["cycle"])
    windows = tiles.tile_windows(grid4(spark, sf), 3)
    return tiles.stitch(parts, windows, bf, PLANE, ["cycle"]).select("y", "x", "v")


@query
def t13_align_stack(spark, sf):
    stack = fx.moving_stack(spark, sf)
    found = registration.best_shift(shifts(spark, sf)).withColumn("cycle", F.lit(0))
    carried = registration.carry_forward(registration.shift_matrix(found), ["cycle"])
    windows = tiles.tile_windows(tiles.tile_grid(plane_size(stack, ["cycle"]), 4, ["cycle"]), 3)
    return registration.align_stack(stack, windows, carried, PLANE, ["cycle"], 4).select("channel", "y", "x", "v")


@query
def t14_describe_matrix(spark, sf):
    return registration.describe_matrix(registration.fit_affine(fx.point_pairs(spark, sf))).select("tile_id", "text")


# ---- measurement and calls ------------------------------------------------------------------
@query
def b01_square_samples(spark, sf):
    return decode.square_samples(fx.beads(spark, sf), fx.pixels(spark, sf, channels=[1, 2, 3]))


@query
def b02_region_samples(spark, sf):
    px = fx.pixels(spark, sf, channels=[1, 2, 3])
    return decode.region_samples(bright_regions(spark, sf), px)


@query
def b03_brightness(spark, sf):
    return bead_signal(spark, sf).select("bead_id", *PLANE, "brightness")


@query
def b04_background(spark, sf):
    return bead_signal(spark, sf).select("bead_id", *PLANE, r6("background"))


@query
def b05_snr(spark, sf):
    return bead_signal(spark, sf).select("bead_id", *PLANE, r6("snr"))


@query
def b05_snr_edge(spark, sf):
    w = fx.brightfield(spark, sf).agg(F.max("x") + 1).first()[0]
    sig = decode.edge_snr(bead_signal(spark, sf), fx.beads(spark, sf), w)
    return sig.select("bead_id", *PLANE, r6("snr"))


@query
def b06_over_threshold(spark, sf):
    return bead_signal(spark, sf).select("bead_id", *PLANE, "over")


@query
def b07_argmax(spark, sf):
    return decode.call_colours(bead_signal(spark, sf), noise="off", gate="off")


@query
def b08a_noise_every_high(spark, sf):
    return decode.call_colours(bead_signal(spark, sf), noise="every_high", gate="off")


@query
def b08b_noise_none_high(spark, sf):
    return decode.call_colours(bead_signal(spark, sf), noise="none_high", gate="off", cutoff=0.5)


@query
def b09a_gate_all(spark, sf):
    return decode.call_colours(bead_signal(spark, sf), noise="off", gate="all_over")


@query
def b09b_gate_any(spark, sf):
    return decode.call_colours(bead_signal(spark, sf), noise="off", gate="any_over")


@query
def b10_drop_uncalled(spark, sf):
    return called_beads(spark, sf)


@query
def b11_bbox(spark, sf):
    m = regions.measure(bright_regions(spark, sf), PLANE)
    return m.select("label", regions.bbox_text(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")).alias("bbox"))


@query
def b12_wide_calls(spark, sf):
    return decode.decode_square(
        fx.beads(spark, sf), fx.pixels(spark, sf), 3, match=False, thresholds=THRESHOLDS).select(
        "x", "y", "cy0", "cy1", "cy2", "bbox")


@query
def b13_decode_square(spark, sf):
    return decode.decode_square(fx.beads(spark, sf), fx.pixels(spark, sf), 3).select("x", "y", "cy0", "cy1", "cy2", "bbox")


@query
def b13_decode_square_older(spark, sf):
    w = fx.brightfield(spark, sf).agg(F.max("x") + 1).first()[0]
    return decode.decode_square(
        fx.beads(spark, sf), fx.pixels(spark, sf), 3, thresholds=THRESHOLDS, cutoff=0.5, noise="none_high", gate="any_over",
        max_size=w,
    ).select("x", "y", "cy0", "cy1", "cy2", "bbox")


@query
def b13_decode(spark, sf):
    return decode.decode_regions(fx.pixels(spark, sf), 3).select("x", "y", "cy0", "cy1", "cy2", "bbox")


# ---- cells ----------------------------------------------------------------------------------
def _cell_inputs(spark, sf):
    return called_beads(spark, sf), fx.cell_pixels(spark, sf), fx.protein_pixels(spark, sf), fx.color_code(spark, sf)


@query
def c01_clean_code(spark, sf):
    return cells.clean_color_code(fx.color_code_sheet(spark, sf))


@query
def c02_code_size(spark, sf):
    return cells.code_size(cells.clean_color_code(fx.color_code(spark, sf)))


@query
def c03_code_words(spark, sf):
    return cells.code_words(fx.color_code(spark, sf))


@query
def c04_bead_code(spark, sf):
    return called_beads(spark, sf).select("bead_id", cells.code_key(["cy0", "cy1", "cy2"]).alias("code"))


@query
def c05_cell_of_bead(spark, sf):
    return cells.cell_of_beads(fx.beads(spark, sf), fx.cell_pixels(spark, sf)).select("bead_id", "label")


@query
def c06_in_bounds(spark, sf):
    w = fx.brightfield(spark, sf).agg(F.max("x") + 1).first()[0]
    return fx.beads(spark, sf).select("bead_id", cells.in_bounds("x", "y", w).alias("in_bounds"))


@query
def c07_adjusted_median(spark, sf):
    return cells.bead_intensity(fx.beads(spark, sf), fx.protein_pixels(spark, sf)).select("x", "y", r6("intensity"))


def _values(spark, sf):
    beads, labels, protein, code = _cell_inputs(spark, sf)
    inside = cells.cell_of_beads(cells.coded_beads(beads, code).where(cells.in_bounds("x", "y")), labels)
    values = cells.bead_intensity(inside, protein)
    return inside.join(values, ["x", "y"])


@query
def c08_cell_protein_values(spark, sf):
    return _values(spark, sf).select("label", "protein_idx", "bead_id", r6("intensity"))


@query
def c09_nearest_bead(spark, sf):
    beads, labels, _, code = _cell_inputs(spark, sf)
    sites = cells.coded_beads(beads, code)
    proteins = sites.agg(F.collect_set("protein_idx")).scalar()
    wanted = cells.cell_centroids(labels).withColumn("protein_idx", F.explode(proteins))
    return cells.nearest_site(wanted, sites, ["label"], ["protein_idx"])


@query
def c10_cell_medians(spark, sf):
    return grouped_median(_values(spark, sf), ["label", "protein_idx"], "intensity", "value").select(
        "label", "protein_idx", r6("value"))


@query
def c11_protein_names(spark, sf):
    return cells.protein_names(fx.color_code(spark, sf)).select("protein_idx", "code", "name")


@query
def c12_cell_table(spark, sf):
    inputs = _cell_inputs(spark, sf)
    medians, centroids, _ = cells.cell_protein_values(*inputs, impute=False)
    return cells.cell_table(medians.withColumn("value", F.round("value", 6)), centroids, inputs[3])


@query
def c13_cell_centroids(spark, sf):
    return cells.cell_centroids(fx.cell_pixels(spark, sf))


@query
def c14_checked_inputs(spark, sf):
    inputs = _cell_inputs(spark, sf)
    cells.check_inputs(*inputs)
    rows = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
            for name, df in zip(("beads", "labels", "protein", "code"), inputs)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query
def c15_cell_protein(spark, sf):
    w = fx.brightfield(spark, sf).agg(F.max("x") + 1).first()[0]
    medians, centroids, _ = cells.cell_protein_values(*_cell_inputs(spark, sf), max_size=w)
    return medians.join(centroids, "label").select("label", "gx", "gy", "protein_idx", r6("value"))


@query
def s07_cell_export(spark, sf):
    table = cells.build_cell_table(*_cell_inputs(spark, sf))
    fixed = ["cell_id", "global_x", "global_y"]
    return table.select(*fixed, *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in table.columns if c not in fixed])


# ---- inspector ------------------------------------------------------------------------------
def _boxes(spark, sf):
    box = regions.bbox_text(F.col("y") - 9, F.col("x") - 9, F.col("y") + 6, F.col("x") + 7)
    return fx.beads(spark, sf).withColumn("bbox", box)


@query
def i01_bead_at(spark, sf):
    beads = fx.beads(spark, sf)
    wanted = beads.selectExpr("bead_id AS request_id", "x + bead_id % 2 AS x", "y")
    again = beads.selectExpr("bead_id + 50 AS bead_id", "x", "y")
    return inspect.bead_at(wanted, beads.unionByName(again), [])


def _parsed(spark, sf):
    w = fx.brightfield(spark, sf).agg((F.max("x") + 1).alias("w")).scalar()
    return inspect.parse_bbox(_boxes(spark, sf), w, w)


@query
def i02_parse_bbox(spark, sf):
    return _parsed(spark, sf).select("bead_id", "y1", "x1", "y2", "x2")


@query
def i03_windows(spark, sf):
    wanted = fx.beads(spark, sf).withColumnRenamed("bead_id", "request_id")
    return inspect.window_samples(wanted, fx.pixels(spark, sf), 2, 1.7).groupBy("request_id", *PLANE).agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("y").alias("y0"), F.max("x").alias("x1"))


@query
def i03_box_windows(spark, sf):
    boxes = inspect.grow_bbox(_parsed(spark, sf), 1.5).withColumnRenamed("bead_id", "request_id")
    return inspect.box_samples(boxes, fx.pixels(spark, sf)).groupBy("request_id", *PLANE).agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query
def i04_grow_bbox(spark, sf):
    return inspect.grow_bbox(_parsed(spark, sf), 1.5).select("bead_id", "y1", "x1", "y2", "x2")


@query
def i05_grid_report(spark, sf):
    wanted = fx.beads(spark, sf).withColumnRenamed("bead_id", "request_id")
    samples = inspect.window_samples(wanted, fx.pixels(spark, sf))
    calls = b08a_noise_every_high(spark, sf).where("call IS NOT NULL").withColumnRenamed("bead_id", "request_id")
    out = inspect.grid_report(samples, calls, [0, 1, 2, 3])
    return out.select("request_id", "cycle", *[r6(f"ch{c}") for c in range(4)], "output")
