"""The four end-to-end jobs over many slides at once.

A slide is one experiment: several files (cycles), one of them the reference. Pixels are
``slide, cycle, channel, y, x, v`` with the cycle number of :func:`catalog.cycle_order`; the catalogue
``files`` has ``slide, cycle, reference_channel`` and, where it matters, ``n_channels``. All slides go
through one plan; nothing is looped over slides on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifield.functions.constants import (
    CELL_MAX_SIZE, MAX_POINTS, MIN_POINTS, NCC_STAGE_2, NCC_STAGE_3, NUM_TILES, OVERLAP, STATUS_BEADS_GENERATED,
)
from lumifield.functions.lookup import attach
from lumifield.functions.stats import plane_size
from lumifield.functions.storage import store
from lumifield.operators import catalog, cells, clahe, decode, elastic, outlines, registration, tiles, tracking
from lumifield.operators.intensity import contrast_8bit
from lumifield.sources import stacks

SLIDE = ("slide",)
FILE = ("slide", "cycle")
PLANE = ("slide", "cycle", "channel")


def reference_planes(px: DataFrame, files: DataFrame) -> DataFrame:
    """The reference (brightfield) channel of every file."""
    wanted = files.select(*FILE, catalog.fallback_channel().alias("channel"))
    return attach(px, wanted, PLANE, how="left_semi")


def correct_shading(px: DataFrame, files: DataFrame) -> DataFrame:
    """Working 2-D images: the shade-corrected reference channel of every file."""
    return clahe.correct_shading(reference_planes(px, files), PLANE)


def prepare(px: DataFrame, files: DataFrame, working: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, good files, bad files) for alignment and bead finding: files whose reference channel is out of range
    are left out and reported, working images take the place of their planes, and each file is cut to its max_size."""
    good, bad = catalog.split_valid(files)
    wanted = attach(px, good.select(*FILE), FILE, how="left_semi")
    if working is not None:
        wanted = catalog.with_working_image(wanted, attach(working, good.select(*FILE), FILE, how="left_semi"), good, FILE)
    if "max_size" in files.columns:
        wanted = stacks.crop(attach(wanted, good.select(*FILE, "max_size"), FILE), F.col("max_size")).drop("max_size")
    return wanted, good, bad


def align_to_reference(
    px: DataFrame, files: DataFrame, n: int = NUM_TILES, overlap: int = OVERLAP, reach: int | None = None,
    working: DataFrame | None = None, levels: int | None = None, tracked: bool = False,
) -> DataFrame:
    """Every later cycle moved onto cycle 0 of its slide, tile by tile, all channels alike.

    Bad files are left out (see :func:`prepare`). Reference channels are stretched (percentiles 50 and 99), each tile's
    best shift of all up to ``reach`` pixels is found (2 ** (levels + 1) - 2 if ``levels`` is given, else the overlap of tiles), weak tiles take the transform
    before them, and the stacks are warped and stitched. :func:`find_shifts` gives the shifts by themselves. With ``tracked`` the transforms are those
    of :func:`find_transforms`: affines with sub-pixel precision, then shifts, then bends.
    """
    if reach is None and levels is not None:
        reach = 2 ** (levels + 1) - 2
    px, files, _ = prepare(px, files, working)
    size, _ = store(plane_size(px, FILE), "size")
    if tracked:
        transforms = registration.carry_forward(find_transforms(px, files, n, overlap, reach), FILE, (*registration.MATRIX, "bend_y", "bend_x"))
    else:
        found = find_shifts(px, files, n, overlap, reach)
        transforms = registration.carry_forward(registration.shift_matrix(found.drop("on_rim")), FILE)
    windows = tiles.tile_windows(tiles.tile_grid(size.where("cycle > 0"), n, FILE), overlap)
    moved = registration.align_stack(px.where("cycle > 0"), windows, transforms, PLANE, FILE, n)
    still = px.where("cycle = 0").select(*PLANE, "y", "x", "v")
    return still.unionByName(moved)


def find_shifts(px: DataFrame, files: DataFrame, n: int = NUM_TILES, overlap: int = OVERLAP, reach: int | None = None) -> DataFrame:
    """Shift of each tile of every later cycle: slide, cycle, tile_id, dy, dx, ncc, on_rim (the true shift may be out of reach)."""
    gray = contrast_8bit(reference_planes(px, files), PLANE, 50, 99).na.fill(0, ["v"])
    gray, _ = store(gray.select(*FILE, "y", "x", "v"), "gray")
    fixed = gray.where("cycle = 0").drop("cycle")
    moving = gray.where("cycle > 0")
    size = plane_size(px, FILE)
    tiled = tiles.pixels_by_tile(moving, size.where("cycle > 0"), n, overlap, (*FILE,), FILE)
    by = [*FILE, "tile_id"]
    return registration.search_shifts(fixed, tiled, by, overlap if reach is None else reach, plane=SLIDE)


def find_transforms(
    px: DataFrame, files: DataFrame, n: int = NUM_TILES, overlap: int = OVERLAP, reach: int | None = None, max_points: int = MAX_POINTS,
) -> DataFrame:
    """Transform of each tile of every later cycle: slide, cycle, tile_id, stage, a .. ty, bend_y, bend_x, ncc.

    1. Key points of the tile are tracked into cycle 0 and an affine is fitted to them. 2. Tiles whose warped image then has a correlation below 0.5: the best
    whole-pixel shift, if it is better. 3. Tiles still below 0.6: a bend on top of the best so far, if it is better. A
    tile for which nothing works has correlation 0 and no transform. Matrices are in the coordinates of the tile's window.
    """
    gray = contrast_8bit(reference_planes(px, files), PLANE, 50, 99).na.fill(0, ["v"])
    gray, _ = store(gray.select(*FILE, "y", "x", "v"), "gray")
    fixed, moving = gray.where("cycle = 0").drop("cycle"), gray.where("cycle > 0")
    size, _ = store(plane_size(gray, FILE), "size")
    by = [*FILE, "tile_id"]
    later = size.where("cycle > 0")
    windows, _ = store(tiles.tile_windows(tiles.tile_grid(later, n, FILE), overlap), "windows")
    origin, n_tiles = store(windows.select(*by, F.col("y0").alias("_oy"), F.col("x0").alias("_ox")), "origin")

    def key_points(img: DataFrame, sides: DataFrame, image: tuple[str, ...]) -> DataFrame:
        """Key points by tile, in coordinates of the image."""
        corners = tiles.tile_windows(tiles.tile_grid(sides, n, image), overlap).select(*image, "tile_id", F.col("y0").alias("_y"), F.col("x0").alias("_x"))
        key = [*image, "tile_id"]
        own = attach(tiles.pixels_by_tile(img, sides, n, overlap, image, image), store(corners, "corners"), key)
        local = own.select(*key, (F.col("y") - F.col("_y")).alias("y"), (F.col("x") - F.col("_x")).alias("x"), "v")
        found = outlines.find_points(local, key, max_points)
        return attach(found, store(corners, "corners"), key, spread_by=("rank",)).select(*key, "rank", (F.col("x") + F.col("_x")).alias("x"), (F.col("y") + F.col("_y")).alias("y"))

    mine, _ = store(key_points(moving, later, FILE), "points")
    theirs = key_points(fixed, size.where("cycle = 0").drop("cycle"), SLIDE).groupBy(*SLIDE, "tile_id").agg(F.count(F.lit(1)).alias("_n"))
    enough = mine.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")).join(theirs, [*SLIDE, "tile_id"]).select(*by, F.least("_m", "_n").alias("_most"))
    points = attach(mine, enough.where(F.col("_most") >= MIN_POINTS), by, spread_by=("rank",)).where(F.col("rank") <= F.col("_most")).drop("_most")
    fits = tracking.tracked_affine(tracking.track(points, moving, fixed, by, FILE, SLIDE), by)
    # from the coordinates of the image to those of the window
    shifted = lambda t, p, q, o: F.col(t) + F.col(p) * F.col("_ox") + F.col(q) * F.col("_oy") - F.col(o)
    local = attach(fits, (origin, n_tiles), by).withColumns({"tx": shifted("tx", "a", "b", "_ox"), "ty": shifted("ty", "c", "d", "_oy")})
    first, _ = store(local.select(*by, *registration.MATRIX), "tracked")

    target, _ = store(elastic.tile_images(fixed, windows, None, SLIDE, FILE), "target")
    none = F.lit(None).cast("array<double>")

    def scored(found: DataFrame, stage: int) -> DataFrame:
        few = windows.join(found.select(*by), by, "left_semi")
        ncc = elastic.compare(target, elastic.tile_images(moving, few, found, FILE, FILE), by)
        return found.join(ncc, by).select(*by, F.lit(stage).alias("stage"), *registration.MATRIX, none.alias("bend_y"), none.alias("bend_x"), "ncc")

    def better(best: DataFrame, new: DataFrame) -> DataFrame:
        names = [c for c in best.columns if c not in by]
        both = best.join(new.groupBy(*by).agg(F.max_by(F.struct(*names), "ncc").alias("_new")), by, "left")
        wins = F.coalesce(F.col("_new.ncc") > F.col("ncc"), F.lit(False))
        return store(both.select(*by, *[F.when(wins, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in names]), "best")[0]

    empty = {"stage": F.lit(None).cast("int"), **{m: F.lit(None).cast("double") for m in registration.MATRIX}, "bend_y": none, "bend_x": none, "ncc": F.lit(0.0)}
    best = better(origin.select(*by).withColumns(empty), scored(first, 1))
    weak, left = store(best.where(F.col("ncc") < NCC_STAGE_2).select(*by), "weak")
    if left:
        tiled = attach(tiles.pixels_by_tile(moving, later, n, overlap, FILE, FILE), (weak, left), by, how="left_semi")
        found = registration.search_shifts(fixed, tiled, by, overlap if reach is None else reach, plane=SLIDE)
        best = better(best, scored(store(registration.shift_matrix(found).select(*by, *registration.MATRIX), "shifts")[0], 2))
    weak, left = store(best.where(F.col("ncc") < NCC_STAGE_3).drop("ncc", "stage", "bend_y", "bend_x"), "weak")
    if left:
        few = windows.join(weak.select(*by), by, "left_semi")
        bends = elastic.bend(target, elastic.tile_images(moving, few, weak, FILE, FILE), by)
        best = better(best, weak.join(bends, by).select(*by, F.lit(3).alias("stage"), *registration.MATRIX, "bend_y", "bend_x", "ncc"))
    return best


def generate_beads(
    px: DataFrame, n_cycles: int, reference_channel: int = 0, files: DataFrame | None = None, working: DataFrame | None = None, **rules,
) -> DataFrame:
    """Bead table of every slide: slide, label, x, y, cy0.., bbox.

    With ``files`` each file's own reference channel, working image and size count, and bad files are left out.
    """
    if files is None:
        return decode.decode_regions(px, n_cycles, reference_channel, SLIDE, **rules)
    px, good, _ = prepare(px, files, working)
    return decode.decode_regions(px, n_cycles, good.select(*FILE, "reference_channel"), SLIDE, **rules)


def mark_generated(files: DataFrame, beads: DataFrame) -> DataFrame:
    """Catalogue with the status of the files of slides that have beads set to bead data generated."""
    done = beads.select("slide").distinct().withColumn("_done", F.lit(True))
    new = F.when(F.col("_done"), F.lit(STATUS_BEADS_GENERATED))
    status = F.coalesce(new, F.col("status")) if "status" in files.columns else new
    return files.join(done, "slide", "left").withColumn("status", status).drop("_done")


def cell_proteins(
    beads: DataFrame, labels: DataFrame, protein: DataFrame, code: DataFrame, max_size: int = CELL_MAX_SIZE
) -> DataFrame:
    """Median per slide, cell and protein (long form: slide, label, gx, gy, protein, value)."""
    code = cells.clean_color_code(code)
    cells.check_schema(beads, labels, protein, code)
    medians, centroids, names = cells.cell_protein_values(beads, labels, protein, code, max_size, by=SLIDE)
    named = attach(medians, names.select("protein_idx", F.col("name").alias("protein")), ["protein_idx"], spread_by=("label",))
    return named.join(centroids, [*SLIDE, "label"]).select(*SLIDE, "label", "gx", "gy", "protein", "value")
