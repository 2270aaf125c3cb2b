"""Overlapping square tiles of an image: grid, windows, membership and stitching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumifield.functions.constants import NUM_TILES, OVERLAP
from lumifield.functions.lookup import attach
from lumifield.schemas import PLANE


def _steps(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def half_side(n: int) -> Column:
    """Half the side of a tile: the first tile's centre."""
    return F.lit(1.0 / (2 * n)) * F.col("h")


def tile_grid(size: DataFrame, n: int = NUM_TILES, by: Sequence[str] = ("file",)) -> DataFrame:
    """n x n tile centres of each image (one row of ``size`` per image: by, h, w); i follows x.

    Tiles are square: centres scale with the height in both directions.
    """
    centre = lambda k: (2 * F.col(k) + 1) / F.lit(2 * n) * F.col("h")
    return (
        size.select(*by, "h", "w").withColumn("i", _steps(n)).withColumn("j", _steps(n))
        .select(*by, (F.col("i") * n + F.col("j")).alias("tile_id"), "i", "j",
                centre("i").alias("cx"), centre("j").alias("cy"), half_side(n).alias("half"), "h", "w")
    )


def tile_windows(tiles: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Window [y0, y1) x [x0, x1) of each tile, clamped to the image, and the trims on each side.

    A trim is the overlap on a side that is not cut off by the image border, else 0.
    """
    reach = F.rint("half") + overlap
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0.0)), F.col(n).cast("double")).cast("long")
    edge = lambda c, n: c.cast("long").between(0, F.col(n))
    trim = lambda c, n: F.when(edge(c, n), F.lit(overlap)).otherwise(F.lit(0))
    cx, cy = F.col("cx"), F.col("cy")
    return tiles.select(
        "*",
        clamp(F.rint(cy) - reach, "h").alias("y0"), clamp(F.rint(cy) + reach, "h").alias("y1"),
        clamp(F.rint(cx) - reach, "w").alias("x0"), clamp(F.rint(cx) + reach, "w").alias("x1"),
        trim(cy - reach, "h").alias("ymin"), trim(cy + reach, "h").alias("ymax"),
        trim(cx - reach, "w").alias("xmin"), trim(cx + reach, "w").alias("xmax"))


def _indices(c: str, n: int, overlap: int) -> Column:
    """Tile numbers whose window may hold position ``c``, by arithmetic (checked exactly later)."""
    half = half_side(n)
    reach = F.rint(half) + overlap + 1
    lo = F.floor((F.col(c) - reach) / half / 2 - 0.5)
    hi = F.ceil((F.col(c) + reach) / half / 2 - 0.5)
    return F.sequence(F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.lit(n - 1)).cast("int"))


def pixels_by_tile(
    px: DataFrame, size: DataFrame, n: int = NUM_TILES, overlap: int = OVERLAP,
    by: Sequence[str] = PLANE, image: Sequence[str] = ("file",),
) -> DataFrame:
    """Each pixel once per tile window that holds it (column tile_id). No range join: the few
    candidate tiles come from the position itself."""
    reach = F.rint(half_side(n)) + overlap
    def inside(c: str, k: str) -> Column:
        centre = F.rint((2 * F.col(k) + 1) / F.lit(2 * n) * F.col("h"))
        return (F.col(c) >= centre - reach) & (F.col(c) < centre + reach)
    return (
        attach(px, size.select(*image, "h"), image)
        .withColumn("_i", F.explode(_indices("x", n, overlap))).where(inside("x", "_i"))
        .withColumn("_j", F.explode(_indices("y", n, overlap))).where(inside("y", "_j"))
        .withColumn("tile_id", F.col("_i") * n + F.col("_j")).drop("_i", "_j", "h")
    )


def pair_tiles(fixed: DataFrame, moving: DataFrame, on: Sequence[str] = ("tile_id",), value: str = "v") -> DataFrame:
    """Fixed and moving samples of the same tile at the same position."""
    return fixed.withColumnRenamed(value, "fixed").join(
        moving.withColumnRenamed(value, "moving"), [*on, "y", "x"])


def core_offset(c: str) -> Column:
    """First image row (column) that a tile pastes into."""
    return (F.col(c) - F.col("half").cast("long")).cast("long")


def stitch(
    tile_px: DataFrame, windows: DataFrame, grid: DataFrame, by: Sequence[str] = PLANE,
    image: Sequence[str] = ("file",), value: str = "v",
) -> DataFrame:
    """Cut each tile to its core, paste it at its place, later tiles over earlier ones; positions of
    ``grid`` that no tile covers become 0."""
    t = attach(tile_px, windows.select(*image, "tile_id", "cx", "cy", "half", "y0", "x0", "ymin", "xmin"),
               [*image, "tile_id"])
    side = 2 * F.col("half").cast("long")
    ry, rx = F.col("y") - F.col("y0") - F.col("ymin"), F.col("x") - F.col("x0") - F.col("xmin")
    core = t.where((ry >= 0) & (ry < side) & (rx >= 0) & (rx < side))
    placed = core.select(*by, "tile_id", (core_offset("cy") + ry).alias("y"), (core_offset("cx") + rx).alias("x"), value)
    # the empty canvas goes in as tile -1, so that one aggregate both fills and overlays
    canvas = grid.select(*by, F.lit(-1).alias("tile_id"), "y", "x", F.lit(0).alias(value))
    wanted = placed.unionByName(canvas).groupBy(*by, "y", "x").agg(
        F.max_by(value, "tile_id").alias(value), F.min("tile_id").alias("_canvas"))
    return wanted.where(F.col("_canvas") == -1).drop("_canvas")
