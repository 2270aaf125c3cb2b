"""Shading correction: local contrast equalisation with a clip limit, on 7-pixel tiles.

Each tile's look-up table is a clipped running count of its values, kept as one array per tile. All
pixels between the same four tile centres (a cell) blend the same four tables, so the tables are
sent to their cells and every pixel is joined once, to its cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumifield.functions.lookup import attach
from lumifield.functions.stats import plane_size, value_range
from lumifield.schemas import PLANE

BINS = 256


def to_lightness(gray: Column) -> Column:
    """8-bit gray -> 8-bit lightness (CIE L of the sRGB gray, scaled to 0-255)."""
    s = gray / 255.0
    lin = F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))
    lightness = F.when(lin > 0.008856, 116 * F.pow(lin, F.lit(1.0 / 3.0)) - 16).otherwise(903.3 * lin)
    return F.rint(F.round(lightness * 2.55, 9)).cast("int")


def from_lightness(lightness: Column) -> Column:
    """8-bit lightness -> 8-bit gray."""
    big = lightness / 2.55
    f = (big + 16) / 116
    lin = F.when(big > 8, f * f * f).otherwise(big / 903.3)
    s = F.when(lin <= 0.0031308, 12.92 * lin).otherwise(1.055 * F.pow(lin, F.lit(1.0 / 2.4)) - 0.055)
    return F.rint(F.round(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) * 255, 9)).cast("int")


def equalise_tiles(
    px: DataFrame, by: Sequence[str] = PLANE, value: str = "v", pixel: int = 7, clip: float = 2.0
) -> DataFrame:
    """Contrast-limited equalisation of 0-255 planes; the grid has height / ``pixel`` tiles per side."""
    by = list(by)
    size = plane_size(px, by)
    grid = F.greatest(F.floor(F.col("h") / pixel), F.lit(1))
    # sides are padded up to a multiple of the grid
    size = size.withColumn("g", grid).withColumn("th", F.ceil(F.col("h") / F.col("g"))).withColumn(
        "tw", F.ceil(F.col("w") / F.col("g")))
    p = attach(px, size, by)

    # 1. value counts per tile, padding included: a pixel near the far end also stands for its mirror image
    ends = lambda c, n, t: F.when(
        (2 * (F.col(n) - 1) - F.col(c) >= F.col(n)) & (2 * (F.col(n) - 1) - F.col(c) < F.col("g") * F.col(t)),
        F.array(F.col(c), 2 * (F.col(n) - 1) - F.col(c))).otherwise(F.array(F.col(c)))
    padded = p.withColumn("_py", F.explode(ends("y", "h", "th"))).withColumn("_px", F.explode(ends("x", "w", "tw")))
    counts = padded.groupBy(
        *by, "g", F.floor(F.col("_py") / F.col("th")).alias("ti"), F.floor(F.col("_px") / F.col("tw")).alias("tj"),
        F.col(value).alias("bin"), (F.col("th") * F.col("tw")).alias("area")).agg(F.count(F.lit(1)).alias("n"))

    # 2. clip, spread the excess evenly, the remainder over every step-th value
    limit = F.greatest(F.floor(F.lit(clip) * F.col("area") / BINS), F.lit(1))
    tile = Window.partitionBy(*by, "ti", "tj")
    run = tile.orderBy("bin")
    steps = (
        counts.withColumn("kept", F.least("n", limit))
        .withColumn("below", F.sum("kept").over(run))
        .withColumn("excess", F.sum(F.col("n") - F.col("kept")).over(tile))
        .withColumn("upto", (F.coalesce(F.lead("bin").over(run), F.lit(BINS)) - 1).cast("long"))
        .withColumn("start", F.when(F.row_number().over(run) == 1, F.lit(0)).otherwise(F.col("bin")).cast("long"))
    )
    each = F.floor(F.col("excess") / BINS)
    rest = F.col("excess") - each * BINS
    every = F.greatest(F.floor(F.lit(BINS) / F.when(rest > 0, rest)), F.lit(1))
    scale = F.lit(255.0) / F.col("area")

    def level(q: Column, step: Column) -> Column:
        extra = F.when(F.col("rest") > 0, F.least(F.col("rest"), F.floor(q / F.col("every")) + 1)).otherwise(0)
        count = F.when(q < step["bin"], 0).otherwise(step["below"]) + F.col("each") * (q + 1) + extra
        return F.least(F.rint(F.round(count * F.col("scale"), 9)), F.lit(255.0)).cast("smallint")

    by_tile = steps.groupBy(*by, "g", "ti", "tj", each.alias("each"), rest.alias("rest"), every.alias("every"), scale.alias("scale"))
    ordered = by_tile.agg(F.array_sort(F.collect_list(F.struct("start", "upto", "bin", "below"))).alias("_s"))
    tables = ordered.select(*by, "g", "ti", "tj", F.flatten(F.transform(
        "_s", lambda s: F.transform(F.sequence(s["start"], s["upto"]), lambda q: level(q, s)))).alias("_lut"))

    # 3. each table goes to the cells around its tile; at the image edge it also stands in for the missing one
    def cells(t: str) -> Column:
        before = F.struct(F.col(t).alias("c"), F.lit(1).alias("far"))
        after = F.struct((F.col(t) + 1).alias("c"), F.lit(0).alias("far"))
        first = F.when(F.col(t) == 0, F.struct(F.col(t).alias("c"), F.lit(0).alias("far")))
        last = F.when(F.col(t) == F.col("g") - 1, F.struct((F.col(t) + 1).alias("c"), F.lit(1).alias("far")))
        return F.array_compact(F.array(before, after, first, last))

    sent = (
        tables.select(*by, F.explode(cells("ti")).alias("_a"), cells("tj").alias("_bs"), "_lut")
        .select(*by, "_a", F.explode("_bs").alias("_b"), "_lut")
        .select(*by, F.col("_a.c").alias("ci"), F.col("_b.c").alias("cj"),
                (2 * F.col("_a.far") + F.col("_b.far")).alias("corner"), "_lut")
    )
    cell = sent.groupBy(*by, "ci", "cj").agg(F.array_sort(F.collect_list(F.struct("corner", "_lut"))).alias("_four"))

    # 4. blend
    fy, fx = F.col("y") / F.col("th") - 0.5, F.col("x") / F.col("tw") - 0.5
    placed = p.select(
        *by, "y", "x", F.col(value).cast("int").alias("q"), (F.floor(fy) + 1).alias("ci"), (F.floor(fx) + 1).alias("cj"),
        (fy - F.floor(fy)).alias("ky"), (fx - F.floor(fx)).alias("kx"))
    at = lambda k: F.get(F.col("_four")[k]["_lut"], F.col("q"))
    ky, kx = F.col("ky"), F.col("kx")
    mixed = (1 - ky) * ((1 - kx) * at(0) + kx * at(1)) + ky * ((1 - kx) * at(2) + kx * at(3))
    return placed.join(cell, [*by, "ci", "cj"]).select(
        *by, "y", "x", F.rint(F.round(mixed, 9)).cast("int").alias(value))


def correct_shading(
    px: DataFrame, by: Sequence[str] = PLANE, value: str = "v", pixel: int = 7, clip: float = 2.0
) -> DataFrame:
    """16-bit plane -> locally equalised 16-bit plane (v / 255 to 8 bit, lightness, stretch,
    equalise, back to gray, times 256)."""
    by = list(by)
    eight = F.least(F.floor(F.col(value) / 255), F.lit(255))
    light = px.select(*by, "y", "x", to_lightness(eight).alias(value))
    spread = attach(light, value_range(light, by, value), by)
    span = F.col("mx") - F.col("mn")
    full = F.coalesce((F.lit(255) * (F.col(value) - F.col("mn")) / F.when(span > 0, span)).cast("int"), F.lit(0))
    equal = equalise_tiles(spread.select(*by, "y", "x", full.alias(value)), by, value, pixel, clip)
    return equal.withColumn(value, from_lightness(F.col(value)) * 256)
