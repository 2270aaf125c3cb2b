"""Per-pixel intensity transforms. Every function takes and returns long pixel tables.

``by`` names the columns that identify one image plane. Statistics of a plane are aggregated first
(one row per plane, or one histogram per plane) and then joined back; no window ever runs over the
pixels of a plane, since one plane may hold a third of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumifield.functions.constants import PALETTE
from lumifield.functions.lookup import attach
from lumifield.functions.stats import histogram, percentiles, plane_size, value_range
from lumifield.functions.storage import store
from lumifield.schemas import PLANE


def _with_range(px: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return attach(px, value_range(px, by, value), by)


def minmax_8bit(
    px: DataFrame, by: Sequence[str] = PLANE, value: str = "v", already_8bit: Column | None = None
) -> DataFrame:
    """Stretch each plane to 0-255 in single precision and truncate; a constant plane becomes 0.

    Planes for which ``already_8bit`` holds pass through unchanged.
    """
    mn, mx = F.col("mn"), F.col("mx")
    span = (mx - mn).cast("float")
    factor = (F.lit(255.0) / F.when(span > 0, span)).cast("float")
    scaled = F.coalesce(((F.col(value) - mn).cast("float") * factor).cast("int"), F.lit(0))
    if already_8bit is not None:
        scaled = F.when(already_8bit, F.col(value).cast("int")).otherwise(scaled)
    return _with_range(px, by, value).withColumn(value, scaled).drop("mn", "mx")


def minmax_scale(px: DataFrame, by: Sequence[str] = PLANE, value: str = "v") -> DataFrame:
    """Min-max stretch without the guard: a constant plane gives NULL."""
    span = F.col("mx") - F.col("mn")
    factor = F.try_divide(F.lit(1.0), span.cast("double")) * 255
    scaled = ((F.col(value) - F.col("mn")) * factor).cast("int")
    return _with_range(px, by, value).withColumn(value, scaled).drop("mn", "mx")


def _clipped(value: Column) -> Column:
    return F.least(F.greatest(value.cast("double"), F.col("lo")), F.col("hi"))


def _with_percentiles(px: DataFrame, by: Sequence[str], value: str, lo: float, hi: float) -> DataFrame:
    return attach(px, percentiles(px, by, value, {"lo": lo, "hi": hi}), by)


def contrast_unit(
    px: DataFrame, by: Sequence[str] = PLANE, lo: float = 2, hi: float = 98, value: str = "v"
) -> DataFrame:
    """Clip to two percentiles of the plane and rescale to [0, 1]; a flat range gives 0."""
    span = F.col("hi") - F.col("lo")
    unit = F.when(span < 1e-12, F.lit(0.0)).otherwise(F.try_divide(_clipped(F.col(value)) - F.col("lo"), span))
    return _with_percentiles(px, by, value, lo, hi).withColumn(value, unit).drop("lo", "hi")


def contrast_8bit(
    px: DataFrame, by: Sequence[str] = PLANE, lo: float = 2, hi: float = 98, value: str = "v"
) -> DataFrame:
    """Clip to two percentiles and rescale to 0-255, truncating; no guard (flat range gives NULL)."""
    span = F.col("hi") - F.col("lo")
    scaled = (F.try_divide(_clipped(F.col(value)) - F.col("lo"), span) * 255).cast("int")
    return _with_percentiles(px, by, value, lo, hi).withColumn(value, scaled).drop("lo", "hi")


def contrast_clean(
    px: DataFrame, by: Sequence[str] = PLANE, lo: float = 2, hi: float = 98, value: str = "v"
) -> DataFrame:
    """As :func:`contrast_8bit`, with NaN to 0, infinities to 255 and 0, and 1e-8 added to the range."""
    v = F.col(value).cast("double")
    clean = (
        F.when(F.isnan(v), 0.0).when(v == float("inf"), 255.0).when(v == float("-inf"), 0.0).otherwise(v)
    )
    cleaned = px.withColumn(value, clean)
    scaled = ((_clipped(F.col(value)) - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(1e-8)) * 255).cast("int")
    return _with_percentiles(cleaned, by, value, lo, hi).withColumn(value, scaled).drop("lo", "hi")


def binary_threshold(px: DataFrame, level: Column | float, value: str = "v") -> DataFrame:
    """255 at or above ``level``, else 0."""
    return px.withColumn(value, F.when(F.col(value) >= level, 255).otherwise(0))


def percentile_threshold(
    px: DataFrame, pct: float, by: Sequence[str] = PLANE, value: str = "v"
) -> DataFrame:
    """255 at or above the plane's percentile, else 0."""
    level = percentiles(px, by, value, {"level": pct})
    return binary_threshold(attach(px, level, by), F.col("level"), value).drop("level")


def otsu_level(px: DataFrame, by: Sequence[str] = PLANE, value: str = "v") -> DataFrame:
    """Threshold of each plane with the largest between-class variance (the lowest on ties).

    Cumulative sums run over the histogram, at most 65,536 rows per plane.
    """
    h = histogram(px, by, value)
    run = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    c = (
        h.withColumn("w1", F.sum("n").over(run)).withColumn("s1", F.sum(F.col("n") * F.col(value)).over(run))
        .withColumn("w", F.sum("n").over(whole)).withColumn("s", F.sum(F.col("n") * F.col(value)).over(whole))
        .where(F.col("w1") < F.col("w"))
    )
    w1, w2 = F.col("w1").cast("double"), (F.col("w") - F.col("w1")).cast("double")
    gap = F.col("s1") / w1 - (F.col("s") - F.col("s1")) / w2
    var = w1 * w2 * gap * gap
    return c.groupBy(*by).agg(F.max_by(value, F.struct(var, -F.col(value))).alias("level"))


def above_otsu(px: DataFrame, by: Sequence[str] = PLANE, value: str = "v") -> DataFrame:
    """Pixels brighter than their plane's Otsu level."""
    return attach(px, otsu_level(px, by, value), by).where(F.col(value) > F.col("level")).drop("level")


def match_table(
    px: DataFrame, cycle: Sequence[str], channel: str = "channel", value: str = "v"
) -> DataFrame:
    """Look-up table (cycle, channel, v) -> matched value for every channel after the first.

    The first channel of a cycle is the template. Source and template histograms are merged by
    quantile, and each source quantile takes the template values at or below and at or above it;
    both rise with the quantile, so running maxima over the merged histogram give the pair.
    """
    cycle = list(cycle)
    plane = [*cycle, channel]
    h = histogram(px, plane, value)
    run, whole = Window.partitionBy(*plane).orderBy(value), Window.partitionBy(*plane)
    q, _ = store(h.withColumn("q", F.sum("n").over(run) / F.sum("n").over(whole)).drop("n"), "quantiles")
    first = q.groupBy(*cycle).agg(F.min(channel).alias("_template"))
    q = attach(q, first, cycle, spread_by=(value,))
    source = q.where(F.col(channel) != F.col("_template")).drop("_template")
    template = q.where(F.col(channel) == F.col("_template")).select(
        *cycle, F.col(value).cast("double").alias("tv"), F.col("q").alias("tq"))
    targets = source.select(*plane).distinct()
    merged = source.select(
        *plane, value, "q", F.lit(None).cast("double").alias("tv"), F.lit(None).cast("double").alias("tq")
    ).unionByName(
        template.join(targets, cycle).select(
            *plane, F.lit(None).cast(px.schema[value].dataType).alias(value), F.col("tq").alias("q"), "tv", "tq")
    )
    up = Window.partitionBy(*plane).orderBy("q").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*plane).orderBy(F.col("q").desc()).rangeBetween(Window.unboundedPreceding, 0)
    near = (
        merged.withColumn("lv", F.max("tv").over(up)).withColumn("lq", F.max("tq").over(up))
        .withColumn("hv", F.min("tv").over(down)).withColumn("hq", F.min("tq").over(down))
        .where(F.col(value).isNotNull())
    )
    lv, hv, lq, hq = (F.col(c) for c in ("lv", "hv", "lq", "hq"))
    blend = (hv - lv) / F.when(hq > lq, hq - lq) * (F.col("q") - lq) + lv
    matched = F.when(lv.isNull(), hv).when(hv.isNull(), lv).when(hq == lq, lv).otherwise(blend)
    return near.select(*plane, value, matched.alias("matched"))


def apply_match(
    rows: DataFrame, lut: DataFrame, cycle: Sequence[str], channel: str = "channel", value: str = "v",
    spread_by: Sequence[str] = ("y", "x"),
) -> DataFrame:
    """Replace samples by their matched value (doubles); samples of the template channel keep theirs."""
    out = attach(rows, lut, [*cycle, channel, value], how="left", spread_by=spread_by)
    return out.withColumn(value, F.coalesce("matched", F.col(value).cast("double"))).drop("matched")


def match_histograms(
    px: DataFrame, cycle: Sequence[str], channel: str = "channel", value: str = "v"
) -> DataFrame:
    """Match each fluorescent channel's histogram to the first one of its cycle; values are doubles."""
    return apply_match(px, match_table(px, cycle, channel, value), cycle, channel, value)


def ncc_columns(n: Column, sa: Column, sb: Column, sab: Column, saa: Column, sbb: Column) -> Column:
    """Normalised cross-correlation from whole-number sums, exact up to the final square root."""
    wide = lambda c: c.cast("decimal(19,0)")
    num = (wide(n) * wide(sab) - wide(sa) * wide(sb)).cast("double")
    va = (wide(n) * wide(saa) - wide(sa) * wide(sa)).cast("double")
    vb = (wide(n) * wide(sbb) - wide(sb) * wide(sb)).cast("double")
    den = F.sqrt(va * vb)
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.when(den != 0, den))


def ncc_agg(a: Column, b: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"),
        F.sum(a * b).alias("sab"), F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"),
    ]


def ncc(fixed: DataFrame, moving: DataFrame, by: Sequence[str] = ("tile_id",), value: str = "v") -> DataFrame:
    """NCC per group over the common crop of two images (whole-number samples)."""
    a = fixed.withColumnRenamed(value, "_a")
    b = moving.withColumnRenamed(value, "_b")
    pairs = a.join(b, [*by, "y", "x"])
    sums = pairs.groupBy(*by).agg(*ncc_agg(F.col("_a").cast("long"), F.col("_b").cast("long")))
    score = ncc_columns(*(F.col(c) for c in ("n", "sa", "sb", "sab", "saa", "sbb")))
    return sums.select(*by, score.alias("ncc"))


def fit_to_shape(img: DataFrame, target: DataFrame, by: Sequence[str] = (), value: str = "v") -> DataFrame:
    """Pad ``img`` around its centre to the size of ``target`` and cut it to that size.

    Floor of the excess goes before, the rest after; cells outside ``img`` are NULL.
    """
    by = list(by)
    shift = lambda t, o: F.floor(F.greatest(t - o, F.lit(0)) / 2)
    if by:
        size = plane_size(target, by).withColumnsRenamed({"h": "th", "w": "tw"})
        sized = attach(img, size.join(plane_size(img, by), by), by)
        down, across = shift(F.col("th"), F.col("h")), shift(F.col("tw"), F.col("w"))
    else:  # one plane: its sizes are single values
        sized = img
        side = lambda df, c: df.agg(F.max(c) + 1).scalar()
        down, across = shift(side(target, "y"), side(img, "y")), shift(side(target, "x"), side(img, "x"))
    moved = sized.select(*by, (F.col("y") + down).alias("y"), (F.col("x") + across).alias("x"), value)
    return target.select(*by, "y", "x").join(moved, [*by, "y", "x"], "left")


def disc(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(dy, dx) for dy in span for dx in span if dy * dy + dx * dx <= radius * radius]


def disc_pixels(points: DataFrame, radius: int, keep: Sequence[str] = ()) -> DataFrame:
    """Pixel positions covered by filled circles around (y, x) points."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc(radius)])
    return (
        points.select(*keep, "y", "x", F.explode(offsets).alias("o"))
        .select(*keep, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
        .distinct()
    )


def black_out(
    px: DataFrame, points: DataFrame, radius: int = 3, by: Sequence[str] = (), value: str = "v"
) -> DataFrame:
    """Set the discs around the points to 0."""
    hit = disc_pixels(points, radius, by).withColumn("_hit", F.lit(True))
    out = px.join(hit, [*by, "y", "x"], "left")
    return out.withColumn(value, F.when(F.col("_hit"), 0).otherwise(F.col(value))).drop("_hit")


def paint(
    px: DataFrame, points: DataFrame, colour: tuple[int, int, int], radius: int = 0,
    by: Sequence[str] = (), value: str = "v"
) -> DataFrame:
    """Gray image as r, g, b with the discs around the points in one colour.

    Points outside the image meet no pixel and so are ignored.
    """
    hit = disc_pixels(points, radius, by).withColumn("_hit", F.lit(True))
    out = px.join(hit, [*by, "y", "x"], "left")
    rgb = [F.when(F.col("_hit"), F.lit(c)).otherwise(F.col(value)).cast("int").alias(n) for n, c in zip("rgb", colour)]
    return out.select(*by, "y", "x", *rgb)


def tint(px: DataFrame, channel: str = "channel", value: str = "v") -> DataFrame:
    """Palette colour of the channel, with the gray value as alpha."""
    entries = F.array(*[F.array(*[F.lit(c) for c in rgb]) for rgb in PALETTE])
    rgb = F.get(entries, F.col(channel).cast("int"))
    return px.select(
        *[c for c in px.columns if c != value], *[rgb[i].alias(n) for i, n in enumerate("rgb")],
        F.col(value).alias("alpha"))
