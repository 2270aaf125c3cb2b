"""Bead measurement and colour calls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumifield.functions.constants import NO_CALL
from lumifield.functions.lookup import attach, window_join
from lumifield.operators.intensity import above_otsu, apply_match, match_table
from lumifield.operators.regions import bbox_text, bead_table, binary_close, clear_border, components, plane_size


def rank_channels(px: DataFrame, image: Sequence[str] = ("cycle",), reference_channel: int | Column = 0) -> DataFrame:
    """Fluorescent planes of each image with their 0-based position (chan_rank); few rows per image."""
    planes = px.select(*image, "channel").distinct().where(F.col("channel") != reference_channel)
    order = Window.partitionBy(*image).orderBy("channel")
    return planes.withColumn("chan_rank", F.row_number().over(order) - 1)


def square_samples(beads: DataFrame, px: DataFrame, radius: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Samples in [y-r, y+r) x [x-r, x+r) around each bead: by, bead_id, cycle, channel, v."""
    points = beads.select(*by, "bead_id", F.col("y").alias("py"), F.col("x").alias("px"))
    return window_join(points, px, radius, radius, by).select(*by, "bead_id", "cycle", "channel", "v")


def region_samples(regions: DataFrame, px: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Samples under each region: by, label, cycle, channel, v."""
    return regions.select(*by, "label", "y", "x").join(px, [*by, "y", "x"]).select(*by, "label", "cycle", "channel", "v")


def signal(
    samples: DataFrame, bead: Sequence[str] = ("bead_id",), thresholds: Mapping[int, float] | None = None
) -> DataFrame:
    """Brightness (median, cut to a whole number), background (10th percentile), signal-to-noise and
    the over-threshold flag, all from one aggregate. Samples are 16 bit (or one matched value per
    16-bit value), so a percentile buffer is bounded however large the region is."""
    probs = F.array(F.lit(0.5), F.lit(0.1))
    q = samples.groupBy(*bead, "cycle", "channel").agg(F.percentile("v", probs).alias("_q"))
    med, bg = F.col("_q")[0], F.col("_q")[1]
    level: Column = F.lit(0.0)
    for channel, value in (thresholds or {}).items():
        level = F.when(F.col("channel") == channel, F.lit(float(value))).otherwise(level)
    return q.select(
        *bead, "cycle", "channel", med.alias("median"), med.cast("int").alias("brightness"), bg.alias("background"),
        F.when(bg > 0, (med - bg) / F.when(bg > 0, bg)).otherwise(0.0).alias("snr"), (med > level).alias("over"))


def _edge(c: str, max_size: int, margin: int) -> Column:
    return (F.col(c) < margin) | (F.col(c) >= max_size - margin)


def edge_snr(
    sig: DataFrame, beads: DataFrame, max_size: int, margin: int = 40, by: Sequence[str] = ()
) -> DataFrame:
    """Older rule: the ratio is 0 for beads closer than ``margin`` to an edge."""
    at = beads.select(*by, "bead_id", (_edge("x", max_size, margin) | _edge("y", max_size, margin)).alias("_edge"))
    return sig.join(at, [*by, "bead_id"]).withColumn("snr", F.when(F.col("_edge"), 0.0).otherwise(F.col("snr"))).drop("_edge")


def edge_zero(
    sig: DataFrame, beads: DataFrame, max_size: int, radius: int = 2, by: Sequence[str] = ()
) -> DataFrame:
    """Older rule: nothing is measured for beads within two radii of an edge."""
    m = 2 * radius
    at = beads.select(*by, "bead_id", (_edge("x", max_size, m) | _edge("y", max_size, m)).alias("_edge"))
    gone = F.col("_edge")
    return sig.join(at, [*by, "bead_id"]).withColumns({
        "brightness": F.when(gone, 0).otherwise(F.col("brightness")), "snr": F.when(gone, 0.0).otherwise(F.col("snr")),
        "over": F.when(gone, False).otherwise(F.col("over"))}).drop("_edge")


def brightest(rank: str = "chan_rank", brightness: str = "brightness") -> Column:
    """Aggregate: position of the brightest channel, the first one on ties."""
    return F.max_by(rank, F.struct(F.col(brightness), -F.col(rank)))


def call_colours(
    sig: DataFrame, bead: Sequence[str] = ("bead_id",), cutoff: float = 0.1,
    noise: str = "every_high", gate: str = "all_over",
) -> DataFrame:
    """Colour call per bead and cycle; NULL means no call.

    noise: "every_high" rejects when even the lowest ratio is above 1 - cutoff, "none_high" when the
    highest is below cutoff, "off". gate: "all_over" needs every channel over its threshold,
    "any_over" at least one, "off".
    """
    reject = {
        "every_high": F.min("snr") > 1 - cutoff,
        "none_high": F.max("snr") < cutoff,
        "off": F.lit(False),
    }[noise]
    shut = {"all_over": ~F.bool_and("over"), "any_over": ~F.bool_or("over"), "off": F.lit(False)}[gate]
    return sig.groupBy(*bead, "cycle").agg(F.when(~(reject | shut), brightest()).alias("call"))


def calls_wide(calls: DataFrame, n_cycles: int, bead: Sequence[str], fill: int | None = NO_CALL) -> DataFrame:
    """One row per bead with cy0, cy1, ...; missing calls as ``fill``."""
    wide = calls.groupBy(*bead).pivot("cycle", list(range(n_cycles))).agg(F.first("call"))
    cell = lambda k: F.col(str(k)) if fill is None else F.coalesce(F.col(str(k)), F.lit(fill))
    return wide.select(*bead, *[cell(k).cast("int").alias(f"cy{k}") for k in range(n_cycles)])


def drop_uncalled(wide: DataFrame, compat: bool = False) -> DataFrame:
    """Beads with a call in every cycle; ``compat`` keeps all of them."""
    if compat:
        return wide
    cycles = [c for c in wide.columns if c.startswith("cy")]
    out = wide
    for c in cycles:
        out = out.where(F.col(c).isNotNull() & (F.col(c) != NO_CALL))
    return out


def decode_square(
    beads: DataFrame, px: DataFrame, n_cycles: int, reference_channel: int = 0, radius: int = 2, match: bool = True,
    thresholds: Mapping[int, float] | None = None, by: Sequence[str] = (), max_size: int | None = None, **rules,
) -> DataFrame:
    """Square-window decode: by, bead_id, x, y, cy0.., bbox (the window, inclusive).

    With ``max_size`` the older edge rules apply: no measurement within two radii of an edge, no
    signal-to-noise ratio within 40 pixels.
    """
    fluor = px.where(F.col("channel") != reference_channel)
    ranks = rank_channels(px, [*by, "cycle"], reference_channel)
    bead = [*by, "bead_id"]
    samples = square_samples(beads, fluor, radius, by)
    if match:  # the table comes from whole planes, but only the samples are looked up in it
        samples = apply_match(samples, match_table(fluor, [*by, "cycle"]), [*by, "cycle"], spread_by=("bead_id",))
    sig = signal(samples, bead, thresholds)
    if max_size is not None:
        sig = edge_zero(edge_snr(sig, beads, max_size, 20 * radius, by), beads, max_size, radius, by)
    sig = attach(sig, ranks, [*by, "cycle", "channel"], spread_by=("bead_id",))
    wide = calls_wide(call_colours(sig, bead, **rules), n_cycles, bead)
    box = bbox_text(F.col("y") - radius, F.col("x") - radius, F.col("y") + radius - 1, F.col("x") + radius - 1)
    return beads.select(*bead, "x", "y", box.alias("bbox")).join(wide, bead)


def find_beads(brightfield: DataFrame, by: Sequence[str] = ("cycle", "channel")) -> tuple[DataFrame, DataFrame]:
    """Beads of a brightfield plane: (bead table, region pixels), both keyed by label."""
    bright = binary_close(above_otsu(brightfield, by), 1, by)
    regions = clear_border(components(bright, by), plane_size(brightfield, by), by)
    return bead_table(regions, by), regions


def decode_regions(
    px: DataFrame, n_cycles: int, reference_channel: int | DataFrame = 0, by: Sequence[str] = (), compat: bool = False,
    thresholds: Mapping[int, float] | None = None, **rules,
) -> DataFrame:
    """From pixels to the bead table: find beads in the first cycle's brightfield, measure each
    region in every cycle and fluorescent channel, call colours, drop beads without a full code.

    ``reference_channel`` is one channel for all, or a table (by, cycle, reference_channel)."""
    is_ref = F.col("channel") == F.lit(reference_channel) if isinstance(reference_channel, int) else F.col("channel") == F.col("reference_channel")
    if not isinstance(reference_channel, int):
        px = attach(px, reference_channel, [*by, "cycle"])
    first = px.where((F.col("cycle") == 0) & is_ref).drop("reference_channel")
    beads, regions = find_beads(first, [*by, "cycle", "channel"])
    fluor = px.where(~is_ref).drop("reference_channel")
    ranks = rank_channels(fluor, [*by, "cycle"], -1)
    bead = [*by, "label"]
    samples = apply_match(
        region_samples(regions, fluor, by), match_table(fluor, [*by, "cycle"]), [*by, "cycle"], spread_by=("label",))
    sig = signal(samples, bead, thresholds)
    sig = attach(sig, ranks, [*by, "cycle", "channel"], spread_by=("label",))
    wide = drop_uncalled(calls_wide(call_colours(sig, bead, **rules), n_cycles, bead), compat)
    box = bbox_text(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    return beads.select(*bead, "x", "y", box.alias("bbox")).join(wide, bead)
