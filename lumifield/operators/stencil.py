"""Neighbourhood filters as two one-dimensional passes.

A pass partitions by image line (rows, then columns of one plane), so a partition is never larger
than a few image sides, and costs one shuffle whatever the kernel width. Narrow kernels are window
functions; a kernel wider than ``WIDE`` taps would need as many window frames per sample, and is
computed on whole lines as arrays instead. Planes are dense grids. Several kernels share the two
passes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumifield.functions.lookup import attach, bucket
from lumifield.functions.stats import plane_size
from lumifield.functions.storage import store
from lumifield.operators.intensity import contrast_clean, percentile_threshold
from lumifield.schemas import PLANE

Kernel = tuple[Sequence[float], Sequence[float]]  # weights down, weights across
WIDE = 25   # taps; above, lines are filtered as arrays
BAND = 16   # lines per array
Size = tuple[DataFrame, int]  # stored plane sizes and their number


def stored_size(px: DataFrame, by: Sequence[str]) -> Size:
    """Stored plane sizes; a plane that is not a full grid is refused, as neighbours are found by their place."""
    size = px.groupBy(*by).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.count(F.lit(1)).alias("_n"))
    full = F.when(F.col("_n") == F.col("h") * F.col("w"), F.col("w")).otherwise(F.raise_error(F.lit("a plane has gaps")).cast("long"))
    return store(size.withColumn("w", full).drop("_n"), "size")


def gaussian(size: int, sigma: float = 0.0) -> list[float]:
    """Normalised Gaussian weights; sigma 0 is derived from the size, sizes 3 and 5 then have fixed weights."""
    if sigma <= 0:
        fixed = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625]}
        if size in fixed:
            return fixed[size]
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [r / sum(raw) for r in raw]


def box(size: int, total: float = 1.0) -> list[float]:
    return [total / size] * size


def _outside(p: Column, n: Column, radius: int, border: str) -> Column:
    """Positions at which a line of length n shows pixel p: itself and its copies beyond the ends."""
    near = (p <= radius) | (p >= n - 1 - radius)
    if border == "replicate":
        first = F.when(p == 0, F.sequence(F.lit(-radius).cast("long"), F.lit(-1).cast("long")))
        last = F.when(p == n - 1, F.sequence(n, n + (radius - 1)))
        empty = F.array().cast("array<bigint>")
        copies = F.concat(F.array(p), F.coalesce(first, empty), F.coalesce(last, empty))
    else:  # mirror without repeating the edge pixel; several bounces when the line is short
        period = F.greatest(2 * (n - 1), F.lit(1))
        bounces = F.sequence(-F.ceil(F.lit(radius) / period) - 1, F.ceil(F.lit(radius) / period) + 1)
        images = F.array_distinct(F.flatten(F.transform(
            bounces, lambda m: F.array(p + m * period, m * period - p))))
        copies = F.filter(images, lambda q: (q >= -radius) & (q < n + radius))
        copies = F.when(n == 1, F.sequence(F.lit(-radius).cast("long"), F.lit(radius).cast("long"))).otherwise(copies)
    return F.when(near, copies).otherwise(F.array(p))


def _pass(
    px: DataFrame, by: Sequence[str], axis: str, length: str,
    terms: Mapping[str, tuple[str, Sequence[float]]], border: str, keep: Sequence[str],
) -> DataFrame:
    """One line filter along ``axis``: output name -> (input column, weights)."""
    line = "x" if axis == "y" else "y"
    radius = max(len(w) // 2 for _, w in terms.values())
    padded = px.withColumn("_p", F.explode(_outside(F.col(axis), F.col(length), radius, border)))
    order = Window.partitionBy(*by, line).orderBy("_p")
    outs = []
    for name, (col, weights) in terms.items():
        r = len(weights) // 2
        if len(set(weights)) == 1 and r > 0:
            value = F.sum(F.col(col)).over(order.rowsBetween(-r, r)) * F.lit(float(weights[0]))
        else:
            taps = [F.lit(float(w)) * F.lag(col, -k).over(order) if k else F.lit(float(w)) * F.col(col)
                    for k, w in zip(range(-r, r + 1), weights)]
            value = sum(taps[1:], taps[0])
        outs.append(value.alias(name))
    return (
        padded.select(*by, "y", "x", "h", "w", *keep, "_p", *outs)
        .where(F.col("_p") == F.col(axis)).drop("_p")
    )


def _wide_pass(
    px: DataFrame, by: Sequence[str], axis: str, terms: Mapping[str, tuple[str, Sequence[float]]], border: str,
) -> DataFrame:
    """As :func:`_pass`, on bands of ``BAND`` whole lines held as an array per task call."""
    line = "x" if axis == "y" else "y"
    mode = {"mirror": "reflect", "replicate": "edge"}[border]
    schema = T.StructType([*px.schema.fields, *[T.StructField(name, T.DoubleType()) for name in terms]])
    jobs = [(name, col, [float(w) for w in weights]) for name, (col, weights) in terms.items()]

    def band(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([line, axis])
        n = int(pdf[axis].max()) + 1
        if len(pdf) != n * pdf[line].nunique() or (pdf[axis].to_numpy().reshape(-1, n) != np.arange(n)).any():
            raise ValueError("a plane has gaps")
        for name, col, weights in jobs:
            r = len(weights) // 2
            lines = np.pad(pdf[col].to_numpy(np.float64).reshape(-1, n), ((0, 0), (r, r)), mode=mode)
            pdf[name] = sum(w * lines[:, k:k + n] for k, w in enumerate(weights)).ravel()
        return pdf[[f.name for f in schema.fields]]

    return px.groupBy(*by, bucket(line, BAND)).applyInPandas(band, schema)


def filter_bank(
    px: DataFrame, kernels: Mapping[str, Kernel], by: Sequence[str] = PLANE, value: str = "v",
    border: str = "mirror", keep: Sequence[str] = (), size: Size | None = None,
) -> DataFrame:
    """Apply several separable kernels at once; one output column (double) per kernel.

    ``keep`` lists columns to carry along; the value column itself is kept. ``size`` (from
    :func:`stored_size`) saves measuring the planes again in a chain of filters.
    """
    keep = [value, *[k for k in keep if k != value]]
    if max(len(w) for kernel in kernels.values() for w in kernel) > WIDE:
        across = _wide_pass(
            px.select(*by, "y", "x", *keep), by, "x", {f"_{k}": (value, wx) for k, (_, wx) in kernels.items()}, border)
        down = _wide_pass(across, by, "y", {k: (f"_{k}", wy) for k, (wy, _) in kernels.items()}, border)
        return down.drop(*[f"_{k}" for k in kernels])
    sized = attach(px.select(*by, "y", "x", *keep), size or stored_size(px, by), by)
    across = _pass(sized, by, "x", "w", {f"_{k}": (value, wx) for k, (_, wx) in kernels.items()}, border, keep)
    down = _pass(across, by, "y", "h", {k: (f"_{k}", wy) for k, (wy, _) in kernels.items()}, border, keep)
    return down.drop("h", "w")


def blur(
    px: DataFrame, weights: Sequence[float], by: Sequence[str] = PLANE, value: str = "v", out: str = "blurred",
    border: str = "mirror", keep: Sequence[str] = (), size: Size | None = None,
) -> DataFrame:
    return filter_bank(px, {out: (weights, weights)}, by, value, border, keep, size)


def whole(c: Column) -> Column:
    """Half-even rounding to a whole number; the value is first settled to 9 places so that sums
    taken in another order round the same way."""
    return F.rint(F.round(c, 9)).cast("long")


def subtract_background(
    px: DataFrame, fraction: float = 1.0, width: int = 101, by: Sequence[str] = PLANE, value: str = "v"
) -> DataFrame:
    """Subtract a fraction of the wide Gaussian background, stopping at 0."""
    b = blur(px, gaussian(width), by, value)
    level = (whole(F.col("blurred")) * F.lit(fraction)).cast("long")
    return b.withColumn(value, F.greatest(F.col(value) - level, F.lit(0))).drop("blurred")


def unsharp(
    px: DataFrame, by: Sequence[str] = PLANE, value: str = "v", width: int = 5, sigma: float = 1.0,
    amount: float = 1.0, low_contrast: float = 0, size: Size | None = None,
) -> DataFrame:
    """Unsharp mask on 8-bit samples: (1+a) v - a blur, clipped to 0-255, half-even.

    With ``low_contrast`` > 0, pixels that differ less than that from the blur stay as they are.
    """
    b = blur(px, gaussian(width, sigma), by, value, size=size)
    soft = whole(F.col("blurred"))
    sharp = F.lit(amount + 1.0) * F.col(value) - F.lit(float(amount)) * soft
    sharp = F.rint(F.least(F.greatest(sharp, F.lit(0.0)), F.lit(255.0))).cast("long")
    if low_contrast > 0:
        sharp = F.when(F.abs(F.col(value) - soft) < low_contrast, F.col(value)).otherwise(sharp)
    return b.withColumn(value, sharp).drop("blurred")


def adaptive_threshold(
    px: DataFrame, weights: Sequence[float], offset: float, by: Sequence[str] = PLANE, value: str = "v",
    keep: Sequence[str] = (), size: Size | None = None,
) -> DataFrame:
    """255 where the sample exceeds the local (rounded) mean minus ``offset``, else 0."""
    b = blur(px, weights, by, value, border="replicate", keep=keep, size=size)
    hit = F.col(value) > whole(F.col("blurred")) - F.lit(offset)
    return b.withColumn(value, F.when(hit, 255).otherwise(0)).drop("blurred")


def bead_mask(px: DataFrame, by: Sequence[str] = PLANE, value: str = "v", min_area: int = 20) -> DataFrame:
    """Dark-bead mask of an 8-bit brightfield: sharpen, stretch, invert, sharpen, local mean with
    offset 50; dark components of at least ``min_area`` pixels are then set to bright."""
    from lumifield.operators.regions import area_at_least, components

    flip = lambda df: df.withColumn(value, F.lit(255) - F.col(value))
    size = stored_size(px, by)
    sharp, _ = store(unsharp(px, by, value, size=size), "sharp")
    stretched = flip(contrast_clean(sharp, by, 2, 98, value))
    binary, _ = store(adaptive_threshold(unsharp(stretched, by, value, size=size), box(11), 50, by, value, size=size), "binary")
    large = area_at_least(components(binary.where(F.col(value) == 0), by), min_area, by)
    out = binary.join(large.select(*by, "y", "x", F.lit(True).alias("_large")), [*by, "y", "x"], "left")
    return out.withColumn(value, F.when(F.col("_large"), 255).otherwise(F.col(value))).drop("_large")


def resample(
    px: DataFrame, size: DataFrame, by: Sequence[str] = PLANE, value: str = "v", targets: DataFrame | None = None
) -> DataFrame:
    """Bilinear resize. ``size`` has one row per plane: by, h, w (source) and th, tw (target).

    ``targets`` are the wanted positions; by default the full target grid. Each target meets at most
    four source pixels by equality on (y, x); corners of weight 0 are not joined at all.
    """
    by = list(by)
    if targets is None:
        long = lambda c: c.cast("long")
        grid = (
            size.withColumn("y", F.explode(F.sequence(long(F.lit(0)), long(F.col("th") - 1))))
            .withColumn("x", F.explode(F.sequence(long(F.lit(0)), long(F.col("tw") - 1))))
        )
    else:
        grid = attach(targets.select(*by, "y", "x"), size, by)

    def axis(t: str, n: str, tn: str):
        s = (F.col(t) + 0.5) * (F.col(n) / F.col(tn)) - 0.5
        s = F.least(F.greatest(s, F.lit(0.0)), (F.col(n) - 1).cast("double"))
        base = F.floor(s)
        frac = s - base
        return F.array(
            F.struct(base.alias("i"), (1 - frac).alias("k")),
            F.struct(F.least(base + 1, F.col(n) - 1).alias("i"), frac.alias("k")))

    corners = (
        grid.select(*by, F.col("y").alias("_ty"), F.col("x").alias("_tx"),
                    F.explode(axis("y", "h", "th")).alias("_a"), axis("x", "w", "tw").alias("_bs"))
        .where(F.col("_a.k") > 0)
        .select(*by, "_ty", "_tx", "_a", F.explode("_bs").alias("_b")).where(F.col("_b.k") > 0)
        .select(*by, "_ty", "_tx", F.col("_a.i").alias("y"), F.col("_b.i").alias("x"),
                (F.col("_a.k") * F.col("_b.k")).alias("_k"))
    )
    return (
        corners.join(px.select(*by, "y", "x", value), [*by, "y", "x"])
        .groupBy(*by, "_ty", "_tx").agg(F.sum(F.col("_k") * F.col(value)).alias(value))
        .withColumnsRenamed({"_ty": "y", "_tx": "x"})
    )


def tissue_mask(
    px: DataFrame, by: Sequence[str] = PLANE, value: str = "v", shrink: int = 10, pct: float = 20, min_area: int = 150
) -> DataFrame:
    """Keep-mask of a plane (column ``keep``): shrink, blur (5 x 5 ones / 225), dark fifth, drop dark
    areas under ``min_area``, enlarge; dark areas and zero pixels are masked out."""
    from lumifield.operators.regions import area_at_least, components

    own, _ = stored_size(px, by)
    down = own.select(*by, "h", "w", F.floor(F.col("h") / shrink).alias("th"), F.floor(F.col("w") / shrink).alias("tw"))
    small, _ = store(resample(px, down, by, value).withColumn(value, whole(F.col(value))), "small")
    weights = [1 / 15.0] * 5
    soft, _ = store(blur(small, weights, by, value).select(*by, "y", "x", whole(F.col("blurred")).alias(value)), "soft")
    dark, _ = store(percentile_threshold(soft, pct, by, value).withColumn(value, 255 - F.col(value)), "dark")
    large = area_at_least(components(dark.where(F.col(value) == 255), by), min_area, by)
    spots = dark.select(*by, "y", "x").join(
        large.select(*by, "y", "x", F.lit(255).alias(value)), [*by, "y", "x"], "left").fillna(0, [value])
    up = down.select(*by, F.col("th").alias("h"), F.col("tw").alias("w"), F.col("h").alias("th"), F.col("w").alias("tw"))
    big = resample(spots, up, by, value, targets=px).withColumnRenamed(value, "_dark")
    keep = (whole(F.col("_dark")) == 0) & (F.col(value) != 0)
    return px.join(big, [*by, "y", "x"]).select(*by, "y", "x", keep.alias("keep"))
