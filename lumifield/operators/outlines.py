"""Outlines of regions and of the holes in them: areas, moments, lengths, and which lies in which.

An outline runs through the centres of region pixels: around a region its outer border, around a hole the region pixels next to it.
Regions are 8-connected and the background is 4-connected. So each 2 x 2 group of pixels ("cell") is a sum of parts
that belong to one region or one piece of background each, whatever the rest looks like:

* the cell of four region pixels is the region's, and the triangle of three;
* the triangle of a background pixel between two region pixels is the background's, and the cell of two next to each other, three or four.

What an outline encloses is then the sum of the parts of its region or hole and of everything inside it. Regions and pieces of background
that meet form a tree with the outside as root, in which the one with the smaller first pixel is the parent.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumifield.functions.lookup import attach, bucket
from lumifield.functions.storage import store
from lumifield.operators.regions import BLOCK, ROW_STRIDE, _join_pieces, components, pixel_id
from lumifield.schemas import PLANE

NONE = -(2 ** 63)
CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))
SUMS = ("area2", "mx6", "my6")  # twice the area, six times its first moments: whole numbers
STEPS = ("straight", "diagonal")


def _background(free: np.ndarray, oy: int, ox: int) -> np.ndarray:
    """Least pixel id of each 4-connected piece of ``free``, NONE elsewhere."""
    n, m = free.shape
    at = np.arange(n * m).reshape(n, m)
    down, right = free[:-1] & free[1:], free[:, :-1] & free[:, 1:]
    a, b = np.r_[at[:-1][down], at[:, :-1][right]], np.r_[at[1:][down], at[:, 1:][right]]
    root = np.arange(n * m)
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    ids = (oy + root // m) * ROW_STRIDE + ox + root % m
    return np.where(free, ids.reshape(n, m), NONE)


def _parts(labels: np.ndarray, pieces: np.ndarray, valid: np.ndarray, oy: int, ox: int) -> pd.DataFrame:
    """Sums over the cells of a block: rows of a region (region), of a piece (piece) and of a border (both)."""
    cut = lambda g, y, x: g[y : y + len(g) - 1, x : x + g.shape[1] - 1]
    lab, bg = ([cut(g, y, x)[valid] for y, x in CORNERS] for g in (labels, pieces))
    yy, xx = (c[valid] for c in np.meshgrid(np.arange(labels.shape[0] - 1) + oy, np.arange(labels.shape[1] - 1) + ox, indexing="ij"))
    is_bg = [b != NONE for b in bg]
    k = 4 - sum(b.astype(int) for b in is_bg)
    region = np.maximum.reduce(lab)
    crossed = (k == 2) & (is_bg[0] == is_bg[3])
    out = []

    def add(rows: np.ndarray, regions, piece, area2=0, sx=0, sy=0, straight=0, diagonal=0) -> None:
        times = 3 * area2  # 3 x + the sum of a triangle's offsets, or 6 x + 3
        out.append(pd.DataFrame({
            "region": regions[rows] if regions is not None else NONE, "piece": piece[rows] if piece is not None else NONE,
            "area2": area2, "mx6": times * xx[rows] + sx, "my6": times * yy[rows] + sy, "straight": straight, "diagonal": diagonal}))

    add(k == 4, region, None, 2, 3, 3)
    whole = (k <= 1) | ((k == 2) & ~crossed)
    add(whole, None, np.maximum.reduce(bg), 2, 3, 3)
    add(k == 1, region, np.maximum.reduce(bg))
    add((k == 2) & ~crossed, region, np.maximum.reduce(bg), straight=1)
    for i, (y, x) in enumerate(CORNERS):
        alone = is_bg[i] & (crossed | (k == 3))
        add(alone, None, bg[i], 1, 1 + x, 1 + y)  # the corner, the one beside it and the one above or below
        add(alone, region, bg[i], diagonal=1)
        add(is_bg[i] & (k == 3), region, None, 1, 2 - x, 2 - y)
    return pd.concat(out).groupby(["region", "piece"], as_index=False).sum()


def _block(pdf: pd.DataFrame, block: int) -> pd.DataFrame:
    """Sums of a block's cells, and the pieces along its sides and just beyond them. The block has the first row and column of its neighbours too."""
    ky, kx = int(pdf["ky"].iloc[0]), int(pdf["kx"].iloc[0])
    oy, ox, n = ky * block, kx * block, block + 1
    mark = pdf[pdf["label"].isna()].iloc[0]
    y0, x0, y1, x1 = (int(mark[c]) for c in ("y0", "x0", "y1", "x1"))
    own = pdf[pdf["label"].notna()]
    labels = np.full((n, n), NONE, np.int64)
    labels[own["y"].to_numpy(np.int64) - oy, own["x"].to_numpy(np.int64) - ox] = own["label"].to_numpy(np.int64)
    ys, xs = np.arange(oy, oy + n), np.arange(ox, ox + n)
    inside = ((ys >= y0) & (ys <= y1))[:, None] & ((xs >= x0) & (xs <= x1))[None, :]
    pieces = _background(inside & (labels == NONE), oy, ox)
    out = _parts(labels, pieces, inside[:-1, :-1] & inside[1:, 1:], oy, ox).assign(kind="sum", given=False, ky=ky, kx=kx, side=None)
    sides = [("top", False, ky, kx, pieces[0, :-1]), ("left", False, ky, kx, pieces[:-1, 0]), ("corner", False, ky, kx, pieces[:1, 0]),
             ("top", True, ky + 1, kx, pieces[-1, :-1]), ("left", True, ky, kx + 1, pieces[:-1, -1]), ("corner", True, ky + 1, kx + 1, pieces[-1:, -1])]
    more = pd.DataFrame([(*s, NONE, NONE) for s in sides if (s[4] != NONE).any()], columns=["kind", "given", "ky", "kx", "side", "region", "piece"])
    return pd.concat([out, more]).fillna({c: 0 for c in (*SUMS, *STEPS)}).astype({c: np.int64 for c in (*SUMS, *STEPS)})


def outlines(regions: DataFrame, by: Sequence[str] = PLANE, block: int = BLOCK) -> DataFrame:
    """One row per region and per hole: by, label (its least pixel id), hole, parent (the label of what it lies in, null outside),
    m00 (area within the outline), m10, m01 (first moments of that area) and length of the outline.

    ``regions`` has by, y, x and label, as :func:`components` gives them. Everything inside an outline counts as area, holes and what lies in them too. Only
    the rectangle around the regions of a plane is looked at, in blocks with one row and column of the next blocks; the
    background pieces of neighbouring blocks that share a pixel are joined as regions are. Enclosed areas are then summed up the tree, a
    level a round, over rows that are one per region or hole. No regions give no rows.
    """
    by = list(by)
    fg = regions.select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "label")
    box, n = store(fg.groupBy(*by).agg((F.min("y") - 1).alias("y0"), (F.min("x") - 1).alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1")), "boxes")
    spans = lambda lo, hi: F.explode(F.sequence(bucket(lo, block), bucket(hi, block)))
    none = F.lit(None).cast("long")
    grid = box.withColumn("ky", spans("y0", "y1")).withColumn("kx", spans("x0", "x1")).select(
        *by, "ky", "kx", none.alias("y"), none.alias("x"), none.alias("label"), "y0", "x0", "y1", "x1")
    at = lambda c: F.explode(F.when(F.pmod(F.col(c), F.lit(block)) == 0, F.array(bucket(c, block), bucket(c, block) - 1)).otherwise(F.array(bucket(c, block))))
    rows = fg.withColumn("ky", at("y")).withColumn("kx", at("x")).select(*by, "ky", "kx", "y", "x", "label", *[none.alias(c) for c in ("y0", "x0", "y1", "x1")])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in box.select(*by).schema.fields)
    numbers = ", ".join(f"{c} long" for c in ("region", "piece", *SUMS, *STEPS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _block(pdf, block).assign(**{c: pdf[c].iloc[0] for c in by})
        return out[[*by, "kind", "given", "ky", "kx", "side", "region", "piece", *SUMS, *STEPS]]

    schema = f"{kinds}, kind string, given boolean, ky long, kx long, side array<long>, {numbers}"
    table, _ = store(rows.unionByName(grid).groupBy(*by, "ky", "kx").applyInPandas(run, schema), "cells")

    key = [*by, "kind", "ky", "kx"]
    mine = table.where("kind <> 'sum' AND NOT given").select(*key, F.col("side").alias("mine"))
    theirs = table.where("kind <> 'sum' AND given").select(*key, F.col("side").alias("theirs"))
    met = mine.join(theirs, key).select(*by, F.inline(F.array_distinct(F.arrays_zip("mine", "theirs"))))
    edges = met.where((F.col("mine") != F.col("theirs")) & (F.col("mine") != NONE)).select(*by, F.col("mine").alias("a"), F.col("theirs").alias("b")).distinct()
    edges, n_edges = store(edges, "edges")
    sums = table.where("kind = 'sum'").drop("kind", "given", "ky", "kx", "side")
    if n_edges:
        sums = attach(sums, _join_pieces(edges, by).withColumnRenamed("node", "piece"), [*by, "piece"], how="left", spread=1)
        sums = sums.withColumn("piece", F.coalesce("label", "piece")).drop("label")
    total = [F.sum(c).alias(c) for c in (*SUMS, *STEPS)]
    sums, _ = store(sums.groupBy(*by, "region", "piece").agg(*total), "sums")

    own = sums.where((F.col("region") == NONE) | (F.col("piece") == NONE)).select(*by, F.greatest("region", "piece").alias("label"), *SUMS)
    outside = box.select(*by, pixel_id(F.col("y0"), F.col("x0")).alias("outside"))
    border = sums.where((F.col("region") != NONE) & (F.col("piece") != NONE)).select(
        *by, F.greatest("region", "piece").alias("label"), F.least("region", "piece").alias("parent"), (F.col("piece") > F.col("region")).alias("hole"), *STEPS)
    border = attach(border, (outside, n), by, spread_by=("label",))
    tree = border.join(own, [*by, "label"], "left").select(
        *by, "label", "hole", F.nullif("parent", F.col("outside")).alias("parent"), *[F.coalesce(c, F.lit(0)).alias(c) for c in SUMS], *STEPS)
    tree, _ = store(tree, "tree")

    # what lies in a node goes to it, then to what that lies in, and so on
    within = None
    moved = tree.where("parent IS NOT NULL").groupBy(*by, F.col("parent").alias("of")).agg(*total[:3])
    while True:
        moved, left = store(moved, "within")
        if not left:
            break
        within = moved if within is None else within.unionByName(moved)
        up = tree.where("parent IS NOT NULL").select(*by, F.col("label").alias("of"), "parent")
        moved = moved.join(up, [*by, "of"]).groupBy(*by, F.col("parent").alias("of")).agg(*total[:3])
    if within is not None:
        more = within.groupBy(*by, F.col("of").alias("label")).agg(*[F.sum(c).alias(f"in_{c}") for c in SUMS])
        tree = tree.join(more, [*by, "label"], "left").withColumns({c: F.col(c) + F.coalesce(f"in_{c}", F.lit(0)) for c in SUMS})
    return tree.select(
        *by, "label", "hole", "parent", (F.col("area2") / 2).alias("m00"), (F.col("mx6") / 6).alias("m10"), (F.col("my6") / 6).alias("m01"),
        (F.col("straight") + F.col("diagonal") * F.lit(2.0 ** 0.5)).alias("length"))


def contour_moments(regions: DataFrame, by: Sequence[str] = PLANE, block: int = BLOCK) -> DataFrame:
    """Area, first moments and length of the outer outline of each region; holes count as area."""
    return outlines(regions, by, block).where("NOT hole").drop("hole", "parent")


def _centre(c: str):
    return F.round(F.try_divide(F.col(c), F.col("m00")), 9)


def centres(outlined: DataFrame, by: Sequence[str] = PLANE) -> DataFrame:
    """Rounded centre of each outline; (0, 0) when the outline has no area."""
    at = lambda c: F.coalesce(F.rint(_centre(c)), F.lit(0)).cast("long")
    return outlined.select(*by, "label", "hole", at("m10").alias("x"), at("m01").alias("y"))


def contour_centres(regions: DataFrame, by: Sequence[str] = PLANE, block: int = BLOCK) -> DataFrame:
    """Rounded centre of the outline of each region and each hole."""
    return centres(outlines(regions, by, block), by)


def top_blobs(regions: DataFrame, by: Sequence[str] = ("tile_id",), k: int = 500, min_circularity: float = 0.5) -> DataFrame:
    """Key points: the ``k`` largest round regions of each group, by area, ties by centre, all descending. Regions inside others don't count."""
    m = outlines(regions, by).where("NOT hole AND parent IS NULL")
    circ = F.lit(4 * math.pi) * F.col("m00") / F.when(F.col("length") > 0, F.col("length") * F.col("length"))
    good = m.withColumn("circularity", circ).where(
        (F.col("circularity") >= min_circularity) & (F.col("m00") > 0)
    ).select(*by, _centre("m10").cast("long").alias("x"), _centre("m01").cast("long").alias("y"), F.col("m00").alias("area"), "circularity")
    order = Window.partitionBy(*by).orderBy(F.desc("area"), F.desc("x"), F.desc("y"))
    return good.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def find_points(
    px: DataFrame, by: Sequence[str] = PLANE, k: int = 500, min_circularity: float = 0.5, value: str = "v"
) -> DataFrame:
    """Key points of raw samples: 8 bits, 3 x 3 smoothing, local Gaussian threshold (11 x 11, offset 2),
    then :func:`top_blobs`."""
    from lumifield.operators.intensity import minmax_8bit
    from lumifield.operators.stencil import adaptive_threshold, blur, gaussian, stored_size, whole

    size = stored_size(px, by)
    soft = blur(minmax_8bit(px, by, value), gaussian(3), by, value, size=size)
    smooth = soft.select(*by, "y", "x", whole(F.col("blurred")).alias(value))
    bright = adaptive_threshold(smooth, gaussian(11), 2, by, value, size=size).where(F.col(value) == 255)
    return top_blobs(components(bright.select(*by, "y", "x"), by), by, k, min_circularity)


def second_pass(
    px: DataFrame, beads: DataFrame, by: Sequence[str] = PLANE, level: float = 120, radius: int = 3
) -> DataFrame:
    """Beads missed so far: black out the known ones, 3 x 3 mean, threshold, centres of all outlines, of
    holes too; united with the known beads, each position once."""
    from lumifield.operators.intensity import binary_threshold, black_out
    from lumifield.operators.stencil import blur, box, whole

    rest = black_out(px, beads.select(*by, "y", "x"), radius, by)
    soft = blur(rest, box(3), by).select(*by, "y", "x", whole(F.col("blurred")).alias("v"))
    found = components(binary_threshold(soft, level).where("v = 255"), by)
    missed = contour_centres(found, by).select(*by, "x", "y")
    return missed.unionByName(beads.select(*by, "x", "y")).distinct()
