"""Connected regions (8-neighbour), their measures and filters.

Labelling works in two steps. Square blocks of the image are labelled on their own (a bounded piece
of work per block); pieces that touch across block borders then form a small graph, whose
components are found by joins and grouped minima. A region's label is the smallest id among its
pixels, so results do not depend on the order of work. Rows keep their piece (``frag``) next to
the label: a piece is at most one block, so joins on it have no hot keys even if one region covers
a third of the image.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumifield.functions.constants import BBOX_FORMAT
from lumifield.functions.lookup import attach, bucket
from lumifield.functions.stats import plane_size
from lumifield.functions.storage import store, store_observed
from lumifield.schemas import PLANE

ROW_STRIDE = 2 ** 32  # pixel id = y * ROW_STRIDE + x, in reading order for any image width
BLOCK = 128


def pixel_id(y: Column, x: Column) -> Column:
    return y * F.lit(ROW_STRIDE) + x


def _label_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Label the pixels of one block: least pixel id over 8-neighbour steps, by pointer jumping."""
    ids = pdf["y"].to_numpy(np.int64) * ROW_STRIDE + pdf["x"].to_numpy(np.int64)
    order = np.argsort(ids)
    y, x = (pdf[c].to_numpy(np.int64)[order] for c in ("y", "x"))
    y, x = y - y.min() + 1, x - x.min() + 1
    at = np.full((y.max() + 2, x.max() + 2), -1)
    at[y, x] = np.arange(len(ids))
    near = [np.stack([at[y, x], at[y + dy, x + dx]]) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]
    a, b = np.concatenate([e[:, e[1] >= 0] for e in near], axis=1)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    frag = np.empty_like(ids)
    frag[order] = ids[order][root]
    return pdf.assign(frag=frag)


def _join_pieces(edges: DataFrame, by: list[str]) -> DataFrame:
    """Least label of every node of the piece graph (columns by, a, b): neighbours' minimum, then
    the label's own label, until a round changes nothing. Each round is written, not kept in lineage."""
    both = edges.unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    both, _ = store(both.distinct(), "edges")
    nodes = both.select(*by, F.col("a").alias("node")).distinct()
    labels, _ = store(nodes.withColumn("label", F.col("node")), "labels")
    while True:
        seen = labels.select(*by, F.col("node").alias("b"), F.col("label").alias("_l"))
        near = both.join(seen, [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("_l").alias("_near"))
        low = labels.join(near, [*by, "node"]).select(*by, "node", F.least("label", "_near").alias("_low"), "label")
        low, n = store(low, "low")
        jump = low.select(*by, F.col("node").alias("_low"), F.col("_low").alias("_next"))
        nxt = attach(low, (jump, n), [*by, "_low"], spread_by=("node",)).select(
            *by, "node", F.least("_low", "_next").alias("label"), (F.least("_low", "_next") < F.col("label")).alias("_new"))
        labels, seen_counts = store_observed(nxt, "labels", changed=F.count_if("_new"))
        labels = labels.drop("_new")
        if not seen_counts["changed"]:
            return labels


def components(fg: DataFrame, by: Sequence[str] = PLANE, block: int = BLOCK) -> DataFrame:
    """Label foreground pixels: all columns of ``fg`` plus ``frag`` and ``label``."""
    by = list(by)
    schema = T.StructType([*fg.schema.fields, T.StructField("frag", T.LongType())])
    cols = fg.columns
    keyed = fg.withColumn("_ky", bucket("y", block)).withColumn("_kx", bucket("x", block))

    def label_block(pdf: pd.DataFrame) -> pd.DataFrame:
        return _label_block(pdf)[[*cols, "frag"]]

    pieces, _ = store(keyed.groupBy(*by, "_ky", "_kx").applyInPandas(label_block, schema), "pieces")

    edge = lambda c: F.pmod(F.col(c), F.lit(block)).isin(0, block - 1)
    rim = pieces.where(edge("y") | edge("x")).select(*by, "y", "x", "frag")
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
                      for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    ahead = rim.withColumn("_s", F.explode(steps)).select(
        *by, F.col("frag").alias("a"), bucket("y", block).alias("_ky"), bucket("x", block).alias("_kx"),
        (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"),
    ).where((bucket("y", block) != F.col("_ky")) | (bucket("x", block) != F.col("_kx")))
    edges = ahead.join(rim.withColumnRenamed("frag", "b"), [*by, "y", "x"]).select(*by, "a", "b").distinct()
    edges, n_edges = store(edges, "edges")
    if n_edges == 0:
        return pieces.withColumn("label", F.col("frag"))
    labels = _join_pieces(edges, by).withColumnRenamed("node", "frag")
    return attach(pieces, labels, [*by, "frag"], how="left", spread=1).withColumn("label", F.coalesce("label", "frag"))


def keep_labels(regions: DataFrame, labels: DataFrame, by: Sequence[str] = PLANE) -> DataFrame:
    """Rows of the listed labels. The list is first taken down to pieces, then joined by piece."""
    pieces = regions.select(*by, "frag", "label").distinct()
    kept = pieces.join(labels.select(*by, "label"), [*by, "label"], "left_semi").select(*by, "frag")
    return attach(regions, kept, [*by, "frag"], how="left_semi", spread=1)


def clear_border(regions: DataFrame, size: DataFrame, by: Sequence[str] = PLANE) -> DataFrame:
    """Drop regions that touch the image border; ``size`` has by, h, w."""
    box = regions.groupBy(*by, "label").agg(
        F.min("y").alias("y1"), F.min("x").alias("x1"), F.max("y").alias("y2"), F.max("x").alias("x2"))
    sized = attach(box, size.select(*by, "h", "w"), by, spread_by=("label",))
    inner = sized.where(
        (F.col("y1") > 0) & (F.col("x1") > 0) & (F.col("y2") < F.col("h") - 1) & (F.col("x2") < F.col("w") - 1))
    return keep_labels(regions, inner, by)


def area_at_least(regions: DataFrame, n: int, by: Sequence[str] = PLANE) -> DataFrame:
    """Regions of at least ``n`` pixels (binary area opening)."""
    area = regions.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("area")).where(F.col("area") >= n)
    return keep_labels(regions, area, by)


def _runs(a: np.ndarray, axis: int, before: int, after: int) -> np.ndarray:
    """Number of set positions from ``before`` ahead of each position to ``after`` behind it along an axis; nothing is set beyond the array."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (before + 1, after)
    total = np.cumsum(np.pad(a.astype(np.int32), pad), axis=axis)
    n, span = a.shape[axis], before + after + 1
    return np.take(total, np.arange(span, span + n), axis) - np.take(total, np.arange(n), axis)


def binary_close(fg: DataFrame, size: int, by: Sequence[str] = PLANE) -> DataFrame:
    """Closing of a foreground set with a size x size square; positions outside the image stay unset.

    A 1 x 1 square changes nothing. Otherwise a position is marked if a pixel's square covers it (dilation), and a marked one stays if its whole
    square is marked (erosion). Both go along rows and then columns by differences of running counts, in blocks with a margin: the work
    per pixel does not grow with the square.
    """
    if size == 1:
        return fg
    from lumifield.functions.blocks import Block, map_blocks

    lo, hi, halo = size // 2, size - size // 2 - 1, 2 * size

    def run(b: Block) -> pd.DataFrame:
        a = np.pad(b.a > 0, halo)  # marks may lie beyond the image
        for axis in (0, 1):
            a = _runs(a, axis, hi, lo) > 0
        for axis in (0, 1):
            a = _runs(a, axis, lo, hi) == size
        y, x = b.y0 - b.oy + halo, b.x0 - b.ox + halo
        yy, xx = np.nonzero(a[y : y + b.y1 - b.y0, x : x + b.x1 - b.x0])
        return pd.DataFrame({"y": yy + b.y0, "x": xx + b.x0})

    marked = fg.select(*by, "y", "x", F.lit(1).alias("v"))
    return map_blocks(marked, by, run, "y long, x long", halo, max(BLOCK, 8 * size), fill=0)


def measure(regions: DataFrame, by: Sequence[str] = PLANE, value: str = "v") -> DataFrame:
    """Area, bounding box, plain and intensity-weighted centroid of each region."""
    v = F.col(value)
    agg = regions.groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("area"),
        F.min("y").alias("y1"), F.min("x").alias("x1"), F.max("y").alias("y2"), F.max("x").alias("x2"),
        F.sum("y").alias("_sy"), F.sum("x").alias("_sx"),
        F.sum(F.col("y") * v).alias("_wy"), F.sum(F.col("x") * v).alias("_wx"), F.sum(v).alias("_w"))
    return agg.select(
        *by, "label", "area", "y1", "x1", "y2", "x2",
        (F.col("_sy") / F.col("area")).alias("cy"), (F.col("_sx") / F.col("area")).alias("cx"),
        F.try_divide(F.col("_wy"), F.col("_w")).alias("wy"), F.try_divide(F.col("_wx"), F.col("_w")).alias("wx"))


def bbox_text(y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    return F.format_string(BBOX_FORMAT, y1, x1, y2, x2)


def bead_table(regions: DataFrame, by: Sequence[str] = PLANE, value: str = "v") -> DataFrame:
    """One bead per distinct rounded weighted centre; equal centres keep the lowest label."""
    m = measure(regions, by, value)
    at = lambda c: F.rint(F.col(c)).cast("long")
    whole = F.struct("label", "area", "y1", "x1", "y2", "x2")
    best = (
        m.withColumn("x", at("wx")).withColumn("y", at("wy"))
        .groupBy(*by, "x", "y").agg(F.min_by(whole, "label").alias("_b"))
    )
    return best.select(*by, "x", "y", "_b.*")


def distinct_beads(beads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return beads.dropDuplicates([*by, "x", "y"])


def inside_edges(beads: DataFrame, radius: int, max_size: int | Column, closed_low: bool = False) -> DataFrame:
    """Beads at least two radii from every edge; ``closed_low`` also admits exactly two on the low side."""
    def ok(c: str) -> Column:
        low = F.col(c) - 2 * radius
        return ((low >= 0) if closed_low else (low > 0)) & (F.col(c) + 2 * radius < max_size)
    return beads.where(ok("x") & ok("y"))


def range_filter(beads: DataFrame, low: int | Column, high: int | Column, literal: bool = False) -> DataFrame:
    """Beads with both coordinates in (low, high).

    ``literal`` gives the older rule, in which a small x alone is enough and a failing bead becomes (0, 0).
    """
    x, y = F.col("x"), F.col("y")
    if not literal:
        return beads.where((x > low) & (x < high) & (y > low) & (y < high))
    ok = ((x > low) & (x < high) & (y > low)) | (x < high)
    return beads.withColumns({"x": F.when(ok, x).otherwise(0), "y": F.when(ok, y).otherwise(0)})


__all__ = [
    "area_at_least", "bbox_text", "bead_table", "binary_close", "clear_border", "components", "distinct_beads", "inside_edges",
    "keep_labels", "measure", "plane_size", "range_filter",
]
