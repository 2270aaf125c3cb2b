"""Key points followed from one image to another with sub-pixel precision, by gradients on an image pyramid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumifield.functions.blocks import BLOCK, Block, bilinear, blocks, covers, map_blocks, visit
from lumifield.functions.constants import INLIER_PX, MIN_POINTS, TRACK_EPS, TRACK_ERROR, TRACK_MIN_EIGEN, TRACK_SETS
from lumifield.functions.lookup import attach
from lumifield.functions.stats import plane_size
from lumifield.functions.storage import store, store_observed
from lumifield.operators.registration import MATRIX, _residual2, fit_affine_robust

SLACK = 16  # pixels that a point may move on a level before it is sent to another block
TAPS = np.array([1, 4, 6, 4, 1]) / 16
LOT = 256  # points that are worked on at a time


def halve(px: DataFrame, by: Sequence[str], size: DataFrame | tuple[DataFrame, int] | None = None, fill: float | None = None) -> DataFrame:
    """The next level of a pyramid (by, y, x, v): five taps each way, mirrored at the edges, every second row and column, whole numbers."""
    def run(b: Block) -> pd.DataFrame:
        a = np.pad(b.a, [(2 * (o == 0), 2 * (o + n == side)) for o, n, side in ((b.oy, b.a.shape[0], b.h), (b.ox, b.a.shape[1], b.w))],
                   mode="reflect" if min(b.a.shape) > 2 else "symmetric")
        for axis in (0, 1):
            n = a.shape[axis] - 4
            a = sum(t * np.take(a, np.arange(k, k + n), axis) for k, t in enumerate(TAPS))
        return b.rows(np.floor(a[::2, ::2] + 0.5).astype(np.int64), b.y0 // 2, b.x0 // 2)

    return map_blocks(px, by, run, "y long, x long, v long", 2, 2 * BLOCK, size, fill=fill)


def pyramid(px: DataFrame, by: Sequence[str], levels: int, fill: float | None = None) -> list[tuple[DataFrame, tuple[DataFrame, int]]]:
    """The image and ``levels`` smaller ones, each half the size of the one before; each with its stored size and the number of planes."""
    out = [(px, store(plane_size(px, by), "size"))]
    for level in range(levels):
        big, size = out[-1]
        small, _ = store(halve(big, by, size, None if level else fill), "level")
        half = size[0].select(*by, F.ceil(F.col("h") / 2).alias("h"), F.ceil(F.col("w") / 2).alias("w"))
        out.append((small, store(half, "size")))
    return out


def _window(radius: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(-radius, radius + 1.0)
    return k[None, :, None], k[None, None, :]


def _patches(pts: pd.DataFrame, b: Block, scale: float) -> pd.DataFrame:
    """The source's samples around each point, one pixel wider than its window."""
    out = np.empty(len(pts), object)
    for radius, rows in pts.groupby("radius").indices.items():
        for lo in range(0, len(rows), LOT):
            part = rows[lo : lo + LOT]
            dy, dx = _window(int(radius) + 1)
            y, x = (pts[c].to_numpy(float)[part][:, None, None] / scale for c in ("y", "x"))
            for k, patch in zip(part, bilinear(b, y + dy, x + dx).astype("<f4")):
                out[k] = patch.tobytes()
    return pts.assign(patch=out)


def _follow(pts: pd.DataFrame, b: Block, scale: float, eps: float, least: float) -> pd.DataFrame:
    """Steps of each point until it stands still, has no steps left, or leaves what the block holds (done false)."""
    col = lambda c: pts[c].to_numpy(float).copy()
    flow_y, flow_x, back_y, back_x, error = (col(c) for c in ("flow_y", "flow_x", "back_y", "back_x", "error"))
    steps, live, done = pts["steps"].to_numpy(np.int64).copy(), pts["live"].to_numpy(bool).copy(), pts["done"].to_numpy(bool).copy()
    y, x = col("y") / scale, col("x") / scale
    for radius, rows in pts.groupby("radius").indices.items():
        r, n = int(radius), 2 * int(radius) + 1
        dy, dx = _window(r)
        for lo in range(0, len(rows), LOT):
            part = rows[lo : lo + LOT]
            wide = np.stack([np.frombuffer(p, "<f4").reshape(n + 2, n + 2).astype(float) for p in pts["patch"].to_numpy()[part]])
            side = lambda i, j: wide[:, 1 + i : n + 1 + i, 1 + j : n + 1 + j]
            gx = (3 * (side(-1, 1) - side(-1, -1)) + 10 * (side(0, 1) - side(0, -1)) + 3 * (side(1, 1) - side(1, -1))) / 32
            gy = (3 * (side(1, -1) - side(-1, -1)) + 10 * (side(1, 0) - side(-1, 0)) + 3 * (side(1, 1) - side(-1, 1))) / 32
            xx, xy, yy = ((u * v).mean((1, 2)) for u, v in ((gx, gx), (gx, gy), (gy, gy)))
            flat = (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2 < least
            live[part[flat]] = False
            done[part[flat]] = True
            det = np.where(flat, 1, xx * yy - xy * xy)
            while True:
                act = np.flatnonzero(~done[part] & (steps[part] > 0) & covers(b, y[part] + flow_y[part], x[part] + flow_x[part], r + 1))
                if not len(act):
                    break
                who = part[act]
                seen = bilinear(b, (y[who] + flow_y[who])[:, None, None] + dy, (x[who] + flow_x[who])[:, None, None] + dx)
                off = wide[act, 1:-1, 1:-1] - seen
                bx, by = (off * gx[act]).mean((1, 2)), (off * gy[act]).mean((1, 2))
                sx, sy = (yy[act] * bx - xy[act] * by) / det[act], (xx[act] * by - xy[act] * bx) / det[act]
                swing = (np.abs(sx + back_x[who]) < 0.01) & (np.abs(sy + back_y[who]) < 0.01)  # to and fro between two places: stop half-way
                flow_x[who] += np.where(swing, sx / 2, sx)
                flow_y[who] += np.where(swing, sy / 2, sy)
                back_x[who], back_y[who] = sx, sy
                steps[who] -= 1
                done[who] = swing | (sx * sx + sy * sy <= eps * eps) | (steps[who] == 0)
                py, px = y[who] + flow_y[who], x[who] + flow_x[who]
                gone = (py < -r) | (px < -r) | (py >= b.h + r) | (px >= b.w + r)
                live[who[gone]] = False
                done[who[gone]] = True
            sure = np.flatnonzero(live[part] & done[part] & covers(b, y[part] + flow_y[part], x[part] + flow_x[part], r + 1))
            who = part[sure]
            seen = bilinear(b, (y[who] + flow_y[who])[:, None, None] + dy, (x[who] + flow_x[who])[:, None, None] + dx)
            error[who] = np.abs(wide[sure, 1:-1, 1:-1] - seen).mean((1, 2))
    return pts.assign(flow_y=flow_y, flow_x=flow_x, back_y=back_y, back_x=back_x, error=error, steps=steps, live=live, done=done)


def track(
    points: DataFrame, source: DataFrame, target: DataFrame, by: Sequence[str] = ("tile_id",), source_plane: Sequence[str] = (),
    target_plane: Sequence[str] = (), sets: Sequence[tuple[int, int, int]] = TRACK_SETS, eps: float = TRACK_EPS,
    least: float = TRACK_MIN_EIGEN, fill: float | None = None,
) -> DataFrame:
    """Where each key point of ``source`` is in ``target``: by, set, rank, x, y, u, v (real position in the target), error.

    points: by, the plane columns, rank (names a point in its group), x, y. Images have their plane columns, y, x and v (8 bits). ``sets`` are
    (window side, levels above the image, steps): each is tried for every point, as set 0, 1, ...

    From the coarsest level on, the window around a point is compared with the window around its place so far in the target; the two by two equations of the
    source's gradients give a step, until it is shorter than ``eps`` or there are no steps left. A point is lost where its window has no gradient in
    some direction (``least``, the smaller eigenvalue of the mean gradient product) or it leaves the image; lost points give no row. error is the mean
    difference of the windows.

    Images are blocks with a margin; points are sent to the block of their place, twice a level: to get the source's window, and to be
    followed. A point that outruns the margin is sent on to the block it has come to.
    """
    by, source_plane, target_plane = list(by), list(source_plane), list(target_plane)
    levels, widest = max(s[1] for s in sets), max(s[0] for s in sets) // 2
    small = [pyramid(img, plane, levels, fill) for img, plane in ((source, source_plane), (target, target_plane))]
    keys = list(dict.fromkeys([*by, *source_plane, *target_plane]))
    set_rows = F.array(*[F.struct(F.lit(i).alias("set"), F.lit(s[0] // 2).alias("radius"), F.lit(s[1]).alias("top"), F.lit(s[2]).alias("most")) for i, s in enumerate(sets)])
    zero = F.lit(0.0)
    state = points.select(*keys, "rank", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.inline(set_rows)).withColumns(
        {"flow_y": zero, "flow_x": zero, "live": F.lit(True), "error": zero})
    state, _ = store(state, "points")
    for level in reversed(range(levels + 1)):
        scale = float(2 ** level)
        held = [blocks(img[level][0], plane, widest + 2 + extra, size=img[level][1], fill=fill if level == 0 else None)
                for img, plane, extra in ((small[0], source_plane, 1), (small[1], target_plane, SLACK))]
        waits = state.where(F.col("top") < level)
        todo = state.where(F.col("top") >= level).withColumns({
            "flow_y": F.when(F.col("top") > level, 2 * F.col("flow_y")).otherwise(zero), "flow_x": F.when(F.col("top") > level, 2 * F.col("flow_x")).otherwise(zero),
            "back_y": zero, "back_x": zero, "steps": F.col("most").cast("long"), "done": F.lit(False), "_y": F.col("y") / scale, "_x": F.col("x") / scale})
        schema = T.StructType([*[f for f in todo.schema.fields if f.name not in ("_y", "_x")], T.StructField("patch", T.BinaryType())])
        todo = visit(todo, held[0], source_plane, lambda p, b, s=scale: _patches(p, b, s), schema, "_y", "_x")
        sides, n = small[1][level][1]
        last = sides.select(*target_plane, (F.col("h") - 1).alias("_h"), (F.col("w") - 1).alias("_w")), n
        ended = None
        while True:
            # beyond the image: the block at its edge
            at = lambda c, end: F.least(F.greatest(F.col(c) / scale + F.col(f"flow_{c}"), zero), F.col(end).cast("double"))
            placed = attach(todo, last, target_plane, spread_by=("rank",)).withColumns({"_y": at("y", "_h"), "_x": at("x", "_w")})
            moved, seen = store_observed(visit(placed, held[1], target_plane, lambda p, b, s=scale: _follow(p, b, s, eps, least), schema, "_y", "_x"), "moved",
                                         open=F.count_if(~F.col("done")))
            done = moved.where("done").drop("patch", "back_y", "back_x", "steps", "done")
            ended = done if ended is None else ended.unionByName(done)
            if not seen["open"]:
                break
            todo = moved.where("NOT done")
        state, _ = store(waits.unionByName(ended.where("live")), "points")
    return state.select(*by, "set", "rank", "x", "y", (F.col("x") + F.col("flow_x")).alias("u"), (F.col("y") + F.col("flow_y")).alias("v"), "error")


def tracked_affine(
    tracked: DataFrame, by: Sequence[str] = ("tile_id",), most_error: float = TRACK_ERROR, inlier_px: float = INLIER_PX
) -> DataFrame:
    """Affine of each group from the set of tracked points with most inliers (the first on ties): by, set, inliers, a .. ty."""
    by = list(by)
    good = tracked.where(F.col("error") < most_error)
    order = F.row_number().over(Window.partitionBy(*by, "set").orderBy("rank"))  # a tile has a bounded number of key points
    pairs, _ = store(good.select(*by, "set", order.alias("rank"), "x", "y", "u", "v"), "pairs")
    fits, _ = store(fit_affine_robust(pairs, [*by, "set"], inlier_px=inlier_px), "fits")
    votes = pairs.join(fits, [*by, "set"]).groupBy(*by, "set", *MATRIX).agg(F.count_if(_residual2() <= inlier_px * inlier_px).alias("inliers"))
    best = votes.groupBy(*by).agg(F.max_by(F.struct("set", "inliers", *MATRIX), F.struct("inliers", -F.col("set"))).alias("_b"))
    return best.select(*by, "_b.*").where(F.col("inliers") >= MIN_POINTS)

