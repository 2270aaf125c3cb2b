"""Planes as dense blocks with a margin: one shuffle of samples, then bounded arrays whatever the width of an image."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumifield.functions.lookup import attach, bucket
from lumifield.functions.stats import plane_size
from lumifield.functions.storage import store

BLOCK = 128


@dataclass
class Block:
    """Samples ``a`` from row ``oy`` and column ``ox`` on: the block [y0, y1) x [x0, x1) and its margin, as far as the h x w image goes."""

    a: np.ndarray
    oy: int
    ox: int
    y0: int
    x0: int
    y1: int
    x1: int
    h: int
    w: int

    def rows(self, values: np.ndarray, y: int | None = None, x: int | None = None) -> pd.DataFrame:
        """(y, x, v) of a dense piece of results that starts at the given place, the block's own by default."""
        yy, xx = np.indices(values.shape)
        return pd.DataFrame({"y": (yy + (self.y0 if y is None else y)).ravel(), "x": (xx + (self.x0 if x is None else x)).ravel(), "v": values.ravel()})


def _kinds(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def map_blocks(
    px: DataFrame, by: Sequence[str], run: Callable[[Block], pd.DataFrame], schema: str, halo: int, block: int = BLOCK,
    size: DataFrame | tuple[DataFrame, int] | None = None, value: str = "v", fill: float | None = None,
) -> DataFrame:
    """``run`` on each block of each plane: the columns ``by`` and those of ``schema`` that it returns.

    Each sample goes to the blocks whose margin of ``halo`` pixels it lies in. A position without a sample is refused, unless
    ``fill`` gives its value. ``size`` has by, h, w; it is measured if not given, and not stored again if it is a pair that ``store`` returned.
    """
    by = list(by)
    size, n = size if isinstance(size, tuple) else store(plane_size(px, by) if size is None else size.select(*by, "h", "w"), "size")

    def near(c: str, side: str):
        lo, hi = (bucket(F.col(c) + k, block) for k in (-halo, halo))
        return F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, bucket(F.col(side) - 1, block))))

    dealt = attach(px.select(*by, "y", "x", F.col(value).cast("double").alias("v")), (size, n), by)
    dealt = dealt.withColumn("ky", near("y", "h")).withColumn("kx", near("x", "w"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w, ky, kx = (int(pdf[c].iloc[0]) for c in ("h", "w", "ky", "kx"))
        y0, x0 = ky * block, kx * block
        y1, x1 = min(h, y0 + block), min(w, x0 + block)
        oy, ox = max(0, y0 - halo), max(0, x0 - halo)
        a = np.full((min(h, y1 + halo) - oy, min(w, x1 + halo) - ox), np.nan if fill is None else fill)
        a[pdf["y"].to_numpy(np.int64) - oy, pdf["x"].to_numpy(np.int64) - ox] = pdf["v"].to_numpy()
        if fill is None and np.isnan(a).any():
            raise ValueError("the plane has gaps")
        out = run(Block(a, oy, ox, y0, x0, y1, x1, h, w))
        return out.assign(**{c: pdf[c].iloc[0] for c in by})[[*by, *names]]

    full = T.StructType.fromDDL(_kinds(px, by) + schema)
    names = [f.name for f in full.fields[len(by):]]
    return dealt.groupBy(*by, "ky", "kx").applyInPandas(work, full)


def blocks(
    px: DataFrame, by: Sequence[str], halo: int, block: int = BLOCK, size: DataFrame | tuple[DataFrame, int] | None = None, value: str = "v", fill: float | None = None,
) -> DataFrame:
    """Stored blocks: by, ky, kx, oy, ox, ny, nx (the array's place and sides), h, w (the image's) and data (32-bit floats)."""
    def pack(b: Block) -> pd.DataFrame:
        return pd.DataFrame({"ky": [b.y0 // block], "kx": [b.x0 // block], "oy": [b.oy], "ox": [b.ox], "ny": [b.a.shape[0]], "nx": [b.a.shape[1]],
                             "h": [b.h], "w": [b.w], "data": [b.a.astype("<f4").tobytes()]})

    return store(map_blocks(px, by, pack, "ky long, kx long, oy long, ox long, ny long, nx long, h long, w long, data binary", halo, block, size, value, fill), "blocks")[0]


def visit(
    points: DataFrame, held: DataFrame, by: Sequence[str], run: Callable[[pd.DataFrame, Block], pd.DataFrame], schema: T.StructType,
    y: str, x: str, block: int = BLOCK,
) -> DataFrame:
    """``run`` on the points of each block, by their columns ``y`` and ``x``, with the block from :func:`blocks`; points outside all blocks give no row.

    A block holds at most as many points as it has room for; its array is sent once, not with each point.
    """
    by, kinds = list(by), held.schema
    at = lambda c: bucket(F.col(c), block)
    keyed = points.withColumn("_ky", at(y)).withColumn("_kx", at(x))
    own = held.select(*[F.col(c).alias(f"{c}_b") for c in by], "ky", "kx", *[c for c in kinds.names if c not in (*by, "ky", "kx")])

    def work(pts: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        if pts.empty or mine.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        b = mine.iloc[0]
        a = np.frombuffer(b["data"], "<f4").reshape(int(b["ny"]), int(b["nx"])).astype(np.float64)
        y0, x0 = int(b["ky"]) * block, int(b["kx"]) * block
        got = Block(a, int(b["oy"]), int(b["ox"]), y0, x0, min(int(b["h"]), y0 + block), min(int(b["w"]), x0 + block), int(b["h"]), int(b["w"]))
        return run(pts.drop(columns=["_ky", "_kx"]), got)[schema.names]

    return keyed.groupBy(*by, "_ky", "_kx").cogroup(own.groupBy(*[f"{c}_b" for c in by], "ky", "kx")).applyInPandas(work, schema)


def routed(
    jobs: DataFrame, px: DataFrame, by: Sequence[str], run: Callable[[pd.Series, np.ndarray], pd.DataFrame], schema: str,
    block: int = BLOCK, size: DataFrame | tuple[DataFrame, int] | None = None, value: str = "v", fill: float | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """``run`` on each job with the window of its plane that it asks for; the columns ``by``, ``carry`` and those of ``schema``.

    jobs: by, job (names it in its plane), sy0, sy1, sx0, sx1 (the window, which may reach beyond the image), ``carry`` and whatever ``run`` needs. Each
    block of a plane is sent once to each job whose window meets it. Beyond the image the window is 0.
    """
    by = list(by)
    held = map_blocks(px, by, lambda b: pd.DataFrame({"ky": [b.y0 // block], "kx": [b.x0 // block], "n": [b.a.shape[1]], "data": [b.a.astype("<f8").tobytes()]}),
                      "ky long, kx long, n long, data binary", 0, block, size, value, fill)
    spans = lambda lo, hi: F.explode(F.sequence(F.greatest(bucket(lo, block), F.lit(0)), F.greatest(bucket(F.col(hi) - 1, block), F.lit(0))))
    asked = jobs.where("sy1 > sy0 AND sx1 > sx0").select(*by, "job", spans("sy0", "sy1").alias("ky"), spans("sx0", "sx1").alias("kx"))
    sent = held.join(asked, [*by, "ky", "kx"]).select(*[F.col(c).alias(f"{c}_b") for c in by], F.col("job").alias("job_b"), "ky", "kx", "n", "data")

    def work(job: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        j = job.iloc[0]
        sy, sx, ny, nx = int(j["sy0"]), int(j["sx0"]), max(0, int(j["sy1"] - j["sy0"])), max(0, int(j["sx1"] - j["sx0"]))
        a = np.zeros((ny, nx))
        for ky, kx, n, data in zip(parts["ky"], parts["kx"], parts["n"], parts["data"]):
            piece = np.frombuffer(data, "<f8").reshape(-1, int(n))
            y, x = int(ky) * block - sy, int(kx) * block - sx
            (t, l), (d, r) = (max(0, y), max(0, x)), (min(ny, y + piece.shape[0]), min(nx, x + piece.shape[1]))
            a[t:d, l:r] = piece[t - y : d - y, l - x : r - x]
        return run(j, a).assign(**{c: j[c] for c in (*by, *carry)})[[f.name for f in full.fields]]

    full = T.StructType.fromDDL(_kinds(jobs, [*by, *carry]) + schema)
    return jobs.groupBy(*by, "job").cogroup(sent.groupBy(*[f"{c}_b" for c in by], "job_b")).applyInPandas(work, full)


def bilinear(b: Block, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Samples at real positions of the image; beyond its edge the edge goes on. Positions are to lie in the block's array or beyond the image."""
    y, x = np.clip(y, 0, b.h - 1) - b.oy, np.clip(x, 0, b.w - 1) - b.ox
    iy = np.clip(np.floor(y).astype(np.int64), 0, max(b.a.shape[0] - 2, 0))
    ix = np.clip(np.floor(x).astype(np.int64), 0, max(b.a.shape[1] - 2, 0))
    fy, fx = y - iy, x - ix
    jy, jx = np.minimum(iy + 1, b.a.shape[0] - 1), np.minimum(ix + 1, b.a.shape[1] - 1)
    return (b.a[iy, ix] * (1 - fx) + b.a[iy, jx] * fx) * (1 - fy) + (b.a[jy, ix] * (1 - fx) + b.a[jy, jx] * fx) * fy


def covers(b: Block, y: np.ndarray, x: np.ndarray, reach: int) -> np.ndarray:
    """Is everything within ``reach`` of the positions in the array, but for what lies beyond the image?"""
    low = lambda v, o: (v - reach >= o) | (o == 0)
    high = lambda v, o, n, side: (v + reach + 1 < o + n) | (o + n == side)
    return low(y, b.oy) & low(x, b.ox) & high(y, b.oy, b.a.shape[0], b.h) & high(x, b.ox, b.a.shape[1], b.w)
