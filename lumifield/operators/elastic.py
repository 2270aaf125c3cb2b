"""A bend of each tile, as a grid of cubic splines fitted to the fixed image."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumifield.functions.blocks import BLOCK, routed
from lumifield.functions.constants import ELASTIC_MESH, ELASTIC_ROUNDS
from lumifield.operators.registration import MATRIX, _source_window, _warp_part, bend_at, spline_basis

GAIN = 1e-5  # rise of the correlation below which the fit ends


def tile_images(
    px: DataFrame, windows: DataFrame, transforms: DataFrame | None, plane: Sequence[str], image: Sequence[str], value: str = "v",
) -> DataFrame:
    """Each tile's window of its image, warped by its transform if there is one: image columns, tile_id, ny, nx, data (32-bit floats).

    A tile is one row, bounded by its window; ``px`` is dense, with the columns ``plane``, a part of those of ``image``.
    """
    image, plane = list(image), list(plane)
    geo = windows.select(*image, "tile_id", *[F.col(c).cast("long").alias(c) for c in ("y0", "y1", "x0", "x1")])
    if transforms is None:
        geo = geo.withColumns({m: F.lit(None).cast("double") for m in MATRIX})
    else:
        geo = geo.join(transforms.select(*image, "tile_id", *MATRIX), [*image, "tile_id"], "left")
    zero = F.lit(0).cast("long")
    geo = geo.withColumns({"ty0": zero, "tx0": zero, "ty1": F.col("y1") - F.col("y0"), "tx1": F.col("x1") - F.col("x0")})
    geo = geo.withColumns(_source_window(F.col("ty0"), F.col("tx0"), F.col("ty1"), F.col("tx1")))
    inside = lambda c, lo, hi: F.least(F.greatest(F.col(c) + F.col(lo), F.col(lo)), F.col(hi))
    geo = geo.withColumns({"sy0": inside("sy0", "y0", "y1"), "sy1": inside("sy1", "y0", "y1"), "sx0": inside("sx0", "x0", "x1"), "sx1": inside("sx1", "x0", "x1")})

    def run(j: pd.Series, a: np.ndarray) -> pd.DataFrame:
        got = _warp_part(j, a, 0, 0, tuple(int(j[c]) for c in ("y0", "y1", "x0", "x1")))
        return pd.DataFrame({"ny": [got.shape[0]], "nx": [got.shape[1]], "data": [got.astype("<f4").tobytes()]})

    jobs = geo.withColumn("job", F.struct(*image, "tile_id"))
    return routed(jobs, px, plane, run, "ny long, nx long, data binary", value=value, carry=[c for c in (*image, "tile_id") if c not in plane]).select(
        *image, "tile_id", "ny", "nx", "data")


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays; 0 if either is constant."""
    a, b = a - a.mean(), b - b.mean()
    size = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / size) if size > 0 else 0.0


def _read(row) -> np.ndarray:
    return np.frombuffer(row["data"], "<f4").reshape(int(row["ny"]), int(row["nx"])).astype(np.float64)


def _sample(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    iy, ix = np.clip(np.floor(y).astype(np.int64), 0, a.shape[0] - 2), np.clip(np.floor(x).astype(np.int64), 0, a.shape[1] - 2)
    fy, fx = y - iy, x - ix
    return (a[iy, ix] * (1 - fx) + a[iy, ix + 1] * fx) * (1 - fy) + (a[iy + 1, ix] * (1 - fx) + a[iy + 1, ix + 1] * fx) * fy


def fit_bend(fixed: np.ndarray, moving: np.ndarray, mesh: int = ELASTIC_MESH, rounds: int = ELASTIC_ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Spline weights (rows, columns) of the bend u for which moving(p + u(p)) correlates best with fixed(p) where it is inside the image, and
    the correlation over the whole, 0 being outside.

    Gauss-Newton steps on the difference to the fixed image, brightness and contrast being fitted along; a step that lowers the correlation is
    damped until it doesn't. Sums of products of splines are separable, so a step costs a few products of matrices.
    """
    ny, nx = fixed.shape
    by, bx = spline_basis(np.arange(ny), ny, mesh), spline_basis(np.arange(nx), nx, mesh)
    n = mesh + 3
    weights = np.zeros((2, n, n))
    if min(ny, nx) < 2 or fixed.std() == 0 or moving.std() == 0:
        return weights[0], weights[1], correlation(fixed, moving)
    gy, gx = np.gradient(moving)
    py, px = (np.einsum("pi,pk->ikp", b, b).reshape(n * n, -1) for b in (by, bx))
    yy, xx = np.indices(fixed.shape)

    def bent(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y, x = yy + by @ w[0] @ bx.T, xx + by @ w[1] @ bx.T
        return y, x, (y >= 0) & (y <= ny - 1) & (x >= 0) & (x <= nx - 1)

    def score(w: np.ndarray) -> float:
        y, x, ok = bent(w)
        return correlation(fixed[ok], _sample(moving, y, x)[ok]) if 2 * ok.sum() > ok.size else -1.0

    best, damp = score(weights), 1e-3
    for _ in range(rounds):
        y, x, ok = bent(weights)
        seen = _sample(moving, y, x)
        f, s = fixed[ok], seen[ok]
        slope = ((f - f.mean()) * (s - s.mean())).sum() / max(((s - s.mean()) ** 2).sum(), 1e-12)
        off = np.where(ok, fixed - f.mean() - slope * (seen - s.mean()), 0)
        dy, dx = (np.where(ok, slope * _sample(g, y, x), 0) for g in (gy, gx))
        cross = lambda w: (py @ w @ px.T).reshape(n, n, n, n).transpose(0, 2, 1, 3).reshape(n * n, n * n)
        h = np.block([[cross(dy * dy), cross(dy * dx)], [cross(dy * dx), cross(dx * dx)]])
        g = np.r_[(by.T @ (dy * off) @ bx).ravel(), (by.T @ (dx * off) @ bx).ravel()]
        size = np.trace(h) / len(h)
        if size <= 0:
            break
        for _ in range(6):
            step = np.linalg.solve(h + damp * size * np.eye(len(h)), g).reshape(2, n, n)
            new = score(weights + step)
            if new > best:
                break
            damp *= 8
        else:
            break
        weights, gain, best, damp = weights + step, new - best, new, max(damp / 8, 1e-6)
        if gain < GAIN:
            break
    y, x, ok = bent(weights)
    return weights[0], weights[1], correlation(fixed, np.where(ok, _sample(moving, y, x), 0))


def compare(fixed: DataFrame, moving: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, ncc) of the tile images that both sides have, cut to their common size."""
    by = list(by)
    both = moving.join(fixed.select(*by, *[F.col(c).alias(f"f_{c}") for c in ("ny", "nx", "data")]), by)
    schema = T.StructType([*[both.schema[c] for c in by], T.StructField("ncc", T.DoubleType())])

    def run(parts):
        for pdf in parts:
            a = [_read({k: r[f"f_{k}"] for k in ("ny", "nx", "data")}) for _, r in pdf.iterrows()]
            b = [_read(r) for _, r in pdf.iterrows()]
            cut = [(min(p.shape[0], q.shape[0]), min(p.shape[1], q.shape[1])) for p, q in zip(a, b)]
            yield pdf[by].assign(ncc=[correlation(p[:m, :n], q[:m, :n]) for p, q, (m, n) in zip(a, b, cut)])

    return both.mapInPandas(run, schema)


def bend(fixed: DataFrame, moving: DataFrame, by: Sequence[str], mesh: int = ELASTIC_MESH, rounds: int = ELASTIC_ROUNDS) -> DataFrame:
    """Bend of each tile (images as from :func:`tile_images`): by, bend_y, bend_x (spline weights row by row), ncc."""
    by = list(by)
    both = moving.join(fixed.select(*by, *[F.col(c).alias(f"f_{c}") for c in ("ny", "nx", "data")]), by)
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[both.schema[c] for c in by], T.StructField("bend_y", numbers), T.StructField("bend_x", numbers), T.StructField("ncc", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        wy, wx, ncc = fit_bend(_read({k: r[f"f_{k}"] for k in ("ny", "nx", "data")}), _read(r), mesh, rounds)
        return pdf[by].assign(bend_y=[wy.ravel()], bend_x=[wx.ravel()], ncc=ncc)

    return both.groupBy(*by).applyInPandas(run, schema)


__all__ = ["BLOCK", "bend", "bend_at", "compare", "correlation", "fit_bend", "tile_images"]
