"""Finding and applying tile transforms.

A transform is six columns a, b, tx, c, d, ty: a moving point (x, y) goes to
(a x + b y + tx, c x + d y + ty). Coordinates are those of the tile window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from lumifield.functions.blocks import BLOCK, routed
from lumifield.functions.constants import (
    INLIER_PX, MATCH_RATIO, MATRIX_FORMAT, MIN_POINTS, NCC_REUSE, NCC_STAGE_2, NCC_STAGE_3, RANSAC_ROUNDS,
)
from lumifield.functions.lookup import attach, bucket
from lumifield.functions.stats import plane_size
from lumifield.functions.storage import store, store_observed
from lumifield.operators.intensity import ncc_agg, ncc_columns
from lumifield.operators.matching import two_nearest
from lumifield.operators.tiles import core_offset, half_side
from lumifield.schemas import PLANE

MATRIX = ("a", "b", "tx", "c", "d", "ty")


def pair_by_rank(
    fixed: DataFrame, moving: DataFrame, by: Sequence[str] = ("tile_id",), at_least: int = MIN_POINTS
) -> DataFrame:
    """Key points paired by rank, cut to the shorter list; groups with too few in a list give none."""
    a = fixed.select(*by, "rank", F.col("x").alias("u"), F.col("y").alias("v"))
    b = moving.select(*by, "rank", "x", "y")
    enough = a.join(b, [*by, "rank"])
    size = enough.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least).select(*by)
    return attach(enough, size, by, how="left_semi", spread_by=("rank",))


def ratio_matches(
    nearest: DataFrame, by: Sequence[str] = ("tile_id",), ratio: float = MATCH_RATIO, at_least: int = MIN_POINTS
) -> DataFrame:
    """Matches whose nearest distance is below ``ratio`` times the second; groups with too few give none."""
    d = lambda r: F.max(F.when(F.col("rank") == r, F.col("dist")))
    best = nearest.groupBy(*by, "q_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("c_id"))).alias("c_id"), d(1).alias("d1"), d(2).alias("d2"))
    good, _ = store(best.where(F.col("d1") < F.lit(ratio) * F.col("d2")), "matches")
    enough = good.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least).select(*by)
    return attach(good, enough, by, how="left_semi", spread_by=("q_id",))


def fit_affine(pairs: DataFrame, by: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Least-squares affine per group from point pairs (x, y) -> (u, v): one aggregate, closed form."""
    x, y, u, v = (F.col(c).cast("double") for c in "xyuv")
    s = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(u).alias("su"), F.sum(v).alias("sv"),
        F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"),
        F.sum(x * u).alias("sxu"), F.sum(y * u).alias("syu"), F.sum(x * v).alias("sxv"), F.sum(y * v).alias("syv"))
    cov = lambda p, a, b: F.col(p) - F.col(a) * F.col(b) / F.col("n")
    cxx, cxy, cyy = cov("sxx", "sx", "sx"), cov("sxy", "sx", "sy"), cov("syy", "sy", "sy")
    det = cxx * cyy - cxy * cxy
    safe = F.when(F.abs(det) > 1e-9, det)
    first = lambda t: (cov(f"sx{t}", "sx", f"s{t}") * cyy - cov(f"sy{t}", "sy", f"s{t}") * cxy) / safe
    second = lambda t: (cov(f"sy{t}", "sy", f"s{t}") * cxx - cov(f"sx{t}", "sx", f"s{t}") * cxy) / safe
    m = s.select(*by, "n", "sx", "sy", "su", "sv", first("u").alias("a"), second("u").alias("b"),
                 first("v").alias("c"), second("v").alias("d"))
    shift = lambda t, p, q: (F.col(t) - F.col(p) * F.col("sx") - F.col(q) * F.col("sy")) / F.col("n")
    return m.where(F.col("a").isNotNull()).select(
        *by, "a", "b", shift("su", "a", "b").alias("tx"), "c", "d", shift("sv", "c", "d").alias("ty"))


def _residual2() -> Column:
    ex = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("tx") - F.col("u")
    ey = F.col("c") * F.col("x") + F.col("d") * F.col("y") + F.col("ty") - F.col("v")
    return ex * ex + ey * ey


PACK = 4096  # pairs that one task holds of a group
FIRST_PART = 64
VOTES_AT_ONCE = 1 << 20  # residuals held at once


def fit_affine_robust(
    pairs: DataFrame, by: Sequence[str] = ("tile_id",), tries: int = 64, inlier_px: float = INLIER_PX,
    confidence: float = 0.99, most: int = RANSAC_ROUNDS, pack: int = PACK,
) -> DataFrame:
    """Affine from the largest agreeing subset of the pairs.

    Triples are drawn by a fixed arithmetic rule (so every run, and every engine, draws the same), each gives
    a model, the model with most pairs within ``inlier_px`` wins (the first drawn of equal ones), and its inliers are fitted again. A group has
    ``tries`` draws at first, and four times as many each round until, by its share of inliers so far, a
    clean triple has been drawn with ``confidence``, or ``most`` have been drawn. ``pairs`` carries rank 1..n inside the group.

    Pairs travel in packs of ``pack``, once a round, and models are counted on growing parts of them: see :func:`most_inliers`.
    """
    by = list(by)
    pairs, _ = store(pairs.select(*by, "rank", *[F.col(c).cast("double") for c in "xyuv"]), "pairs")
    sizes = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_POINTS)
    todo, left = store(sizes, "sizes")
    best, done = None, 0
    while left:
        draws = (
            todo.withColumn("try", F.explode(F.sequence(F.lit(done), F.lit(tries - 1))))
            .withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(2))))
            .withColumn("_s", (3 * F.col("try") + F.col("m") + 1).cast("long"))
            .withColumn("rank", ((F.col("_s") * F.col("_s") * 7919 + F.col("_s") * 104729) % 1000003 % F.col("_n") + 1).cast("int"))
            .select(*by, "try", "rank").distinct()
        )
        models = fit_affine(draws.join(pairs, [*by, "rank"]), [*by, "try"])
        found = most_inliers(models, pairs, (todo, left), by, inlier_px, best, pack)
        best, _ = store(_most_voted(found if best is None else found.unionByName(best), by), "models")
        if tries >= most:
            break
        seen = todo.join(best.select(*by, "inliers"), by, "left").withColumn(
            "_clean", F.pow(F.coalesce("inliers", F.lit(0)) / F.col("_n"), F.lit(3.0)))
        need = F.when(F.col("_clean") >= 1, 0.0).when(F.col("_clean") <= 0, float(most)).otherwise(
            math.log(1 - confidence) / F.log1p(-F.col("_clean")))
        todo, left = store(seen.where(need > tries).select(*by, "_n"), "sizes")
        done, tries = tries, min(most, 4 * tries)
    if best is None:
        return fit_affine(pairs.where("false"), by)
    inliers = attach(pairs, best.select(*by, *MATRIX), by, spread_by=("rank",)).where(_residual2() <= inlier_px * inlier_px)
    return fit_affine(inliers.select(*by, "x", "y", "u", "v"), by)


def _most_voted(votes: DataFrame, by: list[str]) -> DataFrame:
    first = F.struct("inliers", -F.col("try"))
    return votes.groupBy(*by).agg(F.max_by(F.struct("try", *MATRIX, "inliers"), first).alias("_m")).select(*by, "_m.*")


def most_inliers(
    models: DataFrame, pairs: DataFrame, sizes: tuple[DataFrame, int], by: list[str], inlier_px: float,
    known: DataFrame | None = None, pack: int = PACK,
) -> DataFrame:
    """The model of each group (by, try, matrix) with most pairs within ``inlier_px``: by, try, matrix, inliers.

    Equal counts: least try. ``sizes`` (by, _n) with their row count; ``known``: a model counted before, at whose ``inliers`` a new
    one has to arrive. A group without a model of enough inliers may give none if ``known`` has one.

    A group is dealt into packs of about ``pack`` pairs by a hash. A model counts in one task per pack; after each part, it
    is given up once its count and all pairs that are left stay below the best count so far. A model's count can only rise, so
    the winner is that of counting every model on every pair. A group of one pack is decided in its task, in parts of 64,
    128, 256, ... pairs; others in rounds over 1, 2, 4, ... packs, whose counts are summed. What moves is pairs and
    models once per pack, never models times pairs.
    """
    packs, seen = store_observed(
        sizes[0].select(*by, "_n", F.ceil(F.col("_n") / F.lit(pack)).cast("int").alias("_packs")), "packs", most=F.max("_packs"))
    fewest = F.lit(0).cast("long")
    if known is not None:
        packs = packs.join(known.select(*by, F.col("inliers").alias("_least")), by, "left").withColumn("_least", F.coalesce("_least", fewest))
    else:
        packs = packs.withColumn("_least", fewest)
    dealt = attach(pairs, (packs, sizes[1]), by, spread_by=("rank",)).withColumn(
        "_pack", F.pmod(F.xxhash64("rank"), F.col("_packs")).cast("int"))
    dealt = dealt.select(*by, "_pack", "rank", *"xyuv", "_n", "_least")
    alive, n_alive = store(models.select(*by, "try", *MATRIX, F.lit(0).cast("long").alias("inliers")), "models")
    schema = T.StructType([*alive.schema.fields[:-1], T.StructField("inliers", T.LongType()), T.StructField("_counted", T.LongType())])
    near = inlier_px * inlier_px

    def count(ms: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        if ms.empty or ps.empty:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema.fields})
        ps = ps.sort_values("rank")
        x, y, u, v = (ps[c].to_numpy()[None, :] for c in "xyuv")
        alone, least = len(ps) == ps["_n"].iloc[0], int(ps["_least"].iloc[0])
        m = ms.sort_values("try").reset_index(drop=True)
        votes, start, part = np.zeros(len(m), np.int64), 0, FIRST_PART
        while start < len(ps):
            at = slice(start, start + part)
            group = max(1, VOTES_AT_ONCE // part)
            for g in (slice(i, i + group) for i in range(0, len(m), group)):
                a, b, tx, c, d, ty = (m[k].to_numpy()[g, None] for k in MATRIX)
                ex = a * x[:, at] + b * y[:, at] + tx - u[:, at]
                ey = c * x[:, at] + d * y[:, at] + ty - v[:, at]
                votes[g] += (ex * ex + ey * ey <= near).sum(1)
            start, part = min(len(ps), at.stop), 2 * part
            if alone:
                least = max(least, int(votes.max()))
                stay = votes + (len(ps) - start) >= least
                m, votes = m[stay].reset_index(drop=True), votes[stay]
                if m.empty:
                    break
        if alone and len(m):
            m, votes = m.iloc[[int(votes.argmax())]], votes[[int(votes.argmax())]]
        return m[[*by, "try", *MATRIX]].assign(inliers=votes, _counted=np.int64(len(ps)))

    first, step, total = 0, 1, int(seen["most"] or 0)
    whole = [*by, "try", *MATRIX]
    while first < total and n_alive:
        last = min(total, first + step)
        here = (F.col("_pack") >= first) & (F.col("_pack") < last)
        places = packs.select(*by, F.explode(F.expr(f"filter(sequence({first}, {last - 1}), p -> p < _packs)")).alias("_pack"))
        asked = alive.drop("inliers").join(places, by)
        keys = [*by, "_pack"]
        counted = asked.groupBy(*keys).cogroup(dealt.where(here).groupBy(*keys)).applyInPandas(count, schema)
        if total == 1:
            return counted.drop("_counted")
        # a lone pack has given up all models of its group but one
        before = alive.withColumn("_counted", F.lit(0).cast("long")) if not first else alive
        lone = packs.where(F.col("_packs") == 1).select(*by)
        old = before.join(lone, by, "left_anti") if not first else before
        sums = old.unionByName(counted).groupBy(*whole).agg(F.sum("inliers").alias("inliers"), F.sum("_counted").alias("_counted"))
        sums, _ = store(sums, "votes")
        top = sums.groupBy(*by).agg(F.max("inliers").alias("_top")).join(packs.select(*by, "_n", "_least"), by)
        alive, n_alive = store(attach(sums, top, by, spread_by=("try",)).where(
            F.col("inliers") + F.col("_n") - F.col("_counted") >= F.greatest("_top", "_least")).select(*whole, "inliers", "_counted"), "models")
        first, step = last, 2 * step
    return _most_voted(alive.select(*whole, "inliers"), by)


def shift_search(
    fixed: DataFrame, moving: DataFrame, by: Sequence[str] = ("tile_id",), radius: int = 2,
    plane: Sequence[str] = (), value: str = "v",
) -> DataFrame:
    """NCC of every whole-pixel shift up to ``radius`` for each group of ``moving``.

    Result: by, dy, dx, ncc, where the moving sample at (y, x) is compared with the fixed one at
    (y - dy, x - dx). Fixed neighbours are gathered along image lines (windows bounded by an image
    side), so both inputs are shuffled a fixed number of times; the shifts are expanded only
    inside the aggregation stage and never written or shuffled as rows. ``fixed`` is a dense plane: one with gaps
    is refused, as neighbours are found by their place in the line.
    """
    plane, by = list(plane), list(by)
    span = range(-radius, radius + 1)
    rows = Window.partitionBy(*plane, "y").orderBy("x")
    cols = Window.partitionBy(*plane, "x").orderBy("y")
    at = lambda c, k, w: F.lag(c, k).over(w) if k else F.col(c)
    gap = F.raise_error(F.lit("the fixed plane has gaps"))

    def dense(c: str, axis: str, w: WindowSpec) -> Column:
        before = F.lag(axis, 1).over(w)
        return F.when(before.isNull() | (before == F.col(axis) - 1), F.col(c)).otherwise(gap)

    line = fixed.select(*plane, "y", "x", value).withColumn(
        "_line", F.array(*[at(value, k, rows) for k in span])).withColumn("x", dense("x", "x", rows).cast("long")).drop(value)
    near = line.withColumn("_near", F.array(*[at("_line", k, cols) for k in span])).withColumn(
        "y", dense("y", "y", cols).cast("long")).drop("_line")
    joined = moving.join(near, [*plane, "y", "x"])
    opened = joined.select(*by, F.col(value).alias("_m"), F.posexplode("_near").alias("_dy", "_row")).where(
        F.col("_row").isNotNull()).select(
        *by, "_m", "_dy", F.posexplode("_row").alias("_dx", "_f")).where(F.col("_f").isNotNull())
    sums = opened.groupBy(*by, (F.col("_dy") - radius).alias("dy"), (F.col("_dx") - radius).alias("dx")).agg(
        *ncc_agg(F.col("_f").cast("long"), F.col("_m").cast("long")))
    return sums.select(
        *by, "dy", "dx", ncc_columns(*(F.col(c) for c in ("n", "sa", "sb", "sab", "saa", "sbb"))).alias("ncc"))


def _smooth_size(n: int) -> int:
    """Least number from ``n`` on without prime factors over 5, for which the transform is fast."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def correlations(moving: np.ndarray, there: np.ndarray, fixed: np.ndarray, known: np.ndarray) -> np.ndarray:
    """NCC of ``moving`` with ``fixed`` at every place of it: [ky, kx] compares moving[i] with fixed[i + k]; NaN where nothing is compared.

    Both hold whole numbers from 0 on, with masks of the positions that count. The six sums of all places come from products of
    Fourier transforms. Factors are cut into bytes, so that every product is a whole number far below 2^53, to which it
    is rounded: the sums are exact.
    """
    shape = tuple(_smooth_size(n) for n in fixed.shape)
    out = tuple(f - m + 1 for f, m in zip(fixed.shape, moving.shape))

    def spectra(a: np.ndarray, mirrored: bool) -> list[np.ndarray]:
        parts = []
        while True:
            t = np.fft.rfft2((a & 255).astype(np.float64), shape)
            parts.append(np.conj(t) if mirrored else t)
            a = a >> 8
            if not a.any():
                return parts

    def total(m: list[np.ndarray], f: list[np.ndarray]) -> np.ndarray:
        got = np.zeros(out, np.int64)
        for i, p in enumerate(m):
            for j, q in enumerate(f):
                got += np.rint(np.fft.irfft2(p * q, shape)[: out[0], : out[1]]).astype(np.int64) << (8 * (i + j))
        return got

    there, known, moving, fixed = there.astype(np.int64), known.astype(np.int64), moving * there, fixed * known
    if float(moving.max(initial=0)) * float(fixed.max(initial=0)) * moving.size >= 2.0 ** 62 or max(moving.max(initial=0), fixed.max(initial=0)) ** 2.0 * moving.size >= 2.0 ** 62:
        raise ValueError("samples are too large for exact sums")
    at, seen = spectra(there, True), spectra(known, False)
    m, f = spectra(moving, True), spectra(fixed, False)
    n, sa, sb, sab = total(at, seen), total(at, f), total(m, seen), total(m, f)
    saa, sbb = total(at, spectra(fixed * fixed, False)), total(spectra(moving * moving, True), seen)
    with np.errstate(divide="ignore", invalid="ignore"):
        n, sa, sb, sab, saa, sbb = (v.astype(np.longdouble) for v in (n, sa, sb, sab, saa, sbb))
        size = np.sqrt(np.maximum(n * saa - sa * sa, 0)) * np.sqrt(np.maximum(n * sbb - sb * sb, 0))
        return np.where(n == 0, np.nan, np.where(size > 0, (n * sab - sa * sb) / size, 0)).astype(np.float64)


def search_shifts(
    fixed: DataFrame, moving: DataFrame, by: Sequence[str] = ("tile_id",), reach: int = 6, plane: Sequence[str] = (), value: str = "v",
) -> DataFrame:
    """Best of all whole-pixel shifts up to ``reach`` for each group: by, dy, dx, ncc, on_rim; ties as in :func:`best_shift`.

    Every shift is scored exactly (see :func:`correlations`), by as many operations as a few transforms of a tile take, whatever the
    reach. A tile and the window of the fixed plane around it are one task, bounded by the tile's side and the reach. on_rim: the shift lies at the rim of what
    was searched, so the true one may be farther off. ``fixed`` is a dense plane of whole numbers, one with gaps is refused; ``moving`` may have gaps.
    """
    by, plane = list(by), list(plane)
    sides, n = store(plane_size(fixed, plane), "sides")
    box = moving.groupBy(*dict.fromkeys([*plane, *by])).agg(*[f(c).cast("long").alias(f"_{c}{k}") for c in "yx" for k, f in ((0, F.min), (1, F.max))])
    box = attach(box, (sides, n), plane, spread_by=by)
    zero = F.lit(0).cast("long")
    jobs = box.withColumns({
        "sy0": F.greatest(F.col("_y0") - reach, zero), "sy1": F.least(F.col("_y1") + 1 + reach, F.col("h").cast("long")),
        "sx0": F.greatest(F.col("_x0") - reach, zero), "sx1": F.least(F.col("_x1") + 1 + reach, F.col("w").cast("long")), "job": F.struct(*by)})
    jobs, _ = store(jobs, "jobs")
    names = ("_y0", "_x0", "_y1", "_x1", "sy0", "sx0", "ny", "nx")

    def pack(j: pd.Series, a: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({**{c: [j[c]] for c in names[:6]}, "ny": [a.shape[0]], "nx": [a.shape[1]], "data": [a.astype("<f8").tobytes()]})

    windows = routed(jobs, fixed, plane, pack, "".join(f"{c} long, " for c in names) + "data binary", size=sides, value=value,
                     carry=[c for c in by if c not in plane])
    schema = T.StructType([*[moving.schema[c] for c in by], *[T.StructField(c, T.IntegerType()) for c in ("dy", "dx")],
                           T.StructField("ncc", T.DoubleType()), T.StructField("on_rim", T.BooleanType())])

    def search(px: pd.DataFrame, win: pd.DataFrame) -> pd.DataFrame:
        if px.empty or win.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        w = win.iloc[0]
        y0, x0, y1, x1, sy, sx, ny, nx = (int(w[c]) for c in names)
        a = np.zeros((y1 - y0 + 1, x1 - x0 + 1), np.int64)
        there = np.zeros(a.shape, bool)
        at = px["y"].to_numpy(np.int64) - y0, px["x"].to_numpy(np.int64) - x0
        a[at], there[at] = px["_v"].to_numpy(np.int64), True
        b = np.zeros((a.shape[0] + 2 * reach, a.shape[1] + 2 * reach), np.int64)
        known = np.zeros(b.shape, bool)
        put = slice(sy - y0 + reach, sy - y0 + reach + max(ny, 0)), slice(sx - x0 + reach, sx - x0 + reach + max(nx, 0))
        if ny > 0 and nx > 0:
            b[put], known[put] = np.rint(np.frombuffer(w["data"], "<f8").reshape(ny, nx)).astype(np.int64), True
        least = min(int(a[there].min()), int(b[known].min()) if known.any() else 0)  # a constant changes no correlation
        ncc = correlations((a - least) * there, there, (b - least) * known, known)[::-1, ::-1]  # by dy and dx from -reach on
        if np.isnan(ncc).all():
            return pd.DataFrame({f.name: [] for f in schema.fields})
        score = np.round(ncc, 9)
        dy, dx = np.argwhere(score == np.nanmax(score))[0]
        return px[by].head(1).assign(dy=int(dy) - reach, dx=int(dx) - reach, ncc=float(ncc[dy, dx]), on_rim=max(abs(int(dy) - reach), abs(int(dx) - reach)) >= reach)

    own = moving.select(*by, "y", "x", F.col(value).alias("_v"))
    held = windows.select(*[F.col(c).alias(f"{c}_w") for c in by], *names, "data")
    return own.groupBy(*by).cogroup(held.groupBy(*[f"{c}_w" for c in by])).applyInPandas(search, schema)


def best_shift(scores: DataFrame, by: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Shift with the highest NCC per group (smallest shift order on ties; scores to 9 places)."""
    key = F.struct(F.round("ncc", 9), -F.col("dy"), -F.col("dx"))
    return scores.groupBy(*by).agg(F.max_by(F.struct("dy", "dx", "ncc"), key).alias("_b")).select(*by, "_b.*")


def shift_matrix(shifts: DataFrame) -> DataFrame:
    """The transform that undoes a shift found by :func:`best_shift`."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return shifts.withColumns({
        "a": one, "b": zero, "tx": -F.col("dx").cast("double"),
        "c": zero, "d": one, "ty": -F.col("dy").cast("double")})


def pick_candidate(candidates: DataFrame, by: Sequence[str] = ("tile_id",)) -> DataFrame:
    """One candidate per group under the staged rule (candidates: by, stage 1..3, transform columns, ncc).

    Stage 1: best above 0. Stage 2 counts only while the best is below its gate, stage 3 likewise,
    and each only if it is better. No winner: ncc 0, stage NULL.
    """
    carried = [c for c in candidates.columns if c not in (*by, "stage", "ncc")]
    body = F.struct("stage", *carried)
    def top(stage: int) -> tuple[Column, Column]:
        mine = F.when(F.col("stage") == stage, F.col("ncc"))
        return F.max(mine).alias(f"n{stage}"), F.max_by(body, mine).alias(f"s{stage}")
    g = candidates.groupBy(*by).agg(*top(1), *top(2), *top(3))
    zero = F.lit(0.0)
    g = g.withColumn("b1", F.greatest(F.coalesce("n1", zero), zero))
    use2 = (F.col("b1") < NCC_STAGE_2) & (F.coalesce("n2", zero) > F.col("b1"))
    g = g.withColumn("b2", F.when(use2, F.col("n2")).otherwise(F.col("b1"))).withColumn(
        "c2", F.when(use2, F.col("s2")).when(F.col("n1") > 0, F.col("s1")))
    use3 = (F.col("b2") < NCC_STAGE_3) & (F.coalesce("n3", zero) > F.col("b2"))
    return g.select(
        *by, F.when(use3, F.col("s3")).otherwise(F.col("c2")).alias("_c"),
        F.when(use3, F.col("n3")).otherwise(F.col("b2")).alias("ncc")).select(*by, "_c.*", "ncc")


def cascade(
    groups: DataFrame, stages: Sequence[Callable[[DataFrame], DataFrame]], by: Sequence[str] = ("tile_id",)
) -> DataFrame:
    """Run up to three methods, each only on the groups still below its gate.

    A stage takes the group keys to work on and returns by, transform columns, ncc.
    """
    gates = (None, NCC_STAGE_2, NCC_STAGE_3)
    best = None
    todo = groups.select(*by).distinct()
    for number, (stage, gate) in enumerate(zip(stages, gates), start=1):
        if gate is not None:
            todo = best.where(F.col("ncc") < gate).select(*by)
        found, _ = store(stage(todo).withColumn("stage", F.lit(number)), "stage")
        if best is None:
            best = groups.select(*by).distinct().join(pick_candidate(found, by), list(by), "left")
            best, _ = store(best.withColumn("ncc", F.coalesce("ncc", F.lit(0.0))), "best")
            continue
        new = found.groupBy(*by).agg(F.max_by(F.struct(*[c for c in best.columns if c not in by]), "ncc").alias("_new"))
        better = F.coalesce(F.col("_new.ncc"), F.lit(-1.0)) > F.col("ncc")
        keep = [F.when(better, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in best.columns if c not in by]
        best, _ = store(best.join(new, list(by), "left").select(*by, *keep), "best")
    return best


def carry_forward(
    transforms: DataFrame, image: Sequence[str] = ("file",), columns: Sequence[str] = MATRIX, below: float = NCC_REUSE
) -> DataFrame:
    """Tiles scoring below the limit take the last good tile's transform, in tile order.

    Before the first good tile the columns stay NULL, which means "leave the tile as it is". An
    image has (tiles per side) squared rows here, a parameter and not a data size.
    """
    good = F.when(F.col("ncc") >= below, F.struct(*columns))
    order = Window.partitionBy(*image).orderBy("tile_id").rowsBetween(Window.unboundedPreceding, 0)
    filled = transforms.withColumn("_t", F.last(good, ignorenulls=True).over(order))
    return filled.withColumns({c: F.col(f"_t.{c}") for c in columns}).drop("_t")


def _inverse_at(x: Column, y: Column) -> tuple[Column, Column]:
    """Source position (x, y) that the transform sends to the given target; no transform is identity."""
    a, b, tx, c, d, ty = (F.coalesce(F.col(m), F.lit(v)) for m, v in zip(MATRIX, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)))
    det = a * d - b * c
    u, v = x - tx, y - ty
    return (d * u - b * v) / det, (a * v - c * u) / det


def _source_window(y0: Column, x0: Column, y1: Column, x1: Column) -> dict[str, Column]:
    """The rows and columns of the source that the targets [y0, y1) x [x0, x1) take samples from: between those of the four corners."""
    at = [_inverse_at(x, y) for y in (y0, y1 - 1) for x in (x0, x1 - 1)]
    low = lambda i: F.floor(F.round(F.least(*[p[i] for p in at]), 6)) - 1
    high = lambda i: F.floor(F.round(F.greatest(*[p[i] for p in at]), 6)) + 3
    return {"sy0": low(1), "sy1": high(1), "sx0": low(0), "sx1": high(0)}


def spline_basis(at: np.ndarray, side: int, mesh: int) -> np.ndarray:
    """Weights of the mesh + 3 cubic splines of an axis of ``side`` pixels at the given places (rows)."""
    t = np.clip(at, 0, max(side - 1, 0)) * (mesh / max(side - 1, 1))
    cell = np.minimum(np.floor(t).astype(np.int64), mesh - 1)
    u = t - cell
    out = np.zeros((len(t), mesh + 3))
    for k, w in enumerate(((1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3)):
        out[np.arange(len(t)), cell + k] = w / 6
    return out


def bend_at(weights: np.ndarray, y: np.ndarray, x: np.ndarray, ny: int, nx: int) -> np.ndarray:
    """A bend's part along one axis, on the grid of the rows ``y`` and columns ``x`` of a tile of ny x nx pixels."""
    n = round(len(weights) ** 0.5)
    return spline_basis(y, ny, n - 3) @ np.asarray(weights, float).reshape(n, n) @ spline_basis(x, nx, n - 3).T


def _warp_part(j: pd.Series, a: np.ndarray, off_y: int, off_x: int, bounds: tuple[int, int, int, int]) -> np.ndarray:
    """Bilinear samples for the targets of a job; a corner outside ``bounds`` (rows, columns of the source) counts as 0.

    Offsets are added to a target's place to get its place in the coordinates of the transform; the source is in those of the image.
    """
    m = [v if (v := j[c]) is not None and v == v else d for c, d in zip(MATRIX, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))]
    y, x = np.meshgrid(np.arange(int(j["ty0"]), int(j["ty1"]), dtype=float), np.arange(int(j["tx0"]), int(j["tx1"]), dtype=float), indexing="ij")
    y, x = y + off_y, x + off_x
    if j.get("bend_y") is not None:  # where the target is after the bend
        ny, nx = bounds[1] - bounds[0], bounds[3] - bounds[2]
        by, bx = (bend_at(j[c], y[:, 0], x[0], ny, nx) for c in ("bend_y", "bend_x"))
        y, x = y + by, x + bx
    u, v = x - m[2], y - m[5]
    det = m[0] * m[4] - m[1] * m[3]
    # whole-pixel shifts are to hit pixels exactly
    fy, fx = np.round((m[0] * v - m[3] * u) / det + bounds[0], 9), np.round((m[4] * u - m[1] * v) / det + bounds[2], 9)
    iy, ix = np.floor(fy).astype(np.int64), np.floor(fx).astype(np.int64)
    wy, wx = fy - iy, fx - ix
    out = np.zeros(y.shape)
    for dy, dx, weight in ((0, 0, (1 - wy) * (1 - wx)), (0, 1, (1 - wy) * wx), (1, 0, wy * (1 - wx)), (1, 1, wy * wx)):
        r, c = iy + dy, ix + dx
        ok = (r >= bounds[0]) & (r < bounds[1]) & (c >= bounds[2]) & (c < bounds[3]) & (weight > 0)
        r, c = r - int(j["sy0"]), c - int(j["sx0"])
        out[ok] += weight[ok] * a[r[ok], c[ok]]
    return out


def _grid_rows(j: pd.Series, values: np.ndarray) -> pd.DataFrame:
    yy, xx = np.indices(values.shape)
    return pd.DataFrame({"y": (yy + int(j["ty0"])).ravel(), "x": (xx + int(j["tx0"])).ravel(), "v": values.ravel()})


def _cut(lo: Column, hi: Column, block: int) -> Column:
    """[lo, hi) in stretches of at most ``block``: structs lo, hi."""
    starts = F.when(hi > lo, F.sequence(lo, hi - 1, F.lit(block).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("lo"), F.least(s + block, hi).alias("hi")))


def warp(
    px: DataFrame, transforms: DataFrame, size: DataFrame, by: Sequence[str] = PLANE,
    image: Sequence[str] = ("file",), value: str = "v", block: int = BLOCK,
) -> DataFrame:
    """Whole-image affine warp, bilinear, 0 outside. ``px`` is dense; planes with gaps are refused.

    A plane is warped block by block: each block's window of the source follows from the transform and is sent to its task once.
    """
    by = list(by)
    geo = size.select(*image, "h", "w").join(transforms.select(*image, *MATRIX), list(image), "left")
    zero = F.lit(0).cast("long")
    parts = geo.withColumn("_r", F.explode(_cut(zero, F.col("h").cast("long"), block))).withColumn("_c", F.explode(_cut(zero, F.col("w").cast("long"), block))).select(
        *image, *MATRIX, "h", "w", F.col("_r.lo").alias("ty0"), F.col("_r.hi").alias("ty1"), F.col("_c.lo").alias("tx0"), F.col("_c.hi").alias("tx1"))
    sides_of, _ = store(plane_size(px, by), "planes")
    planes = sides_of.select(*by)
    parts = parts.withColumns(_source_window(F.col("ty0"), F.col("tx0"), F.col("ty1"), F.col("tx1")))
    for lo, hi, side in (("sy0", "sy1", "h"), ("sx0", "sx1", "w")):
        parts = parts.withColumns({lo: F.greatest(F.col(lo), zero), hi: F.least(F.col(hi), F.col(side).cast("long"))})
    jobs, _ = store(planes.join(parts, list(image)).withColumn("job", F.struct("ty0", "tx0")), "jobs")
    run = lambda j, a: _grid_rows(j, _warp_part(j, a, 0, 0, (0, int(j["h"]), 0, int(j["w"]))))
    return routed(jobs, px, by, run, "y long, x long, v double", block, sides_of, value).select(*by, "y", "x", F.col("v").alias(value))


def align_stack(
    px: DataFrame, windows: DataFrame, transforms: DataFrame, by: Sequence[str] = PLANE,
    image: Sequence[str] = ("file",), n: int = 10, value: str = "v", block: int = BLOCK,
) -> DataFrame:
    """Warp every channel of a file with its tile transforms and stitch the tile cores.

    Only core positions are computed. A tile owns the rows and columns of its core that no later tile's core covers; what no tile owns is 0. The owned
    rectangles are cut into blocks, and each block's window of the source, inside its tile's own window, is sent to its task once.
    Planes with gaps are refused. Transforms may have a bend each (bend_y, bend_x, of :func:`elastic.bend`): a target's place is bent and then taken back
    by the matrix.
    """
    by, image = list(by), list(image)
    windows, _ = store(windows.select(*image, "tile_id", "h", "w", "cx", "cy", "half", "y0", "y1", "x0", "x1", "ymin", "xmin"), "windows")
    bends = [c for c in ("bend_y", "bend_x") if c in transforms.columns]
    geo = windows.select(*image, "tile_id", "cx", "cy", "half", "y0", "y1", "x0", "x1", "ymin", "xmin").join(
        transforms.select(*image, "tile_id", *MATRIX, *bends), [*image, "tile_id"], "left")
    sides = windows.select(*image, F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w")).distinct()
    half = half_side(n)

    def owned(side: str) -> Column:
        """Stretches of an axis: structs k (number of the tile along it, null for none), lo, hi."""
        twice = 2 * half.cast("long")
        first = lambda k: ((2 * k + 1) / F.lit(2 * n) * F.col("h") - half.cast("long")).cast("long")
        low = lambda k: F.least(F.greatest(first(k), F.lit(0).cast("long")), F.col(side))
        high = lambda k: F.greatest(F.least(first(k) + twice, F.when(k < n - 1, first(k + 1)).otherwise(F.col(side)), F.col(side)), low(k))
        piece = lambda k, lo, hi: F.struct(k.cast("int").alias("k"), lo.alias("lo"), hi.alias("hi"))
        none = F.lit(None)
        tile = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.array(
            piece(k, low(k), high(k)), piece(none, high(k), F.when(k < n - 1, low(k + 1)).otherwise(F.col(side)))))
        return F.concat(F.array(piece(none, F.lit(0).cast("long"), low(F.lit(0)))), F.flatten(tile))

    def split(df: DataFrame, side: str, t: str) -> DataFrame:
        cut = df.withColumn("_s", F.explode(owned(side))).withColumn("_p", F.explode(_cut(F.col("_s.lo"), F.col("_s.hi"), block)))
        return cut.withColumns({f"k_{t}": F.col("_s.k"), f"{t}0": F.col("_p.lo"), f"{t}1": F.col("_p.hi")}).drop("_s", "_p")

    cells = split(split(sides, "h", "ty"), "w", "tx").withColumn("tile_id", F.col("k_tx") * n + F.col("k_ty")).drop("k_tx", "k_ty")
    parts = cells.join(geo.withColumn("tile_id", F.col("tile_id").cast("int")), [*image, "tile_id"], "left")
    # a bend goes no farther than its largest weight
    far = F.coalesce(F.ceil(F.greatest(*[F.array_max(F.transform(c, F.abs)) for c in bends])), F.lit(0)) if bends else F.lit(0)
    to_tile = lambda t, c, trim, sign: F.col(t) - core_offset(c) + F.col(trim) + sign * far
    window = _source_window(to_tile("ty0", "cy", "ymin", -1), to_tile("tx0", "cx", "xmin", -1), to_tile("ty1", "cy", "ymin", 1), to_tile("tx1", "cx", "xmin", 1))
    parts = parts.withColumns({"off_y": F.col("ymin") - core_offset("cy"), "off_x": F.col("xmin") - core_offset("cx"), **window})
    inside = lambda c, o, lo, hi: F.coalesce(F.least(F.greatest(F.col(c) + F.col(o), F.col(lo)), F.col(hi)), F.lit(0).cast("long"))
    parts = parts.withColumns({c: inside(c, o, o, hi) for c, o, hi in (("sy0", "y0", "y1"), ("sy1", "y0", "y1"), ("sx0", "x0", "x1"), ("sx1", "x0", "x1"))})
    sides_of, _ = store(plane_size(px, by), "planes")
    planes = sides_of.select(*by)
    jobs, _ = store(planes.join(parts, image).withColumn("job", F.struct("ty0", "tx0")), "jobs")

    def run(j: pd.Series, a: np.ndarray) -> pd.DataFrame:
        if j["tile_id"] is None or j["tile_id"] != j["tile_id"]:
            return _grid_rows(j, np.zeros((int(j["ty1"] - j["ty0"]), int(j["tx1"] - j["tx0"])), np.int64))
        got = _warp_part(j, a, int(j["off_y"]), int(j["off_x"]), tuple(int(j[c]) for c in ("y0", "y1", "x0", "x1")))
        return _grid_rows(j, np.rint(np.round(got, 9)).astype(np.int64))

    return routed(jobs, px, by, run, "y long, x long, v long", block, sides_of, value).select(*by, "y", "x", F.col("v").alias(value))


def describe_matrix(transforms: DataFrame) -> DataFrame:
    """Adds translation, rotation and scale as one readable text."""
    a, b, tx, c, d, ty = (F.col(m) for m in MATRIX)
    turn = F.degrees(F.atan2(c, a))
    text = F.format_string(MATRIX_FORMAT, tx, ty, turn, F.sqrt(a * a + c * c), F.sqrt(b * b + d * d))
    return transforms.withColumn("text", text)
