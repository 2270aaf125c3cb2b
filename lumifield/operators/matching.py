"""The two nearest vectors of each query vector, exactly, without comparing all with all."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumifield.functions.lookup import attach
from lumifield.functions.storage import store, store_observed

PIVOTS = 256
RINGS = 64
SLACK = 1e-9  # share by which a bound may be off through rounding
SLICE = 1 << 20  # numbers held at once while bounds or pairs are looked at


def two_nearest(
    queries: DataFrame, candidates: DataFrame, by: Sequence[str] = ("tile_id",), chunk: int = 2000, pivots: int = PIVOTS,
) -> DataFrame:
    """Exact nearest and second nearest candidate vector of each query vector inside its group.

    queries: by, q_id (one row each), q_vec; candidates: by, c_id, c_vec. Result: by, q_id, c_id, dist, rank; equal
    distances by c_id. Rows without a vector take no part; a group with one candidate gives one row.

    Of equal candidate vectors the two least c_id are kept, as no third can be among the nearest two. Each of a group's up
    to ``pivots`` pivots (a fixed draw) holds the candidates that are nearest to it, in rings of about ``chunk``
    rows by distance to the pivot. By the triangle inequality a candidate in a ring [lo, hi] is no nearer to the query than
    lo - d and d - hi, with d the query's distance to the pivot. A query first asks the ring with the least such bound,
    which gives a second-nearest distance; after that it asks just those rings whose bound is not above it. That is
    the proof for all others, so nothing is cut off. A ring with more than ``chunk`` rows or queries is split over tasks
    by hash; a task holds a chunk of both sides and returns two rows a query. A group of at most ``chunk`` candidates is one ring.
    """
    by = list(by)
    same = Window.partitionBy(*by, "c_vec").orderBy("c_id")
    c = candidates.where(F.col("c_vec").isNotNull()).select(*by, "c_id", "c_vec").withColumn(
        "_copy", F.row_number().over(same)).where(F.col("_copy") <= 2)
    c, _ = store(c, "candidates")
    q = queries.where(F.col("q_vec").isNotNull()).select(*by, "q_id", "q_vec")
    sizes, seen = store_observed(
        c.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("_parts")), "sizes", most=F.max("_parts"))
    whole = [F.lit(0).alias(k) for k in ("pivot", "ring", "part")]
    if (seen["most"] or 0) <= 1:
        asked, _ = store(q.select(*by, "q_id", "q_vec", *whole), "asked")
        return _two_best(_ask(asked, c.select(*by, "c_id", "c_vec", *whole), by, chunk), by)

    held, guide = _rings(c, (sizes, seen["n"]), by, chunk, pivots)
    first, _ = store(_choose(q, guide, by, chunk), "asked")
    found, _ = store(_two_best(_ask(first, held, by, chunk), by).drop("rank"), "found")
    reach = found.groupBy(*by, "q_id").agg(
        F.when(F.count(F.lit(1)) == 2, F.max("dist")).otherwise(F.lit(float("inf"))).alias("reach"))
    rest, _ = store(_choose(q.join(reach, [*by, "q_id"]), guide, by, chunk), "asked")
    return _two_best(found.unionByName(_ask(rest, held, by, chunk)), by)


def _two_best(found: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by, "q_id").orderBy("dist", "c_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2)


def _part(key: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(key), n).cast("int")


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of ``a`` to the few rows of ``b``, by differences: right to the last digits also for near vectors."""
    return np.stack([np.sqrt(((a - p) ** 2).sum(1)) for p in b], axis=1)


def _empty(schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema.fields})


def _rings(
    c: DataFrame, sizes: tuple[DataFrame, int], by: list[str], chunk: int, pivots: int
) -> tuple[DataFrame, DataFrame]:
    """Candidates with pivot, ring and part; and per pivot its vector and rings (ring, lo, hi, n, parts)."""
    draw = Window.partitionBy(*by).orderBy(F.xxhash64("c_id"), "c_id")
    drawn = c.where(F.col("_copy") == 1).withColumn("pivot", F.row_number().over(draw)).where(F.col("pivot") <= pivots)
    drawn = drawn.join(sizes[0], by).where(F.col("pivot") <= F.col("_parts"))
    drawn, _ = store(drawn.select(*by, "pivot", F.col("c_vec").alias("p_vec"), "_parts"), "pivots")
    rows = attach(c, sizes, by, spread_by=("c_id",)).select(*by, "c_id", "c_vec", _part("c_id", F.col("_parts")).alias("_part"))
    copies = drawn.select(*by, "pivot", "p_vec", _every(F.col("_parts")).alias("_part"))
    schema = T.StructType([*[c.schema[k] for k in [*by, "c_id", "c_vec"]],
                           T.StructField("pivot", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def nearest_pivot(cs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        if cs.empty:
            return _empty(schema)
        ps = ps.sort_values("pivot")
        d = _distances(_matrix(cs["c_vec"]), _matrix(ps["p_vec"]))
        at = d.argmin(1)
        return cs[[*by, "c_id", "c_vec"]].assign(pivot=ps["pivot"].to_numpy()[at], far=d[np.arange(len(at)), at])

    keys = [*by, "_part"]
    near, _ = store(rows.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(nearest_pivot, schema), "near_pivots")
    home = [*by, "pivot"]
    edges = near.groupBy(*home).agg(
        F.least(F.lit(RINGS), F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int")).alias("_n"),
        F.percentile_approx("far", [i / RINGS for i in range(1, RINGS)], 1000).alias("_edges"))
    inner = F.expr(f"transform(filter(sequence(0, _n), i -> i > 0 AND i < _n), i -> _edges[int(i * {RINGS} / _n) - 1])")
    placed = attach(near, edges.select(*home, inner.alias("_cuts")), home, spread_by=("c_id",), max_rows=20_000).select(
        *home, "c_id", "c_vec", "far", F.expr("size(filter(_cuts, e -> e < far))").alias("ring"))
    placed, _ = store(placed, "placed")
    ring = placed.groupBy(*home, "ring").agg(
        F.min("far").alias("lo"), F.max("far").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("parts"))
    ring, n_rings = store(ring, "rings")
    held = attach(placed, (ring.select(*home, "ring", "parts"), n_rings), [*home, "ring"], spread_by=("c_id",)).select(
        *home, "ring", _part("c_id", F.col("parts")).alias("part"), "c_id", "c_vec")
    guide = ring.groupBy(*home).agg(F.sort_array(F.collect_list(F.struct("ring", "lo", "hi", "n", "parts"))).alias("rings"))
    guide, _ = store(drawn.join(guide, home).select(*home, "p_vec", "rings"), "guide")
    return held, guide


def _choose(q: DataFrame, guide: DataFrame, by: list[str], chunk: int) -> DataFrame:
    """The ring parts that each query asks: at first the likeliest ring (with a second candidate), given ``reach`` all others that may win."""
    later = "reach" in q.columns
    parts = q.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("_parts"))
    sizes = store(parts, "query_parts")
    rows = attach(q, sizes, by, spread_by=("q_id",)).withColumn("_part", _part("q_id", F.col("_parts"))).drop("_parts")
    copies = guide.join(sizes[0], by).select(*by, "pivot", "p_vec", "rings", _every(F.col("_parts")).alias("_part"))
    schema = T.StructType([*[q.schema[k] for k in [*by, "q_id", "q_vec"]],
                           *[T.StructField(k, T.IntegerType()) for k in ("pivot", "ring", "parts")]])

    def choose(qs: pd.DataFrame, gs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or gs.empty:
            return _empty(schema)
        gs = gs.sort_values("pivot").reset_index(drop=True)
        rings = pd.DataFrame([dict(at=i, pivot=p, **_ring(r)) for i, (p, rs) in enumerate(zip(gs["pivot"], gs["rings"])) for r in rs])
        away = _distances(_matrix(qs["q_vec"]), _matrix(gs["p_vec"]))
        reach = qs["reach"].to_numpy()[:, None] if later else None
        rows, asked = [], []
        for at in _slices(len(qs), len(rings)):
            d = away[at][:, rings["at"].to_numpy()]
            bound = np.maximum(0, np.maximum(rings["lo"].to_numpy() - d, d - rings["hi"].to_numpy()))
            order = np.lexsort((d, bound), axis=1)
            held = rings["n"].to_numpy()[order]
            before = np.cumsum(held, axis=1) - held
            start = np.zeros(bound.shape, bool)
            np.put_along_axis(start, order, before < 2, axis=1)
            chosen = ~start & (bound * (1 - SLACK) <= reach[at] * (1 + SLACK)) if later else start
            i, j = np.nonzero(chosen)
            rows.append(i + at.start)
            asked.append(j)
        i, j = np.concatenate(rows), np.concatenate(asked)
        out = qs[[*by, "q_id", "q_vec"]].iloc[i].reset_index(drop=True)
        return out.assign(**{k: rings[k].to_numpy()[j] for k in ("pivot", "ring", "parts")})

    keys = [*by, "_part"]
    chosen = rows.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(choose, schema)
    return chosen.select(*by, "q_id", "q_vec", "pivot", "ring", _every(F.col("parts")).alias("part"))


def _ring(r) -> dict:
    return r if isinstance(r, dict) else r.asDict()


def _slices(n: int, width: int) -> Iterator[slice]:
    step = max(1, SLICE // max(width, 1))
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))


def _ask(asked: DataFrame, held: DataFrame, by: list[str], chunk: int) -> DataFrame:
    """The two best candidates of every asked part, per query: by, q_id, c_id, dist."""
    part = [*by, "pivot", "ring", "part"]
    counts = store(asked.groupBy(*part).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("_nq")), "asked_parts")
    qs = attach(asked, counts, part, spread_by=("q_id",)).withColumn("_q", _part("q_id", F.col("_nq"))).drop("_nq")
    cs = attach(held, counts, part, spread_by=("c_id",)).withColumn("_q", _every(F.col("_nq"))).drop("_nq")
    schema = T.StructType([*[asked.schema[k] for k in [*by, "q_id"]], held.schema["c_id"], T.StructField("dist", T.DoubleType())])

    def nearest(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or cs.empty:
            return _empty(schema)
        cs = cs.sort_values("c_id")
        a, b = _matrix(qs["q_vec"]), _matrix(cs["c_vec"])
        aa, bb, k = (a * a).sum(1), (b * b).sum(1), min(2, len(cs))
        rows, cols, dist = [], [], []
        for at in _slices(len(a), len(b)):
            sq = aa[at, None] + bb[None, :] - 2 * a[at] @ b.T
            # all that rounding leaves open is measured again by differences
            level = np.partition(sq, k - 1, axis=1)[:, k - 1] + 1e-11 * (aa[at] + bb.max())
            i, j = np.nonzero(sq <= level[:, None])
            i += at.start
            d = np.concatenate([np.sqrt(((a[i[s]] - b[j[s]]) ** 2).sum(1)) for s in _slices(len(i), a.shape[1])])
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            rows.append(i[top]), cols.append(j[top]), dist.append(d[top])
        out = qs[[*by, "q_id"]].iloc[np.concatenate(rows)].reset_index(drop=True)
        return out.assign(c_id=cs["c_id"].to_numpy()[np.concatenate(cols)], dist=np.concatenate(dist))

    keys = [*part, "_q"]
    return qs.groupBy(*keys).cogroup(cs.groupBy(*keys)).applyInPandas(nearest, schema)
