"""Exact top-k inner products through an impact-ordered index, score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumifield.functions.storage import store
from lumifield.llm.words import batch

BLOCK = 32_768  # vectors of one index
ASKED = 128  # queries sent together
LEVELS = 12  # posting segments of a dimension
STEPS = 48  # classes of quantised impact


class ImpactIndex:
    """Postings of up to some ten thousand integer vectors: for each dimension, rows in segments of near values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS) -> None:
        self.ids, self.vectors = ids, vectors
        rows, self.dims = vectors.shape
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()  # (dims, rows)
        ranked = np.take_along_axis(vectors.T, self.order, axis=1)
        # segments of equal value range; empty ones are left out
        dim, start, end = [], [], []
        for d in range(self.dims):
            lo, hi = int(ranked[d, 0]), int(ranked[d, -1])
            edges = np.unique(np.array([lo + (hi - lo + 1) * i // levels for i in range(1, levels)], np.int64))
            cut = np.unique(np.r_[0, np.searchsorted(ranked[d], edges), rows])
            dim += [d] * (len(cut) - 1)
            start += cut[:-1].tolist()
            end += cut[1:].tolist()
        self.dim, self.start, self.end = (np.array(v, np.int64) for v in (dim, start, end))
        self.low, self.high = ranked[self.dim, self.start], ranked[self.dim, self.end - 1]
        self.least, self.most = ranked[:, 0], ranked[:, -1]
        for d, a, z in zip(self.dim, self.start, self.end):  # rows of a segment in order, which adds faster
            self.order[d, a:z].sort()

    def search(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows but those with the id ``own``; ties to the smaller id.

        Each score is a constant plus one impact >= 0 per dimension. Segments go by descending class of impact. An
        accumulator holds the impacts seen, rounded up to the segment's best, and their number; dimensions not seen
        yet add at most the impact that comes next. The work ends when few rows can still be
        members, as their bound reaches the k-th best exact score found so far; these are scored exactly.
        """
        exact = lambda rows: self.vectors[rows] @ query
        mine = self.ids == own
        k = min(k, len(self.ids) - int(mine.sum()))
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        used = np.flatnonzero(query)
        base = np.minimum(query * self.least, query * self.most)
        q = query[self.dim]
        impact = np.maximum(q * self.low, q * self.high) - base[self.dim]
        segments = np.flatnonzero(q != 0)
        top = max(1, int(impact[segments].max(initial=0)))
        step = STEPS * impact[segments] // top
        by = np.argsort(-step, kind="stable")
        segments, step = segments[by], step[by]
        # one number holds the sum of impacts and, above 2^48, how many dimensions were seen
        one = 1 << 48
        acc = np.zeros(len(self.ids), np.int64)
        few = max(4 * k, 64, len(self.ids) // 50)
        floor = int(base.sum())
        done, last = 0, len(segments)
        checks = set(range(STEPS // 2, 0, -3))
        rows = np.arange(len(self.ids))
        order, dim, begin, end, add = self.order, self.dim, self.start, self.end, impact + one
        members = rows
        while done < last:
            now = step[done]
            for s in segments[done : done + int(np.searchsorted(-step[done:], -now, "right"))]:
                np.add.at(acc, order[dim[s], begin[s] : end[s]], add[s])
                done += 1
            if done < last and int(now) not in checks:
                continue
            rest = 0 if done == last else top * (int(step[done]) + 1) // STEPS + 1
            bound = (acc & (one - 1)) + rest * (len(used) - (acc >> 48)) + floor
            bound[mine] = np.iinfo(np.int64).min
            best = np.argpartition(-bound, k - 1)[:k] if len(bound) > k else rows[~mine]
            best = best[~mine[best]]
            kth = np.sort(exact(best))[-k] if len(best) >= k else np.iinfo(np.int64).min
            members = np.flatnonzero((bound >= kth) & ~mine)
            if len(members) <= few:
                break
        if not last:
            members = rows[~mine]
        score = exact(members)
        best = np.lexsort((self.ids[members], -score))[:k]
        return members[best], score[best]


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (dim, id, vec) as blocks of up to ``size`` rows of one dimension."""
    held: dict[int, tuple[list, list]] = {}

    def block(dim: int) -> pa.RecordBatch:
        ids, vecs = held.pop(dim)
        return batch(dim=np.array([dim], np.int32), ids=pa.array([np.array(ids, np.int64)]),
                     vecs=pa.array([np.concatenate(vecs) if dim else np.zeros(0, np.int64)]))

    for part in batches:
        vec = part.column("vec")
        flat, off = np.asarray(vec.flatten()), np.asarray(vec.offsets) - vec.offsets[0].as_py()
        for i, (d, v) in enumerate(zip(part.column("dim").to_pylist(), part.column("id").to_pylist())):
            ids, vecs = held.setdefault(d, ([], []))
            ids.append(v)
            vecs.append(flat[off[i] : off[i + 1]])
            if len(ids) == size:
                yield block(d)
    for d in list(held):
        yield block(d)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    name, index = None, None
    for part in batches:
        for i in range(part.num_rows):
            of = lambda c: np.asarray(part.column(c)[i].values)
            dim, shard = part.column("dim")[i].as_py(), part.column("shard")[i].as_py()
            if name != (shard, dim):
                ids = of("ids")
                name, index = (shard, dim), ImpactIndex(ids, of("vecs").reshape(len(ids), dim))
            asked = of("q_ids")
            found = [index.search(q, k, int(own)) for own, q in zip(asked, of("q_vecs").reshape(len(asked), dim))]
            n = [len(f[0]) for f in found]
            yield batch(query_id=np.repeat(asked, n), vec_id=index.ids[np.concatenate([f[0] for f in found])],
                        score=np.concatenate([f[1] for f in found]))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """The ``k`` vectors of greatest inner product with each query, its own id left out.

    Both sides have id (long) and vec (array<long>). Returns query_id, rank (from 1), vec_id, score; ties go to the
    smaller id, fewer rows come back where there are fewer vectors. Only vectors of equal length are compared.

    Vectors are dealt into blocks of about ``block`` rows by a hash of their id, so that a block fits a task; each block is
    indexed once per task and every query is sent to every block, 128 at a time. A block returns k rows per query.

    Rows with a null id or vector take no part; components must be non-null. Rows with one id count as
    one another's own. Empty vectors score 0 among themselves. No queries or no vectors give no rows.
    """
    n = vectors.count()
    shards = max(1, -(-n // block))
    v = vectors.where("id IS NOT NULL AND vec IS NOT NULL").select(
        "id", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
    # equal ids fall into one block; a block is gathered in one row of bounded size
    blocks = v.groupBy("shard", "dim").agg(F.collect_list(F.struct("id", "vec")).alias("r")).select(
        "shard", "dim", F.col("r.id").alias("ids"), F.flatten("r.vec").alias("vecs"))
    q = queries.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec", F.size("vec").alias("dim"))
    q = q.mapInArrow(lambda it: _pack(it, ASKED), "dim int, ids array<long>, vecs array<long>").select(
        "dim", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    part = q.join(blocks, ["shard", "dim"]).select("shard", "dim", "ids", "vecs", "q_ids", "q_vecs").sortWithinPartitions("shard", "dim").mapInArrow(
        lambda it: _search(it, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def integers(rows: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, vec): components as floor(scale * x); rows with a null vector or a null or non-finite component are left out."""
    x = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.coalesce(sound, F.lit(False)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * float(scale)).cast("long")).alias("vec"))
