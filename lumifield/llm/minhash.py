"""Near-duplicate documents: one-permutation MinHash with optimal densification, bands, star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifield.functions.storage import store
from lumifield.llm.graph import components
from lumifield.llm.words import Words, batch, mix, running, signed, small_batches, stretch, words

BLOCK = 1 << 15  # shingles of a block of items that are compared at once
TILE = 1 << 12  # shingles of the part of a block that is compared in one product: some 100 MB of grids at most


def _sets(w: Words, size: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; a shorter text is one shingle as a whole."""
    at, h = w.windows(size)
    n = np.diff(w.upto)
    upto = np.r_[0, np.cumsum(np.maximum(n - size + 1, 0))]
    sums = running(w.hash)
    out = []
    for i, m in enumerate(n):
        if m >= size:
            out.append(np.unique(h[upto[i] : upto[i + 1]]))
        else:
            out.append(stretch(sums, w.upto[i : i + 1], w.upto[i + 1 : i + 2])[: int(m > 0)])
    return out


_orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _probes(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin an own random order of all bins, and the place of each bin in it."""
    if bins not in _orders:
        order = np.argsort(np.random.Generator(np.random.PCG64(bins)).random((bins, bins)), axis=1)
        _orders[bins] = order, np.argsort(order, axis=1)
    return _orders[bins]


def one_permutation(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Least hash in each of ``bins`` equal ranges of the hash space, from sorted distinct hashes.

    An empty bin takes the value of the first filled bin in its own random order of bins (optimal
    densification), so equal bins of two sets agree as often as the sets are similar.
    """
    where = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    filled = where[first]
    out = np.zeros(bins, np.uint64)
    out[filled] = hashes[first]
    has = np.zeros(bins, bool)
    has[filled] = True
    empty = np.flatnonzero(~has)
    order, place = _probes(bins)
    if len(filled) <= 16:
        out[empty] = out[filled[np.argmin(place[np.ix_(empty, filled)], axis=1)]] if len(empty) else 0
        return out
    step = 0
    while len(empty):
        asked = order[empty, step]
        ok = has[asked]
        out[empty[ok]] = out[asked[ok]]
        empty, step = empty[~ok], step + 1
    return out


def _sketch(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    weight = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    number = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1000))
    for part in batches:
        for w in words(part.column("_text"), lower=True):
            sets = _sets(w, size)
            n = np.array([len(s) for s in sets])
            keys = [mix((one_permutation(s, bands * rows).reshape(bands, rows) * weight).sum(1) + number) for s in sets if len(s)]
            offsets = pa.array(np.r_[0, np.cumsum(np.where(n > 0, bands, 0))].astype(np.int32))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            mark = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s)) for s in sets], np.uint64)
            own = part.slice(w.first, w.last - w.first)
            yield batch(_id=own.column("_id"), _h=own.column("_h"), n_shingles=n.astype(np.int64), item=signed(mark),
                        keys=pa.ListArray.from_arrays(offsets, pa.array(signed(flat))))


def _full(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for w in words(part.column("_text"), lower=True):
            yield batch(item=part.column("item").slice(w.first, w.last - w.first),
                        members=pa.array([s.tobytes() for s in _sets(w, size)], pa.binary()))


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for part in batches:
        ok = []
        for a, b in zip(part.column("sa"), part.column("sb")):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            yes = 100 * min(len(x), len(y)) >= percent * max(len(x), len(y))
            if yes:
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                yes = 100 * common >= percent * (len(both) - common)
            ok.append(yes)
        yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _tiles(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of items with up to ``TILE`` shingles together; a larger item is a stretch of its own."""
    upto, out, lo = np.r_[0, np.cumsum(sizes)], [], 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + TILE, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def _similar(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``a``, in ``b``) of the sets that are similar; counted on a grid of the shingles that both sides have."""
    na, nb = (np.array([len(x) for x in s]) for s in (a, b))
    ha, hb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(ha, hb)
    grids = []
    for n, h in ((na, ha), (nb, hb)):
        at = np.minimum(np.searchsorted(both, h), max(len(both) - 1, 0))
        has = both[at] == h if len(both) else np.zeros(len(h), bool)
        g = np.zeros((len(n), len(both)), np.float32)
        g[np.repeat(np.arange(len(n)), n)[has], at[has]] = 1
        grids.append(g)
    common = np.rint(grids[0] @ grids[1].T).astype(np.int64)
    return np.nonzero(100 * common >= percent * (na[:, None] + nb[None, :] - common))


def _confirm_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between components found by comparing all sets of one block with all of another, a tile with a tile, one row for each two components."""
    for part in batches:
        for ca, ma, cb, mb in zip(*(part.column(c) for c in ("ca", "ma", "cb", "mb"))):
            (xa, sa), (xb, sb) = ((np.asarray(c.values), [np.frombuffer(v.as_buffer(), np.uint64) for v in m.values]) for c, m in ((ca, ma), (cb, mb)))
            found = [np.zeros((0, 2), np.int64)]
            for a, z in _tiles(np.array([len(s) for s in sa])):
                for c, y in _tiles(np.array([len(s) for s in sb])):
                    i, j = _similar(sa[a:z], sb[c:y], percent)
                    pairs = np.c_[xa[a:z][i], xb[c:y][j]]
                    found.append(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
            links = np.unique(np.concatenate(found), axis=0)
            yield batch(a=links[:, 0], b=links[:, 1])


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, bands: int = 36, rows: int = 6, one: bool = False) -> DataFrame:
    """Groups of documents linked by shingle sets with 100 * intersection >= ``percent`` * union.

    ``docs`` has doc_id and text. Returns one row per row: doc_id, text_hash (xxhash64 of doc_id and text), n_shingles, component_id (least doc_id
    reachable), kept (doc_id = component_id). A to Z count as a to z; a shingle is ``size`` words.

    Equal sets count as one item from the start. Items meet in banded buckets of their sketches; with
    the default numbers a pair at the limit meets in none with a chance of 4e-8. In each bucket the first item is the
    centre of a star, and the others are compared with it on the full sets. A bucket whose other items are then in one
    component is done. In the rest, items outside the centre's component are compared with all others, a block of
    items with a block at a time, and only links between components come out. So no link is lost to the choice of a
    centre, a bucket of copies makes one pair per copy, and no pair of single items is ever a row but those of the stars.

    Null or empty texts and those without words have n_shingles 0 and are linked with nothing; texts of any length are compared whole; a similarity at
    the limit is a link. Equal rows are one item. A null doc_id is linked by its text but never the name of a group with other ids; alone
    its component_id is null. No rows give no rows. Other columns are ignored.

    ``one`` adds the column stays: true for a row in no group, and in a group for the rows of one doc_id and text only, the
    least doc_id (null after all others), then the least text_hash.
    """
    kind = small_batches(docs).schema["doc_id"].dataType.simpleString()
    d = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_h"), F.col("text").alias("_text"))
    table, _ = store(d.mapInArrow(
        lambda it: _sketch(it, size, bands, rows), f"_id {kind}, _h long, n_shingles long, item long, keys array<long>"), "sketch")
    banded = table.where("n_shingles > 0").select("item", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    # counted sides are written before they are joined: both sides are then plain shuffles, and hot keys can be split
    shared, _ = store(banded.groupBy("key").agg(F.min("item").alias("x"), F.max("item").alias("y")).where("x <> y").select("key"), "shared")
    open_, _ = store(banded.join(shared, "key").select("key", "item", "n").distinct(), "buckets")

    named = table.where("n_shingles > 0").groupBy("item").agg(F.min(F.struct("_id", "_h")).alias("c"))  # before the join: copies are one row
    named = named.join(open_.select("item").distinct(), "item").select("item", F.col("c._id").alias("i"), F.col("c._h").alias("j"))
    texts = d.join(named, F.col("_h").eqNullSafe(F.col("j")) & F.col("_id").eqNullSafe(F.col("i"))).select("item", "_text")
    sets, _ = store(texts.dropDuplicates(["item"]).mapInArrow(lambda it: _full(it, size), "item long, members binary"), "sets")

    # stars: the first item of each bucket against the others
    first = open_.groupBy("key").agg(F.min("item").alias("a"))
    first, _ = store(first, "centres")
    pairs, _ = store(open_.join(first, "key").where("item <> a").select("a", F.col("item").alias("b")).distinct(), "pairs")
    with_a = pairs.join(sets.select(F.col("item").alias("a"), F.col("members").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("item").alias("b"), F.col("members").alias("sb")), "b").select("a", "b", "sa", "sb")
    links, n = store(with_b.mapInArrow(lambda it: _confirm(it, percent), "a long, b long"), "links")
    comps = components(links) if n else None

    # the rest: buckets whose other items are not all in one component
    if comps is not None:
        comps, _ = store(comps, "comps")
        rest = open_.join(first, "key").where("item <> a").join(comps, F.col("item") == comps["node"], "left").select(
            "key", "item", "n", F.coalesce("comp", "item").alias("comp"), "a")
        hub = comps.select(F.col("node").alias("a"), F.col("comp").alias("of"))
        rest = rest.join(hub, "a", "left").withColumn("main", F.col("comp") == F.coalesce("of", "a")).select("key", "item", "n", "comp", "main")
    else:
        rest = open_.join(first, "key").where("item <> a").select("key", "item", "n", F.col("item").alias("comp"), F.lit(False).alias("main"))
    rest, _ = store(rest, "rest")
    mixed = rest.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum("n").alias("all"))
    mixed, left = store(mixed.where("x <> y").select("key", F.ceil(F.col("all") / BLOCK).alias("blocks")), "mixed")
    if left:
        # a block is a share of a bucket of about BLOCK shingles; two blocks of the main component are linked as it is
        block = F.when(F.col("main"), F.lit(0)).otherwise(F.lit(1)) + 2 * F.pmod(F.xxhash64("item"), F.col("blocks"))
        dealt = rest.join(mixed, "key").select("key", block.alias("block"), "item", "comp")
        dealt = dealt.join(sets, "item").groupBy("key", "block").agg(F.collect_list(F.struct("item", "comp", "members")).alias("r"))
        dealt, _ = store(dealt.select("key", "block", F.col("r.comp").alias("c"), F.col("r.members").alias("m")), "blocks")
        near = dealt.select("key", F.col("block").alias("p"), F.col("c").alias("ca"), F.col("m").alias("ma"))
        far = dealt.select("key", F.col("block").alias("q"), F.col("c").alias("cb"), F.col("m").alias("mb"))
        met = near.join(far, "key").where("p <= q AND (p % 2 = 1 OR q % 2 = 1)").select("ca", "ma", "cb", "mb")
        more, n = store(met.mapInArrow(lambda it: _confirm_blocks(it, percent), "a long, b long").distinct(), "links")
        if n:
            comps = components(links.unionByName(more))

    if comps is None:
        group = table.withColumn("_g", F.col("item"))
    else:
        group = table.join(comps, table["item"] == comps["node"], "left").withColumn("_g", F.coalesce("comp", "item"))
    group = group.select("_id", "_h", "n_shingles", "_g")
    name = F.struct(F.col("_id").isNull().alias("o"), F.col("_id").alias("i"), F.col("_h").alias("j"))
    least, _ = store(group.where("n_shingles > 0").groupBy("_g").agg(F.min("_id").alias("_low"), F.min(name).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "least")
    out = group.join(least.withColumnRenamed("_g", "_k"), (F.col("_g") == F.col("_k")) & (F.col("n_shingles") > 0), "left")
    comp = F.when(F.col("_n") > 1, F.col("_low")).otherwise(F.col("_id"))
    stays = [F.coalesce(F.col("_first").eqNullSafe(name) | F.col("_first").isNull(), F.lit(True)).alias("stays")] if one else []
    return out.select(F.col("_id").alias("doc_id"), F.col("_h").alias("text_hash"), "n_shingles", comp.alias("component_id"), F.col("_id").eqNullSafe(comp).alias("kept"), *stays)
