"""Ranked lexical search of a stated set of items: document impact tiles times item vocabulary tiles, in BLAS."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumifield.functions.storage import store, store_observed
from lumifield.llm.words import CHUNK, _runs, batch, column, hash_runs, small_batches

K = 10
PAIRS = 1 << 18  # different (item, term) pairs of a block of items, the most that the driver holds at once (some 20 MB)
ITEMS, COLUMNS, ROWS = 256, 4096, 512  # sides of the tiles: 8 MB of item weights, 16 MB of impacts
SPREAD = 256
IMPACT = 1_000_000  # every impact is below this
EXACT = 1 << 53

_APART = np.ones(256, bool)
_APART[128:] = False
_FOLD = np.arange(256, dtype=np.uint8)
for first, last in ("09", "AZ", "az"):
    _APART[ord(first) : ord(last) + 1] = False
_FOLD[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def _terms(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some texts at a time: the first one's place, their lower-cased bytes, start and end of each term, terms before each text.

    A term is a longest run of ASCII letters, digits and characters beyond ASCII; these are all bytes from 128 on,
    so that terms are found on bytes.
    """
    data, off = column(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1))
        low, ends = _FOLD[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        start, end = _runs(low, ends, _APART)
        yield i, low, start, end, np.searchsorted(start, ends)
        i = j
    pa.default_memory_pool().release_unused()


class Vocabulary:
    """Terms by number. Found by a 64-bit hash and then compared byte by byte, eight at a time."""

    def __init__(self, terms: list[str]) -> None:
        raw = [t.encode() for t in terms]
        self.size = np.array([len(t) for t in raw], np.int64)
        end = np.cumsum(self.size)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        h = hash_runs(flat, end - self.size, end)
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]
        self.same = int(np.unique(self.hashes, return_counts=True)[1].max(initial=0))  # terms of one hash: one, but for a chance meeting
        padded = [t + b"\0" * (-len(t) % 8) for t in raw]
        self.words = np.frombuffer(b"".join(padded), "<u8")
        self.first = np.cumsum([0, *[len(t) // 8 for t in padded]])

    def find(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of the term low[start:end] of each pair, -1 where it is none of these."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.hashes) or not len(start):
            return out
        h = hash_runs(low, start, end)
        at = np.searchsorted(self.hashes, h)
        padded = np.zeros(len(low) + 8, np.uint8)
        padded[: len(low)] = low
        eight = np.ndarray((len(low) + 1,), "<u8", padded, 0, (1,))
        for turn in range(self.same):
            place = np.minimum(at + turn, len(self.hashes) - 1)
            who = np.flatnonzero((self.hashes[place] == h) & (out < 0))
            term = self.order[place[who]]
            ok = self.size[term] == end[who] - start[who]
            who, term, step = who[ok], term[ok], 0
            good, left = np.ones(len(who), bool), np.arange(len(who))
            while len(left):
                rest = self.size[term[left]] - 8 * step
                got = eight[start[who[left]] + 8 * step] & _MASK[np.minimum(rest, 8)]
                good[left] &= got == self.words[self.first[term[left]] + step]
                left, step = left[rest > 8], step + 1
            out[who[good]] = term[good]
        return out


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for i, low, start, end, upto in _terms(part.column("_text")):
            raw = low.tobytes()
            for k, (a, b) in enumerate(zip(upto, upto[1:])):
                if a < b:
                    term, n = np.unique(np.array([raw[s:e] for s, e in zip(start[a:b], end[a:b])], object), return_counts=True)
                    own = part.column("item_id").slice(i + k, 1).take(pa.array(np.zeros(len(term), np.int64)))
                    yield batch(item_id=own, term=pa.array(list(term), pa.binary()).cast(pa.string()), n=n.astype(np.int64))


def _postings(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for i, low, start, end, upto in _terms(part.column("_text")):
            n = np.diff(upto)
            term = vocabulary.find(low, start, end)
            doc = np.repeat(np.arange(len(n)), n)[term >= 0]
            wide = np.int64(len(vocabulary.size) or 1)
            key, tf = np.unique(doc * wide + term[term >= 0], return_counts=True)
            cut = pa.array(np.searchsorted(key // wide, np.arange(len(n) + 1)).astype(np.int32))
            yield batch(doc_id=part.column("doc_id").slice(i, len(n)), n=n.astype(np.int64),
                        terms=pa.ListArray.from_arrays(cut, pa.array((key % wide).astype(np.int32))),
                        tfs=pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int64))))


class ItemTile:
    """Weights of up to ``ITEMS`` items over the terms they have, cut into tiles of columns whose sums of products stay below 2^53."""

    def __init__(self, first: int, item: np.ndarray, term: np.ndarray, weight: np.ndarray, columns: int) -> None:
        self.first, self.items = first, int(item.max(initial=first - 1)) - first + 1
        most = (EXACT - 1) // IMPACT
        piece, whole = [], weight
        while len(whole):  # a weight that alone is too large is given to several columns
            piece.append((item, term, np.minimum(whole, most)))
            more = whole > most
            item, term, whole = item[more], term[more], whole[more] - most
        self.parts = []  # for each part the terms with a column, in order, and their columns
        self.cells, self.tiles, used, room, start = [], [], 0, most, 0
        for item, term, weight in piece:
            terms, col = np.unique(term, return_inverse=True)
            top = np.zeros(len(terms), np.int64)
            np.maximum.at(top, col, weight)
            for c, t in enumerate(top.tolist(), used):  # a tile's largest weights together times the largest impact are below 2^53
                if c - start == columns or t > room:
                    self.tiles.append((start, c))
                    start, room = c, most
                room -= t
            self.parts.append((terms, used))
            self.cells.append((item - first, col + used, weight))
            used += len(terms)
        self.tiles.append((start, used))
        self.row, self.col, self.value = (np.concatenate(v) if piece else np.zeros(0, np.int64) for v in zip(*(self.cells or [((), (), ())])))

    def weights(self, start: int, end: int) -> np.ndarray:
        own = (self.col >= start) & (self.col < end)
        out = np.zeros((end - start, self.items))
        out[self.col[own] - start, self.row[own]] = self.value[own]
        return out

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int, weights) -> np.ndarray:
        """Scores of ``rows`` documents by item, exact: products of one tile are added in float64, tiles in 64-bit integers."""
        out = np.zeros((rows, self.items), np.int64)
        placed = []
        for terms, first in self.parts:
            at = np.minimum(np.searchsorted(terms, term), max(len(terms) - 1, 0))
            hit = np.flatnonzero(terms[at] == term) if len(terms) else np.zeros(0, np.int64)
            placed.append((doc[hit], at[hit] + first, impact[hit]))
        d, c, v = (np.concatenate(x) for x in zip(*placed)) if placed else (np.zeros(0, np.int64),) * 3
        for start, end in self.tiles:
            own = (c >= start) & (c < end)
            if own.any():
                grid = np.zeros((rows, end - start))
                grid[d[own], c[own] - start] = v[own]
                out += (grid @ weights(start, end)).astype(np.int64)
        return out


class Best:
    """The k best documents of each item so far; ties to the smaller id, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)  # the score that still counts
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def offer(self, first: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        least = self.least[first : first + scores.shape[1]]
        for i in np.flatnonzero(scores.max(axis=0, initial=0) >= least):
            rows = np.flatnonzero(scores[:, i] >= least[i])
            new = scores[rows, i], null[rows], ids[rows]
            score, away, name = (np.concatenate(v) for v in zip(new, self.held.get(first + i, tuple(x[:0] for x in new))))
            best = np.lexsort((name, away, -score))[: self.k]
            self.held[first + i] = score[best], away[best], name[best]
            if len(best) == self.k:
                self.least[first + i] = score[best[-1]]


def _search(batches: Iterator[pa.RecordBatch], tiles: list[ItemTile], names: pa.Array, docs: int, length: int, k: int) -> Iterator[pa.RecordBatch]:
    best = Best(len(names), k)
    weights = lru_cache(8)(lambda i, start, end: tiles[i].weights(start, end))
    for part in batches:
        names_of = part.column("doc_id").cast(pa.int64())
        null, ids = np.asarray(names_of.is_null()), np.asarray(names_of.fill_null(0))
        n, lists, tfs = np.asarray(part.column("n")), part.column("terms"), part.column("tfs")
        cut, term, tf = np.asarray(lists.offsets) - lists.offsets[0].as_py(), np.asarray(lists.flatten()).astype(np.int64), np.asarray(tfs.flatten())
        m = np.array([25 + 75 * x * docs // length for x in n.tolist()], np.int64) if length else n
        for a in range(0, len(n), ROWS):
            z = min(len(n), a + ROWS)
            lo, hi = cut[a], cut[z]
            doc = np.repeat(np.arange(z - a), np.diff(cut[a : z + 1]))
            impact = 1_000_000_000 * tf[lo:hi] // (1000 * tf[lo:hi] + 8 * m[a:z][doc])
            for i, tile in enumerate(tiles):
                best.offer(tile.first, tile.scores(doc, term[lo:hi], impact, z - a, lambda s, e: weights(i, s, e)), ids[a:z], null[a:z])
    task = TaskContext.get().partitionId() % SPREAD
    for i, (score, away, name) in best.held.items():
        yield batch(item_id=names.take(pa.array(np.full(len(score), i))), task=np.full(len(score), task, np.int32),
                    doc_id=pa.array(name, mask=away), score=score)


def _tiles(item: np.ndarray, term: np.ndarray, weight: np.ndarray, items: int, columns: int) -> list[ItemTile]:
    order = np.argsort(item, kind="stable")
    item, term, weight = item[order], term[order], weight[order]
    cut = np.searchsorted(item, np.arange(0, (item.max(initial=-1) // items + 1) * items + 1, items))
    return [ItemTile(t * items, item[a:z], term[a:z], weight[a:z], columns) for t, (a, z) in enumerate(zip(cut, cut[1:])) if a < z]


def search(docs: DataFrame, items: DataFrame, k: int = K, pairs: int = PAIRS, tile_items: int = ITEMS, tile_columns: int = COLUMNS) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank (from 1), doc_id, score; ties to the smaller doc_id, scores above 0 only.

    ``docs`` has doc_id (an integer) and text, ``items`` item_id and text. With N documents that have a term, L their terms and df the documents
    that hold a term, its weight w is floor(1000 ln((2N + 2) / (2df + 1))). A document of n terms, tf of them this one, has the impact
    (10^9 tf) div (1000 tf + 8m) with m = 25 + (75 n N) div L. The score sums w times impact over the terms of the item, repeats included.

    1. One pass counts in each document the terms that items have; N, L and df come from all documents. The counts are written.
    2. Each task multiplies tiles of 512 documents by tiles of up to 256 items over the terms that these have. Weights of a tile of columns are
       bounded so that no sum of products reaches 2^53: float64 is exact in any order of addition; tiles are added as 64-bit integers.
    3. A task keeps the k best of each item by (score, doc_id), so that ties are settled as in the whole. The tasks' rows are joined in two steps, by task
       and item, then by item.

    Items are taken in blocks of about ``pairs`` different (item, term) pairs, the only rows the driver gathers; a block is one pass over the documents.

    Null and empty texts have no term: such documents are never found and such items have no rows. Rows of one item_id are one item with all their
    terms, those of a null item_id too. Repeated document rows each count and are each found, in ties a null doc_id comes last. Texts of any length are read
    whole. Empty tables give no rows. Other columns are ignored.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    asked = small_batches(items).select("item_id", F.col("text").alias("_text")).mapInArrow(_item_terms, f"item_id {kind}, term string, n long")
    asked, size = store(asked.groupBy("item_id", "term").agg(F.sum("n").alias("n")), "items")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    blocks = max(1, -(-size // pairs))
    found = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        term_of, item_of = mine.column("term").dictionary_encode().combine_chunks(), mine.column("item_id").combine_chunks()
        names = item_of.unique()
        item = np.asarray(pc.index_in(item_of, names)).astype(np.int64)
        vocabulary = Vocabulary(term_of.dictionary.to_pylist())
        term, often = np.asarray(term_of.indices).astype(np.int64), np.asarray(mine.column("n"))
        counts, seen = store_observed(texts.mapInArrow(lambda it, v=vocabulary: _postings(it, v), "doc_id long, n long, terms array<int>, tfs array<long>"),
                                      "postings", docs=F.count_if(F.col("n") > 0), length=F.sum("n"))
        total, length = int(seen["docs"]), int(seen["length"] or 0)
        df = np.zeros(len(vocabulary.size), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
            df[r["t"]] = r["df"]
        w = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        weight = w[term] * often if len(term) else term
        tiles = _tiles(item[weight > 0], term[weight > 0], weight[weight > 0], tile_items, tile_columns)
        part = counts.where(F.size("terms") > 0).mapInArrow(
            lambda it, t=tiles, names=names, n=total, l=length: _search(it, t, names, n, l, k), f"item_id {kind}, task int, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    first = found.withColumn("place", place("item_id", "task")).where(F.col("place") <= k)
    return first.withColumn("rank", place("item_id")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
