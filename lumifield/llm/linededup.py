"""Line dedup by pairwise alignment: blocks of lines that an earlier document has are deleted from later ones."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifield.functions.storage import store
from lumifield.llm.words import _LINE, Words, _runs, batch, carried, restored, running, signed, small_batches, stretch, words

BLOCK_WORDS = 12  # words of a common block that is deleted


def _line_table(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end in bytes, text, hash of the words, and number of words of each line that has a word."""
    s, e = _runs(w.data, w.ends, _LINE)
    a, b = np.searchsorted(w.start, s), np.searchsorted(w.start, e)
    has = b > a
    s, e, a, b = s[has], e[has], a[has], b[has]
    return s, e, np.searchsorted(w.ends, s, "right") - 1, stretch(running(w.hash), a, b), b - a


def least_runs(upto: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of lines that just reach ``least`` words: the one starting with each line and the one ending with it.

    ``upto`` are words before each line, with the total at the end; ``ends`` of texts in lines, with a leading zero. No run crosses
    texts. Any block of ``least`` words is covered by such runs that lie in it: a line before the run that ends the block
    starts one.
    """
    at = np.arange(len(upto) - 1)
    text = np.searchsorted(ends, at, "right") - 1
    to = np.searchsorted(upto, upto[:-1] + least)  # lines before this one reach it
    since = np.searchsorted(upto, upto[1:] - least, "right") - 1
    fit, back = to <= ends[text + 1], (upto[1:] - least >= 0) & (since >= ends[text])
    return np.r_[at[fit], since[back]], np.r_[to[fit], at[back] + 1]


def _describe(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for w in words(part.column("_text")):
            _, _, text, h, n = _line_table(w)
            ends = np.searchsorted(text, np.arange(w.last - w.first + 1))
            s, e = least_runs(np.r_[0, np.cumsum(n)], ends, least)
            of, runs = np.searchsorted(ends, s, "right") - 1, stretch(running(h), s, e)
            order = np.lexsort((runs, of))
            of, runs = of[order], runs[order]
            new = np.r_[True, (of[1:] != of[:-1]) | (runs[1:] != runs[:-1])][: len(of)]  # each once in a text
            of, runs = of[new], runs[new]
            off = pa.array(ends.astype(np.int32))
            own = part.slice(w.first, w.last - w.first)
            yield batch(_id=own.column("_id"), _h=own.column("_h"), lines=pa.ListArray.from_arrays(off, pa.array(signed(h))),
                        sizes=pa.ListArray.from_arrays(off, pa.array(n.astype(np.int32))),
                        runs=pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(w.last - w.first + 1)).astype(np.int32)), pa.array(signed(runs))))


def _anchors(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Longest chain of lines that are unique on both sides, in order on both."""
    ca, cb = Counter(a), Counter(b)
    place = {v: i for i, v in enumerate(a) if ca[v] == 1}
    both = [(place[v], j) for j, v in enumerate(b) if cb[v] == 1 and v in place]
    piles: list[int] = []  # least end of a chain of each length
    heads: list[int] = []
    back = [-1] * len(both)
    for k, (i, _) in enumerate(both):
        at = bisect_left(piles, i)
        back[k] = heads[at - 1] if at else -1
        piles[at : at + 1] = [i]
        heads[at : at + 1] = [k]
    out, k = [], heads[-1] if heads else -1
    while k >= 0:
        out.append(both[k])
        k = back[k]
    return out[::-1]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Pairs of places of equal lines, rising on both sides, by patience diff.

    Equal ends are taken off, the lines unique on both sides are chained, and the stretches between
    them are treated alike; a stretch without such lines has no further pairs (see :func:`common_blocks`).
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        chain = _anchors(a[a0:a1], b[b0:b1])
        if chain:
            out += [(a0 + i, b0 + j) for i, j in chain]
            ends = [(-1, -1), *chain, (a1 - a0, b1 - b0)]
            todo += [(a0 + i + 1, a0 + k, b0 + j + 1, b0 + m) for (i, j), (k, m) in zip(ends, ends[1:]) if k > i + 1 and m > j + 1]
    return sorted(out)


def _least_slices(lines: Sequence[int], size: dict[int, int], least: int) -> dict[tuple[int, int], tuple[int, ...]]:
    """The runs of :func:`least_runs` in lines that have a size, by start and end: (start, end) to its lines."""
    out, upto, start, i, k = {}, [0], [], 0, 0
    for j, v in enumerate(lines):  # start: of the stretch of lines with a size
        n = size.get(v)
        start.append(j + 1 if n is None else start[-1] if start and start[-1] <= j else j)
        upto.append(upto[-1] + (n or 0))
    for j in range(len(lines)):
        if start[j] > j:
            continue
        while upto[i + 1] <= upto[j + 1] - least:  # the latest start of a run that ends with j
            i += 1
        if upto[j + 1] - upto[i] >= least and i >= start[j]:
            out[i, j + 1] = tuple(lines[i : j + 1])
        k = max(k, j)
        while k < len(lines) and start[k] <= j and upto[k + 1] - upto[j] < least:
            k += 1
        if k < len(lines) and start[k] <= j and (j, k + 1) not in out:
            out[j, k + 1] = tuple(lines[j : k + 1])
    return out


def left_over(earlier: Sequence[int], later: Sequence[int], sizes: Sequence[int], least: int) -> set[int]:
    """Places in ``later`` that lie in a block of at least ``least`` words that ``earlier`` has anywhere."""
    have = set(earlier)
    size = {v: n for v, n in zip(later, sizes) if v in have}
    known = set(_least_slices(earlier, size, least).values())
    return {k for (i, j), v in _least_slices(later, size, least).items() if v in known for k in range(i, j)} if known else set()


def common_blocks(earlier: Sequence[int], later: Sequence[int], sizes: Sequence[int], least: int) -> list[int]:
    """Places in ``later`` that lie in a block of at least ``least`` words that ``earlier`` has: in an aligned one, or, where
    the alignment has none (repeated lines, or blocks in another order), in one found by its runs of lines."""
    out, block, last = [], [], None
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if last is None or (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in block) >= least:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    done, have = set(out), set(earlier)
    if any(v in have for j, v in enumerate(later) if j not in done):
        done |= left_over(earlier, later, sizes, least)
    return sorted(done)


def _align(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for part in batches:
        gone = [common_blocks(a, b, n, least) for a, b, n in zip(*(part.column(c).to_pylist() for c in ("earlier", "lines", "sizes")))]
        yield batch(_id=part.column("_id"), _h=part.column("_h"), gone=pa.array(gone, pa.list_(pa.int32())))


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        gone = part.column("_gone").to_pylist()
        for w in words(part.column("_text")):
            s, e, text, _, _ = _line_table(w)
            upto = np.searchsorted(text, np.arange(w.last - w.first + 1))
            raw, out, lost = w.data.tobytes(), [], []
            for i in range(w.last - w.first):
                a, b = int(w.ends[i]), int(w.ends[i + 1])
                cut = sorted(set(gone[w.first + i] or ()))
                lost.append(len(cut))
                keep, at = [], a
                for k in cut:  # a line goes with its line end, the last one with the line end before it
                    k += upto[i]
                    keep.append(raw[at : s[k]])
                    at = min(b, int(e[k]) + 1)
                keep.append(raw[at:b])
                body = b"".join(keep)
                if cut and at >= b and body.endswith(b"\n") and raw[b - 1 : b] != b"\n":
                    body = body[:-1]
                out.append(body)
            own = part.slice(w.first, w.last - w.first).drop_columns(["_gone", "_text"])
            null = pa.compute.is_null(part.column("_text").slice(w.first, w.last - w.first))
            kept = pa.compute.if_else(null, pa.scalar(None, pa.string()), pa.array(out, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(np.diff(upto).astype(np.int64)), pa.array(lost, pa.int64()), kept],
                [*own.schema.names, "n_lines", "n_deleted", "kept_text"])


def dedup_lines(docs: DataFrame, block_words: int = BLOCK_WORDS, keep: Sequence[str] = ()) -> DataFrame:
    """Delete from each document the blocks of lines that an earlier document (of smaller doc_id) has.

    ``docs`` has doc_id and text. Returns one row per row: doc_id, text_hash (xxhash64 of doc_id and text, which names equal rows), n_lines (lines with a word), n_deleted, kept_text, and the columns ``keep``.

    1. Each line is known by the hash of its words. The runs of lines that just reach ``block_words`` words (see :func:`least_runs`)
       lead to the first document that has them, their owner, however many documents have them. These are all the pairs
       that count: any block that could be deleted is covered by such runs. A passage in very many documents gives
       one pair for each, not all pairs.
    2. Each pair is aligned by patience diff on line hashes; runs of lines that follow each other on both sides
       and have ``block_words`` words together are deleted from the later document. So are such runs that the alignment
       leaves over: where no line is unique on both sides, and those in another order.
    3. Deletions of all pairs are united and applied to the text. Blocks are judged on the input; the first
       document with a line never loses it, so of every deleted line one copy stays.

    Null or empty texts have no lines and stay; equal rows count as one document; a null doc_id comes first
    in order; very long lines are hashed whole. No rows give no rows. Other columns are ignored.
    """
    kind = small_batches(docs).schema["doc_id"].dataType.simpleString()
    more, types = carried(docs, keep)
    d = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_h"), F.col("text").alias("_text"), *more)
    lines, _ = store(d.select("_id", "_h", "_text").mapInArrow(lambda it: _describe(it, block_words),
                                                                f"_id {kind}, _h long, lines array<long>, sizes array<int>, runs array<long>"), "lines")
    run = lines.select("_id", "_h", F.explode("runs").alias("run"))
    start = run.groupBy("run").agg(F.min(F.struct("_id", "_h")).alias("o"), F.max(F.struct("_id", "_h")).alias("z")).where("o <> z")
    start, _ = store(start.select("run", F.col("o._id").alias("o_id"), F.col("o._h").alias("o_h")), "starts")
    other = ~(F.col("_id").eqNullSafe(F.col("o_id")) & (F.col("_h") == F.col("o_h")))
    pairs, _ = store(run.join(start, "run").where(other).select("_id", "_h", "o_id", "o_h").distinct(), "pairs")
    sides, _ = store(lines.dropDuplicates(["_id", "_h"]), "sides")
    o = sides.select(F.col("_id").alias("i"), F.col("_h").alias("j"), F.col("lines").alias("earlier"))
    both = pairs.join(o, F.col("o_id").eqNullSafe(F.col("i")) & (F.col("o_h") == F.col("j"))).select("_id", "_h", "earlier")
    mine = sides.select(F.col("_id").alias("i"), F.col("_h").alias("j"), "lines", "sizes")
    both = both.join(mine, F.col("_id").eqNullSafe(F.col("i")) & (F.col("_h") == F.col("j"))).select("_id", "_h", "earlier", "lines", "sizes")
    gone = both.mapInArrow(lambda it: _align(it, block_words), f"_id {kind}, _h long, gone array<int>")
    gone = gone.where(F.size("gone") > 0).select("_id", "_h", F.explode("gone").alias("g")).groupBy("_id", "_h").agg(F.collect_set("g").alias("_gone"))
    gone, _ = store(gone.select(F.col("_id").alias("i"), F.col("_h").alias("j"), "_gone"), "gone")
    # a merge join whatever the size: the plan is the same on small and large tables
    rows = d.join(gone.hint("merge"), d["_id"].eqNullSafe(F.col("i")) & (d["_h"] == F.col("j")), "left").select("_id", "_h", *(f"c{i}" for i in range(len(keep))), "_gone", "_text")
    out = rows.mapInArrow(_delete, f"_id {kind}, _h long{types}, n_lines long, n_deleted long, kept_text string")
    return restored(out.withColumnRenamed("_id", "doc_id").withColumnRenamed("_h", "text_hash"), keep)
