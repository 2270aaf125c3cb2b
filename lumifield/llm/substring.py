"""Substring dedup: removal of long word sequences that occur more than once, grouped by the least hash of their eight-word runs (in place of De Bruijn compaction)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifield.functions.storage import store
from lumifield.llm.words import batch, covered, running, signed, stretch, words

WINDOW = 35  # words of a sequence that may not occur twice
EDGE = 8  # words of an edge of the graph


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost least value in each h[i:i+span], by doubling."""
    place, size = np.arange(len(h)), 1
    while size < span:
        step = min(size, span - size)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(h[a] <= h[b], a, b)
        size += step
    return place


def _edges(batches: Iterator[pa.RecordBatch], window: int, edge: int) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        ids, hs = rows.column("_id"), rows.column("_h")
        for w in words(rows.column("_text")):
            at = w.windows(window)[0]
            if not len(at):
                continue
            sums, n = running(w.hash), len(w.hash)
            starts = np.arange(n - edge + 1)
            mers = stretch(sums, starts, starts + edge)
            # edges across two texts get a hash too, but no window holds one
            chosen = _least(mers, window - edge + 1)[at]
            new = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
            first, last, mer = at[new], at[np.r_[new[1:], len(at)] - 1], chosen[new]
            path = stretch(sums, first, last + window) ^ ((mer - first).astype(np.uint64) << np.uint64(32))
            text = w.text[first]
            before = w.upto[text]
            take = pa.array(text + w.first)
            yield batch(_id=ids.take(take), _h=hs.take(take), mer=signed(mers[mer]), path=signed(path),
                        first=(first - before).astype(np.int32), last=(last - before).astype(np.int32))


def _marks(spans: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Row and struct of the list elements of a column; null counts as an empty list."""
    n = np.diff(np.asarray(spans.offsets))
    n = np.where(np.asarray(spans.is_null()), 0, n)
    return np.repeat(np.arange(len(spans)), n), spans.flatten()


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        row, span = _marks(rows.column("spans"))
        first, last = (np.asarray(span.field(k)) for k in ("first", "last"))
        mer, alone = np.asarray(span.field("mer")), np.asarray(span.field("alone").cast("int8")).astype(bool)
        for w in words(rows.column("_text")):
            mine = np.flatnonzero((row >= w.first) & (row < w.last))
            if not len(mine):
                continue
            size = last[mine] - first[mine] + 1
            which = np.repeat(mine, size)
            p = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[which]
            place = p + w.upto[row[which] - w.first]
            take = pa.array(row[which])
            yield batch(_id=rows.column("_id").take(take), _h=rows.column("_h").take(take), mer=mer[which],
                        seq=signed(stretch(running(w.hash), place, place + window)), at=p.astype(np.int32), alone=alone[which])


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        row, span = _marks(rows.column("_spans"))
        first, last = (np.asarray(span.field(k)) for k in ("first", "last"))
        rest = rows.drop_columns(["_spans", "_text"])
        for w in words(rows.column("_text")):
            mine = np.flatnonzero((row >= w.first) & (row < w.last))
            n = len(w.hash)
            gone = covered(n, first[mine] + w.upto[row[mine] - w.first], last[mine] - first[mine] + window)
            kept = np.flatnonzero(~gone)
            text = w.text[kept]
            follows = np.r_[text[1:] == text[:-1], False] if len(kept) else np.zeros(0, bool)
            # bytes of kept words, and one byte after each that is not the last of its text: a separator
            step = np.zeros(len(w.data) + 1, np.int8)
            step[w.start[kept]] += 1
            step[w.end[kept]] -= 1
            mask = np.cumsum(step[:-1], dtype=np.int8) > 0
            gap = w.end[kept[follows]]
            mask[gap] = True
            out = w.data.copy()
            out[gap] = 32
            size = np.r_[0, np.cumsum(mask)][w.ends]
            kept_text = pa.LargeStringArray.from_buffers(
                w.last - w.first, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(out[mask])).cast(pa.string())
            lost = np.r_[0, np.cumsum(gone)][w.upto]
            part = rest.slice(w.first, w.last - w.first)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.diff(w.upto).astype(np.int64)), pa.array(np.diff(lost).astype(np.int64)), kept_text],
                [*part.schema.names, "n_words", "n_removed", "kept_text"])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """Remove each word covered by a window of ``window`` words whose sequence starts anywhere else too.

    ``docs`` has doc_id and text. Returns one row per row: doc_id, n_words, n_removed, kept_text (kept words joined by
    one space). Every occurrence goes, the first one too; windows are judged on the input.

    1. Edges are runs of ``edge`` words; the graph is thinned to the edge of least hash in each window, which equal
       windows choose alike. An edge occurrence stands for the windows that chose it, its path.
    2. Edges that occur once end here. A repeated edge all of whose occurrences lie on the same path
       does not branch: every window of its path is repeated, and the path is settled as a whole by a join.
    3. At an edge with several paths, those that occur twice are settled too. One occurrence per different path is
       looked up in its text by its coordinates, and its windows are compared one by one.
    4. Settled spans go back to their texts by a join.

    Edges of a hot passage are counted before the shuffle, and joins on them are on one counted row.
    Null or empty texts have no words; texts shorter than a window lose none, long ones are read whole; equal rows count as occurrences of
    their own; a null doc_id is a value like any other; no rows give no rows. Other columns are ignored.
    """
    d = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_h"), F.col("text").alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = f"_id {kind}, _h long"
    found = d.mapInArrow(lambda it: _edges(it, window, edge), f"{key}, mer long, path long, first int, last int")
    found, _ = store(found, "edges")
    again = found.groupBy("mer").agg(F.count(F.lit(1)).alias("n"), (F.min("path") != F.max("path")).alias("branch"))
    # written before the join, so that both sides are plain shuffles and a hot edge can be split
    counted, _ = store(again.where("n > 1").select("mer", "branch"), "counted")
    again, _ = store(found.join(counted, "mer"), "again")
    plain, branch = again.where("NOT branch"), again.where("branch")
    paths = branch.groupBy("mer", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "_h", "first", "last")).alias("c"))
    paths, _ = store(paths, "paths")
    settled = branch.select("mer", "path", "_id", "_h", "first", "last").join(paths.where("n > 1").select("mer", "path"), ["mer", "path"])
    looked = paths.select("c.*", "mer", (F.col("n") == 1).alias("alone")).groupBy("_id", "_h").agg(
        F.collect_set(F.struct("first", "last", "mer", "alone")).alias("spans"))
    same = lambda a, b: a["_h"].eqNullSafe(b["_h"]) & a["_id"].eqNullSafe(b["_id"])
    asked = d.join(looked, same(d, looked)).select(d["_id"], d["_h"], "_text", "spans")
    seqs = asked.mapInArrow(lambda it: _windows(it, window), f"{key}, mer long, seq long, at int, alone boolean")
    # a text that occurs as several equal rows is looked up once for each: they count once, as one path
    seqs, _ = store(seqs.distinct(), "seqs")
    twice = seqs.groupBy("mer", "seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mer", "seq")
    single = seqs.where("alone").join(twice, ["mer", "seq"]).select("_id", "_h", F.col("at").alias("first"), F.col("at").alias("last"))
    cols = ["_id", "_h", "first", "last"]
    marks = plain.select(cols).unionByName(settled.select(cols)).unionByName(single)
    marks = marks.groupBy("_id", "_h").agg(F.collect_set(F.struct("first", "last")).alias("_spans"))
    rows = d.join(marks, same(d, marks), "left").select(d["_id"], "_text", "_spans")
    out = rows.mapInArrow(lambda it: _cut(it, window), f"_id {kind}, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("_id", "doc_id")
