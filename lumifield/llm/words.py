"""Words of many texts at once, as NumPy arrays over the bytes of an Arrow column.

A word is a longest run of characters other than space and the controls 9 to 13. All of these are single
bytes that occur inside no other UTF-8 character, so words are found on bytes. Null texts have no word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CHUNK = 1 << 20  # bytes that are hashed at a time; a longer text makes a longer chunk

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


_cache: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    got = _cache.get(int(base))
    if got is None or len(got) < n:
        got = _cache[int(base)] = _powers(base, max(n, CHUNK))
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """Running sums of value * base^place, with a leading zero; any stretch is hashed from two of them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _Q) -> np.ndarray:
    """Hash of values[start:end] for each pair, whatever the place; equal stretches have equal hashes."""
    return mix((sums[end] - sums[start]) * _power(_inverse(base), len(sums))[start] + (end - start).astype(np.uint64))


def running(hashes: np.ndarray) -> np.ndarray:
    return _sums(hashes, _Q)


@dataclass
class Words:
    """Words of the texts ``first`` to ``last`` of a column."""

    first: int
    last: int
    data: np.ndarray  # bytes of these texts
    ends: np.ndarray  # of texts in data, with a leading zero
    start: np.ndarray  # of words in data
    end: np.ndarray
    hash: np.ndarray
    upto: np.ndarray  # words before each text, with the total at the end

    @property
    def text(self) -> np.ndarray:
        """Text of each word, counted from ``first``."""
        return np.repeat(np.arange(len(self.upto) - 1), np.diff(self.upto))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window of ``size`` words of one text starts, and the windows' hashes."""
        n = np.diff(self.upto)
        room = np.maximum(n - size + 1, 0)
        at = np.arange(room.sum()) + np.repeat(self.upto[:-1] - (np.cumsum(room) - room), room)
        return at, stretch(running(self.hash), at, at + size)


def column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), off


def _runs(b: np.ndarray, ends: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each longest run without an ``apart`` byte inside one text."""
    word = ~apart[b]
    border = np.zeros(len(b) + 1, bool)
    border[ends] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | border[1:-1]
    end[:-1] &= ~word[1:] | border[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hash_runs(b: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of b[start:end] for each run, computed on about CHUNK bytes at a time."""
    out, i, table = np.empty(len(start), np.uint64), 0, _LOWER if lower else _BYTE
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        out[i:j] = stretch(_sums(table[b[lo:hi]], _P), start[i:j] - lo, end[i:j] - lo, _P)
        i = j
    return out


def lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the non-empty lines of the texts."""
    s, e = _runs(w.data, w.ends, _LINE)
    return s, e, hash_runs(w.data, s, e)


def words(texts: pa.Array, lower: bool = False, chunk: int = CHUNK) -> Iterator[Words]:
    """The words of a column, some texts at a time; ``lower`` hashes A to Z as a to z."""
    data, off = column(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + chunk, "right")) - 1))
        b, ends = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e = _runs(b, ends, SPACE)
        yield Words(i, j, b, ends, s, e, hash_runs(b, s, e, lower), np.searchsorted(s, ends))
        i = j
    pa.default_memory_pool().release_unused()  # workers are used again, by other operators too


def repeated(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: does its value occur twice or more in its group, and is it an occurrence but the first?"""
    key = mix(value ^ mix(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    again, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order] = same
    same[:-1] |= same[1:]
    any_[order] = same
    return any_, again


def covered(n: int, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Places 0 to n - 1 that lie in some [at, at + size)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step[:-1]) > 0


def batch(**columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``; its session sends texts to Python 1,024 at a time, unless another size was set."""
    conf = docs.sparkSession.conf
    if conf.get(ROWS, "10000") == "10000":
        conf.set(ROWS, "1024")
    return docs


def carried(docs: DataFrame, keep: Sequence[str]) -> tuple[list[Column], str]:
    """Columns of ``docs`` under names c0, c1, ... that clash with nothing, and their types as a schema text."""
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    return cols, "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))


def restored(out: DataFrame, keep: Sequence[str]) -> DataFrame:
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(keep)})
