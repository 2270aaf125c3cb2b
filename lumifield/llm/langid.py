"""Language identification by n-gram filters that answer for all languages at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumifield.functions.storage import store
from lumifield.llm.words import CHUNK, batch, column, mix, small_batches

GRAM = 4  # bytes of an n-gram, within words and one space
PROBES = 3
SLOTS = 1 << 19
SHARE = 0.25  # a language holds an n-gram that is at least so frequent in it, against the language where it is most frequent
LEAST = 3  # occurrences

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ASCII = np.zeros(256, bool)
_ASCII[97:123] = True
_FOLD[:128][~_ASCII[:128] & ~((np.arange(128) >= 65) & (np.arange(128) < 91))] = 32
_LETTERS = _ASCII.copy()
_LETTERS[65:91] = True


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of the texts, and the number of n-grams before each text.

    ASCII letters are folded to lower case, other ASCII counts as space, other bytes stay. Texts are set
    between spaces; n-grams with two spaces in a row are left out, so none crosses from text to text.
    """
    n, m = len(data), len(off) - 1
    room = np.full(n + 2 * m + 2, 32, np.uint8)
    for i in range(m):
        a, b = off[i], off[i + 1]
        room[a + 2 * i + 2 : b + 2 * i + 2] = data[a:b]
    room = _FOLD[room]
    space = room == 32
    pair = space[1:] & space[:-1]
    size = len(room) - GRAM + 1
    code = np.zeros(size, np.uint32)
    bad = np.zeros(size, bool)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | room[k : k + size]
        if k < GRAM - 1:
            bad |= pair[k : k + size]
    good = np.flatnonzero(~bad)
    return code[good], np.searchsorted(good, off + 2 * np.arange(m + 1))


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = column(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    pa.default_memory_pool().release_unused()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (codes, n) in held.items():
            yield batch(lang=pa.array([lang]).take(pa.array(np.zeros(len(codes), np.int64))), gram=codes.astype(np.int64), n=n)
        held.clear()

    for part in batches:
        langs = part.column("lang").dictionary_encode()
        which, names = np.asarray(langs.indices), langs.dictionary.to_pylist()
        for i, j, data, off in _chunks(part.column("_text")):
            codes, upto = _grams(data, off)
            of = np.repeat(which[i:j].astype(np.uint64), np.diff(upto))
            both, n = np.unique((of << np.uint64(32)) | codes, return_counts=True)
            owner = (both >> np.uint64(32)).astype(np.int64)
            for k in np.unique(owner):
                c, m = (both[owner == k] & np.uint64(0xFFFFFFFF)).astype(np.uint32), n[owner == k]
                if names[k] in held:
                    c, back = np.unique(np.r_[held[names[k]][0], c], return_inverse=True)
                    m = np.bincount(back, np.r_[held[names[k]][1], m]).astype(np.int64)
                held[names[k]] = (c, m.astype(np.int64))
        if sum(len(c) for c, _ in held.values()) > 1 << 21:
            yield from flush()
    yield from flush()


def _places(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    h = mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64) for k in range(PROBES)]


def _insert(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    for part in batches:
        word, mask = np.asarray(part.column("word")), np.asarray(part.column("mask"))
        for p in _places(np.asarray(part.column("gram")), slots):
            yield batch(word=word, slot=p, mask=mask)


@dataclass
class Filters:
    """Bit-sliced Bloom filters: table[w, slot] has one bit for each of 63 languages."""

    langs: list[str]
    table: np.ndarray  # (words, slots)
    false: np.ndarray  # chance that a strange n-gram is found, by language
    fallback: str

    def predict(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(self.langs)
        for part in batches:
            for i, j, data, off in _chunks(part.column("_text")):
                codes, upto = _grams(data, off)
                places = _places(codes, self.table.shape[1])
                total = np.diff(upto)
                hits = np.zeros((j - i, n))
                for w, slots in enumerate(self.table):
                    mask = slots[places[0]]
                    for p in places[1:]:
                        mask = mask & slots[p]
                    for bit in range(min(63, n - 63 * w)):
                        found = np.r_[0, np.cumsum((mask >> mask.dtype.type(bit)) & mask.dtype.type(1), dtype=np.int64)]
                        hits[:, 63 * w + bit] = np.diff(found[upto])
                share = np.clip((hits / np.maximum(total, 1)[:, None] - self.false) / (1 - self.false), 0, 1)
                best = np.argmax(share, axis=1)
                score = share[np.arange(j - i), best]
                letters = np.diff(np.r_[0, np.cumsum(_LETTERS[data])][off]) > 0
                wide = np.diff(np.r_[0, np.cumsum(data >= 128)][off]) > 0
                for k in np.flatnonzero(wide & ~letters):
                    letters[k] = any(c.isalpha() for c in bytes(data[off[k] : off[k + 1]]).decode("utf-8", "replace"))
                names = [("und" if not letters[k] else self.langs[best[k]] if score[k] > 0 else self.fallback) for k in range(j - i)]
                own = part.slice(i, j - i).drop_columns(["_text"])
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))],
                    [*own.schema.names, "lang_pred", "score"])


def learn(labelled: DataFrame, slots: int = SLOTS, share: float = SHARE, least: int = LEAST) -> Filters:
    """Filters from ``labelled`` (text, lang); every row counts, rows without text or lang teach nothing.

    The n-grams of all rows are counted by language, combined in each task. A language holds an n-gram
    seen ``least`` times in it whose rate is at least ``share`` of the highest rate among languages, so that names
    and foreign lines don't fill every filter. The filter of fixed size is put together on the executors;
    only its occupied slots reach the driver, at most ``slots`` for each 63 languages.
    """
    spark = small_batches(labelled).sparkSession
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").alias("_text"))
    counted = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted, _ = store(counted, "grams")
    sizes = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).toLocalIterator()}
    langs = sorted(sizes)
    if not langs:
        return Filters([], np.zeros((0, slots), np.int64), np.zeros(0), "und")
    about = spark.createDataFrame([(k, i // 63, 1 << (i % 63), float(sizes[k])) for i, k in enumerate(langs)], "lang string, word int, bit long, size double")
    rate = counted.join(F.broadcast(about), "lang").withColumn("rate", F.col("n") / F.col("size"))
    most = F.max("rate").over(Window.partitionBy("gram"))
    held = rate.withColumn("most", most).where((F.col("rate") >= share * F.col("most")) & (F.col("n") >= least))
    masks = held.groupBy("word", "gram").agg(F.bit_or("bit").alias("mask"))
    filled = masks.mapInArrow(lambda it: _insert(it, slots), "word int, slot long, mask long")
    got = filled.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    kind = np.uint8 if len(langs) <= 8 else np.uint16 if len(langs) <= 16 else np.int64
    table = np.zeros(((len(langs) + 62) // 63, slots), kind)
    table[got["word"], got["slot"]] = got["mask"].astype(kind)
    fill = np.array([((table[i // 63] >> kind(i % 63)) & kind(1)).mean() for i in range(len(langs))])
    return Filters(langs, table, np.minimum(fill**PROBES, 0.99), max(langs, key=lambda k: (sizes[k], k)))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """Add lang_pred and score to ``docs`` (replacing columns of these names); only the text is looked at.

    score is the share of the text's n-grams that the language's filter holds, less false finds; texts of any length are read whole. Null texts and
    texts without a letter are ``und`` with score 0; a text with letters of which no filter holds an
    n-gram gets the most frequent language with score 0; without any labelled rows all is ``und``. Ties go to the first name.
    """
    out = docs.drop("lang_pred", "score")
    named = out.toDF(*[f"c{i}" for i in range(len(out.columns))])
    keep = [f"c{i}" for i in range(len(out.columns))]
    text = keep[out.columns.index("text")]
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(keep, named.schema.fields))
    if not filters.langs:
        return out.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    # the filters go with the function: a fixed number of slots for each 63 languages
    got = named.withColumn("_text", F.col(text)).mapInArrow(
        lambda it: filters.predict(it), f"{schema}, lang_pred string, score double")
    return got.toDF(*out.columns, "lang_pred", "score")
