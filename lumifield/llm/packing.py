"""Packing of tokenised documents into windows of several context sizes."""

from __future__ import annotations

import os
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifield.llm.kept import kept
from lumifield.llm.words import small_batches

LONGEST = 2048
SHORTEST = 64  # least context-size tier; shorter documents fill gaps
POOL = 4096  # documents that are packed together
STEP_TOKENS = 1 << 16  # tokens of a step group
END = np.array(1, "<u4")
MARKS = ".,;:!?#$%&*|"


class WordTokens(dict):
    """Ids of texts by a tokenizer of the ``tokenizers`` library, as little-endian 32-bit numbers.

    For tokenizers that drop white space, never join across it or from letters to marks, and fold case. Texts are cut at
    spaces and line ends; the different words of some texts are looked up once, and those seen lately are remembered.
    """

    def __init__(self, path: str, remember: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one that it may use
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        words = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(words.values()) + 1, bool) if suffix else None
        if suffix:
            self.ending[[i for w, i in words.items() if w.endswith(suffix)]] = True

    @staticmethod
    def parts(word: str) -> list[str]:
        """A word of letters, and the marks after it, where the tokenizer splits it anyway."""
        core = word.rstrip(MARKS)
        return [core, word[len(core) :]] if core != word and core.isalpha() and "İ" not in core else [word]

    def learn(self, words: list[str]) -> None:
        new = set(words).difference(self)
        if len(self) + len(new) > self.remember:
            lately = {w: self[w] for w in self.keys() & set(words)}
            self.clear()
            self.update(lately)
        parts = {w: self.parts(w) for w in new}
        fresh = list(set().union(*parts.values()).difference(self))
        plain = [w for w in fresh if w.isalpha() and max(w) < "\u0250" and "İ" not in w]
        if self.ending is not None and plain:
            # words of letters are one run of tokens each, ended by the first that ends a word: encoded as one text
            ids = np.array(self.tokenizer.encode(" ".join(plain), add_special_tokens=False).ids, "<u4")
            upto = np.flatnonzero(self.ending[ids]) + 1
            if len(upto) == len(plain):
                raw = ids.tobytes()
                self.update(zip(plain, (raw[4 * i : 4 * j] for i, j in zip([0, *upto[:-1].tolist()], upto.tolist()))))
                fresh = [w for w in fresh if w not in self]
        for w, e in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)):
            self[w] = array("I", e.ids).tobytes()
        for w, each in parts.items():
            if len(each) > 1:
                self[w] = b"".join([self[p] for p in each])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.replace_substring(texts.fill_null(""), "\n", " ")
        # a special token's bracket, or letters whose lower case depends on their place or is not one letter: left to the tokenizer
        odd = pc.match_substring_regex(texts, "<\\||[İΣ]")
        # marks after a word become a word of their own, so that a word is looked up once whatever follows it
        plain = pc.replace_substring_regex(pc.utf8_lower(texts), f"([a-zß-öø-ɏ])([{MARKS}]+)( |$)", r"\1 \2\3")
        lists = pc.split_pattern(pc.if_else(odd, texts, plain), " ")
        words = lists.flatten().dictionary_encode()
        different = words.dictionary.to_pylist()
        self.learn(different)
        blobs = [self[w] for w in different]
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        start, of = np.cumsum(size) - size, np.asarray(words.indices)
        n = size[of]
        upto = np.r_[0, np.cumsum(n)]
        ids = np.frombuffer(b"".join(blobs), "<u4")[np.repeat(start[of] - upto[:-1], n) + np.arange(upto[-1])]
        off = upto[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(off[:-1], off[1:])]


def _word_tokens(path: str) -> WordTokens:
    """The tokenizer, read once by each Python worker; its tasks share the words that it remembers."""
    return kept("word tokens", path, WordTokens)


Piece = tuple[int, int, int]  # length, document, start


class Pool:
    """Pieces of documents, by length."""

    def __init__(self, pieces: list[Piece]) -> None:
        self.items = sorted(pieces)

    def longest(self, most: int, over: int = 0) -> Piece | None:
        """Take out the longest piece with over < length <= most."""
        i = bisect_right(self.items, (most, float("inf"), 0)) - 1
        return self.items.pop(i) if i >= 0 and self.items[i][0] > over else None

    def head(self, room: int, most: int) -> Piece | None:
        """The first ``room`` ids of the shortest piece longer than that, up to ``most``; the rest stays."""
        i = bisect_left(self.items, (room + 1, -1, 0))
        if i >= len(self.items) or self.items[i][0] > most:
            return None
        n, doc, start = self.items.pop(i)
        insort(self.items, (n - room, doc, start + room))
        return room, doc, start


def pack(pieces: list[Piece], longest: int = LONGEST, shortest: int = SHORTEST) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences of pieces, and the pieces of the last window, which could not be filled.

    A piece of ``longest`` ids or more is cut into full windows and a rest. A rest goes to the tier of
    the next power of two. From the longest tier down, each rest opens a window of its tier; the gap takes the longest
    whole piece that fits, again and again, then the head of a piece of a shorter tier, or else of its own.
    """
    out, rests = [], []
    for n, doc, start in pieces:
        full = n - n % longest
        out += [[(longest, doc, start + at)] for at in range(0, full, longest)]
        if n > full:
            rests.append((n - full, doc, start + full))
    pool, tier = Pool(rests), longest
    while pool.items:
        first = pool.longest(tier, tier // 2 if tier > shortest else 0)
        if first is None:
            tier //= 2
            continue
        window, room = [first], tier - first[0]
        while room:
            piece = pool.longest(room) or pool.head(room, tier // 2) or pool.head(room, tier)
            if piece is None:
                return out, window
            window.append(piece)
            room -= piece[0]
        out.append(window)
    return out, []


def split(window: list[Piece]) -> list[list[Piece]]:
    """A window cut into sequences whose lengths are different powers of two, longest first."""
    total, out = sum(p[0] for p in window), []
    room = 0
    for n, doc, start in window:
        while n:
            if not room:
                room = 1 << (total.bit_length() - 1)
                total -= room
                out.append([])
            take = min(n, room)
            out[-1].append((take, doc, start))
            n, start, room = n - take, start + take, room - take
    return out


def step_groups(costs: list[int], lengths: list[int], tokens: int) -> list[int]:
    """A step group for each sequence: sequences of one length go to groups of about ``tokens`` ids, dealt out to and
    fro by descending cost so that the groups' sums are near each other."""
    out, start = [0] * len(costs), 0
    for length in sorted(set(lengths), reverse=True):
        mine = sorted((i for i, n in enumerate(lengths) if n == length), key=lambda i: -costs[i])
        groups = max(1, round(len(mine) * length / tokens))
        for place, i in enumerate(mine):
            turn, at = divmod(place, groups)
            out[i] = start + (at if turn % 2 == 0 else groups - 1 - at)
        start += groups
    return out


def _pack(batches: Iterator[pa.RecordBatch], encoder: Callable[[], WordTokens], schema: pa.Schema, longest: int, pool: int, tokens: int) -> Iterator[pa.RecordBatch]:
    encode = encoder().encode
    task = TaskContext.get().partitionId() << 32
    n_seq = n_step = 0
    ids: dict[int, tuple[bytes, pa.RecordBatch, int]] = {}  # document -> its ids and its row
    waiting: list[Piece] = []

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal n_seq, n_step, waiting
        done, waiting = pack(waiting, longest)
        if final:
            done, waiting = done + split(waiting), []
        cost = [sum(p[0] ** 2 for p in s) for s in done]
        size = [sum(p[0] for p in s) for s in done]
        step = step_groups(cost, size, tokens)
        for lo in range(0, len(done), 256):
            rows: list[tuple] = []
            where: list[pa.RecordBatch] = []
            for k in range(lo, min(len(done), lo + 256)):
                at = 0
                for n, doc, start in done[k]:
                    data, row, i = ids[doc]
                    where.append(row.slice(i, 1))
                    rows.append((start, n, data[4 * start : 4 * (start + n)], len(data) // 4, task + n_seq + k, at, size[k], task + n_step + step[k]))
                    at += n
            own = pa.Table.from_batches(where).combine_chunks()
            part = pa.Table.from_arrays([*own.columns, *map(pa.array, zip(*rows))], names=[f"c{i}" for i in range(own.num_columns + 8)])
            yield from part.rename_columns(schema.names).cast(schema).combine_chunks().to_batches()
        n_seq, n_step = n_seq + len(done), n_step + max(step, default=-1) + 1
        held = {p[1] for p in waiting}
        for doc in [d for d in ids if d not in held]:
            del ids[doc]
        pa.default_memory_pool().release_unused()

    number = 0
    for part in batches:
        rest, texts = part.drop_columns(["_text"]), part.column("_text")
        for lo in range(0, len(texts), 1024):
            for i, found in enumerate(encode(texts.slice(lo, 1024)), lo):
                data = found.tobytes() + END.tobytes()
                ids[number] = (data, rest, i)
                waiting.append((len(data) // 4, number, 0))
                number += 1
            if len(waiting) >= pool:
                yield from flush(False)
    yield from flush(True)


def pack_documents(docs: DataFrame, tokenizer: str, keep: list[str], longest: int = LONGEST, pool: int = POOL,
                   step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Sequences of up to ``longest`` ids with next to no padding, one row per piece.

    ``docs`` has text and the columns ``keep``. Returns those columns with start (ids of the document before the piece), length, ids
    (little-endian 32-bit numbers), doc_tokens (all ids, the closing 1 included), sequence_id, offset (place in
    the sequence, without gaps from 0), tier (the sequence's length) and step_group.

    Each task packs the documents it reads, ``pool`` at a time, on its own: nothing is shuffled, no key
    gathers rows, and a lost task packs the same rows again to the same sequences. Every sequence has a power of two ids, so
    none is padded: all windows of a pool are filled but the last, which goes on to the next pool and at the end of
    the task is cut at powers of two. Step groups hold sequences of one length with about ``step_tokens`` ids and near sums
    of squared piece lengths.

    A null or empty text is the closing id alone. Equal rows are packed each. A text of any length is cut freely.
    No rows give no rows. Columns not in ``keep`` are ignored.
    """
    got = small_batches(docs).select(*[F.col(c) for c in keep], F.col("text").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in got.schema.fields[:-1]]
    out = ", ".join([*kinds, "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"])
    from pyspark.sql.pandas.types import to_arrow_schema

    names = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)
    return got.mapInArrow(lambda it: _pack(it, lambda: _word_tokens(tokenizer), names, longest, pool, step_tokens), out)
