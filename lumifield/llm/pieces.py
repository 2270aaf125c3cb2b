"""SentencePiece encoding and decoding with a streaming Viterbi search of bounded memory."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifield.llm.kept import kept
from lumifield.llm.words import small_batches

SPACE = "▁"
LETTER, MARK = "[A-Za-zÀ-ÖØ-öø-ɏ]", f"[^A-Za-zÀ-ÖØ-öø-ɏ{SPACE}\n]"  # Latin letters, and what is neither they nor space
REMEMBER = 300_000  # segments, and pairs of pieces, whose result is kept


class Vocabulary:
    """Pieces of a model with identity normalisation: text, score, kind.

    ``merges`` tells how scores are meant: False for a unigram model, where the best segmentation has the greatest sum of
    scores; True for a merge model, where the score ranks the merge that makes a piece.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], unknown: int, merges: bool, prefix: bool = True,
                 special: frozenset[int] = frozenset()) -> None:
        self.pieces, self.byte_ids, self.unknown, self.merges, self.prefix = pieces, byte_ids, unknown, merges, prefix
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if i not in special and i != unknown and i not in set(byte_ids)}
        self.longest = max(map(len, self.ids), default=1)
        self.score = [s for _, s in pieces]
        self.lowest = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        raw = {i: bytes([k]) for k, i in enumerate(byte_ids)}
        self.bytes = [raw.get(i, b"" if i in special else p.replace(SPACE, " ").encode()) for i, (p, _) in enumerate(pieces)]
        # characters that only stand alone, and whether a space sign only starts a piece: places where every path has a boundary
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        self.breaks = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.lone_newline = "\n" not in inner
        self.pure = not any(re.search(f"{LETTER}{MARK}|{MARK}{LETTER}", p) for p in self.ids)
        self._pairs: dict[tuple[str, str], bool] = {}
        self.next: dict[str, dict[str, bool]] = {}  # piece -> what may stand right after it, and what may not
        self._nexts = 0
        # lengths of the pieces of three characters and more by their last three, longest first
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                ends.setdefault(p[-3:], set()).add(len(p))
        self.ends = {k: (*sorted(v, reverse=True), 2, 1) for k, v in ends.items()}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        with open(path, "rb") as f:
            merges = _model_type(f.read()) == 2
        return cls([(m.id_to_piece(i), m.get_score(i)) for i in n], [i for i in n if m.is_byte(i)], m.unk_id(), merges,
                   special=frozenset(i for i in n if m.is_control(i) or m.is_unused(i)))

    def merged(self, text: str) -> list[str]:
        """The pieces that merging makes of ``text``: the best-scored neighbours join first, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """May piece ``b`` stand right after ``a`` in a result of merging?"""
        got = self._pairs.get((a, b))
        if got is None:
            if len(self._pairs) > REMEMBER:
                self._pairs.clear()
            got = self._pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def after(self, a: str) -> dict[str, bool]:
        """The known answers of :meth:`may` for texts right after piece ``a``."""
        got = self.next.get(a)
        if got is None:
            got = self.next[a] = {}
        return got

    def may(self, a: str, b: str) -> bool:
        """May ``b``, a piece or a character, stand right after ``a`` in a result of merging?"""
        if self._nexts > REMEMBER:
            for known in self.next.values():
                known.clear()
            self._nexts = 0
        ok = self.after(a)[b] = self.made(b) and (not a or self.follows(a, b))
        self._nexts += 1
        return ok

    def made(self, a: str) -> bool:
        """Is piece ``a`` what merging makes of its own text?"""
        return len(a) == 1 or self.follows("", a)


def _model_type(data: bytes) -> int:
    """trainer_spec.model_type of a serialised model (1 unigram, 2 merges); fields 2 and then 3."""
    def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
        i = 0

        def varint() -> int:
            nonlocal i
            n = shift = 0
            while True:
                c = b[i]
                i += 1
                n |= (c & 127) << shift
                shift += 7
                if c < 128:
                    return n

        while i < len(b):
            key = varint()
            kind = key & 7
            if kind == 0:
                yield key >> 3, varint()
            elif kind == 2:
                n = varint()
                yield key >> 3, b[i : i + n]
                i += n
            else:
                n = 4 if kind == 5 else 8
                yield key >> 3, b[i : i + n]
                i += n

    spec = next((v for k, v in fields(data) if k == 2), b"")
    return next((v for k, v in fields(spec) if k == 3), 1)


class Viterbi:
    """Best path through the lattice of pieces, fed bit by bit.

    Kept are the last ``longest`` boundaries with their best score and back pointer, and the path pieces not
    yet committed. Only these boundaries can be extended; as soon as the paths that lead to all of them meet in one
    boundary, the pieces before it are final: they are given out and forgotten. In a unigram model a path's score is the sum of
    its pieces' scores. In a merge model a piece may follow another only where merging their text would leave both
    (score 0, else minus infinity), which leaves exactly the path that merging makes.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.done = 0  # committed boundary, in characters fed so far
        self.text = ""  # characters from there on
        # boundary -> (score, boundary before, piece before); those that no path reaches are missing
        self.back: dict[int, tuple[float, int, str]] = {0: (0.0, -1, "")}
        self.at = 0
        self.widest = 1

    def _step(self) -> None:
        v, self.at = self.v, self.at + 1
        best = None
        for n in range(min(v.longest, self.at - self.done), 0, -1):
            before = self.back.get(self.at - n)
            if before is None:
                continue
            piece = self.text[self.at - n - self.done : self.at - self.done]
            k = v.ids.get(piece)
            if k is None and n > 1:
                continue
            if v.merges:
                if (before[2] and not v.follows(before[2], piece)) or (n > 1 and not v.made(piece)):
                    continue
                best = (0.0, self.at - n, piece)
                break  # no other piece can end here
            score = before[0] + (v.score[k] if k is not None else v.lowest)
            if best is None or score > best[0]:
                best = (score, self.at - n, piece)
        if best is not None:
            self.back[self.at] = best

    def _commit(self, last: bool) -> Iterator[str]:
        live = [self.at] if last else [b for b in range(max(self.done, self.at - self.v.longest + 1), self.at + 1) if b in self.back]
        # walk the furthest path back until all are at one boundary
        heads = set(live)
        while len(heads) > 1:
            far = max(heads)
            heads.remove(far)
            heads.add(max(self.back[far][1], self.done))
        meet = heads.pop()
        path, b = [], meet
        while b > self.done:
            _, b, piece = self.back[b]
            path.append(piece)
        if meet > self.done or path:
            self.text = self.text[meet - self.done :]
            self.done = meet
            self.back = {b: x for b, x in self.back.items() if b >= meet}
        yield from reversed(path)

    def feed(self, text: str) -> Iterator[str]:
        """Pieces that become final with these characters."""
        for c in text:
            self.text += c
            self._step()
            if self.at - self.done >= 2 * self.v.longest:
                yield from self._commit(False)
            self.widest = max(self.widest, len(self.text))

    def end(self) -> Iterator[str]:
        yield from self._commit(True)


class Encoder:
    """Ids of texts. A text is fed in segments that every path has to break between, and segments seen lately are remembered."""

    def __init__(self, vocabulary: Vocabulary, remember: int = REMEMBER) -> None:
        self.v, self.remember, self.known, self.packed = vocabulary, remember, {}, {}
        if vocabulary.lone_newline and vocabulary.pure:
            parts = [f"{SPACE}*(?:{LETTER}+|{MARK}+)", f"{SPACE}+", "\n"]
        elif vocabulary.lone_newline:
            parts = [f"{SPACE}*[^{SPACE}\n]+", f"{SPACE}+", "\n"]
        else:
            parts = [f"{SPACE}*[^{SPACE}]+", f"{SPACE}+"]
        self.cut = re.compile("|".join(parts)).findall if vocabulary.breaks else lambda t: [t]

    def _ids(self, piece: str) -> bytes:
        """Ids of a piece, which is a character of its own where it is not in the vocabulary."""
        v, k = self.v, self.v.ids.get(piece)
        ids = [k] if k is not None else [v.byte_ids[b] for b in piece.encode()] if v.byte_ids else [v.unknown]
        got = self.packed[piece] = np.array(ids, "<u4").tobytes()
        return got

    def _window(self, text: str) -> list[str]:
        """The path of :class:`Viterbi` for a merge model and a text that fits its window, where nothing is committed before the end."""
        v, n, ids, ends, short = self.v, len(text), self.v.ids, self.v.ends, (2, 1)
        last: list[str] = [""] * (n + 1)
        rows: list[dict[str, bool] | None] = [v.after("")] + [None] * n  # of the piece that ends there
        for j in range(1, n + 1):
            for size in ends.get(text[j - 3 : j], short) if j > 2 else short:
                i = j - size
                if i < 0 or (row := rows[i]) is None:
                    continue
                piece = text[i:j]
                if size > 1 and piece not in ids:
                    continue
                ok = row.get(piece)
                if ok or (ok is None and v.may(last[i], piece)):
                    last[j], rows[j] = piece, v.next.get(piece) or v.after(piece)
                    break
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def segment(self, text: str) -> bytes:
        if self.v.merges and len(text) <= 2 * self.v.longest:
            pieces = self._window(text)
        else:
            search = Viterbi(self.v)
            pieces = [*search.feed(text), *search.end()]
        packed, ids = self.packed.get, self._ids
        got = b"".join([packed(p) or ids(p) for p in pieces])
        if len(text) <= 64:
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[text] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids; none for a null or empty text."""
        if not text:
            return b""
        text = text.replace(" ", SPACE)
        if self.v.prefix:
            text = SPACE + text
        known, segment = self.known.get, self.segment
        return b"".join([known(s) or segment(s) for s in self.cut(text)])


def _vocabulary(path: str) -> Vocabulary:
    """The model, read once by each Python worker, whatever the number of its tasks."""
    return kept("vocabulary", path, Vocabulary.load)


def _encoder(path: str) -> Encoder:
    """An encoder that a worker's tasks share, with the segments and pairs that it remembers."""
    return kept("encoder", path, lambda p: Encoder(_vocabulary(p)))


def decode(vocabulary: Vocabulary, ids: Iterable[int], chunk: int = 1 << 16) -> str:
    """Text of ids, decoded ``chunk`` pieces at a time; a character cut between two chunks is carried over."""
    table, utf8, out, ids = vocabulary.bytes, codecs.getincrementaldecoder("utf-8")("replace"), [], iter(ids)
    while part := [table[i] for i in islice(ids, chunk)]:
        out.append(utf8.decode(b"".join(part)))
    out.append(utf8.decode(b"", True))
    text = "".join(out)
    return text[1:] if vocabulary.prefix and text.startswith(" ") else text


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    for part in batches:
        rest = part.drop_columns(["_text"])
        text = part.column("_text")
        for lo in range(0, part.num_rows, 256):
            ids = pa.array([encoder.encode(t) for t in text.slice(lo, 256).to_pylist()], pa.binary())
            own = rest.slice(lo, 256)
            yield pa.RecordBatch.from_arrays([*own.columns, ids], [*own.schema.names, "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = _vocabulary(path)
    for part in batches:
        rest = part.drop_columns(["ids"])
        for lo in range(0, part.num_rows, 256):
            text = [decode(v, np.frombuffer(b, "<u4").tolist()) for b in part.column("ids").slice(lo, 256).to_pylist()]
            own = rest.slice(lo, 256)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(text, pa.string())], [*own.schema.names, "decoded"])


def encode(docs: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """``keep`` and ids (little-endian 32-bit numbers) of each row's text, by the model file ``model``.

    The ids are those of the SentencePiece library for models with identity normalisation. Each row is
    encoded where it is read: nothing is shuffled. Null and empty texts have no ids. Equal rows have equal ids; no rows give no
    rows. Columns not in ``keep`` are ignored.
    """
    return _run(docs.select(*keep, F.col("text").alias("_text")), keep, _encode, model, "ids binary")


def decode_ids(rows: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """``keep`` and decoded, the text of the ids in column ids; the space sign itself comes back as a space."""
    return _run(rows.select(*keep, F.coalesce("ids", F.lit(b"")).alias("ids")), keep, _decode, model, "decoded string")


def _run(rows: DataFrame, keep: list[str], step, model: str, more: str) -> DataFrame:
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep]
    return small_batches(rows).mapInArrow(lambda it: step(it, model), ", ".join([*kinds, more]))
