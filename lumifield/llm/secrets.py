"""Secret scan: candidates from the text, and a random forest that takes out false positives."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifield.functions.storage import shared_folder, store
from lumifield.llm.words import _runs, batch, carried, column, mix, restored, small_batches

# Words next to a credential, and words next to other long values
CREDENTIAL = "access account api apikey auth authorization bearer client credential credentials key passwd password private pwd secret signature token".split()
HARMLESS = "checksum color colour commit card digest etag example guid hash id integrity isbn md5 number phone revision sample serial sha sha1 sha256 uuid version".split()
TESTED = "doc docs example examples fixture fixtures lock mock mocks sample samples spec sum test tests vendor".split()

BARE = 16  # characters of a candidate that nothing is assigned to
ASSIGNED = 8  # characters of a candidate after = or :
TRAIN_ROWS = 10_000  # labelled findings of each kind that the forest is fitted on
DICTIONARY = 50_000  # words of 3 to 8 letters, the most frequent ones of the corpus
TREES, DEPTH, SEED = 24, 6, 17
THRESHOLD = 0.5
AROUND = 48  # bytes looked at on either side

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ALPHA = np.ones(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = False
_ALPHA[128:] = False
_WORD = re.compile(r"[^\W_]+")
_NAMED = re.compile(rb"(?i:%s)\w{0,16}[\"'`]?\]?[ \t]*:?$" % "|".join(CREDENTIAL).encode())  # up to = or :
_VALUE = re.compile(rb"""[=>]?[ \t]*(?:(?i:bearer|basic)[ \t]+)?(?:"((?:\\.|[^"\\\n])+)"|'((?:\\.|[^'\\\n])+)'|`([^`\n]+)`|([^\s"'`]\S*|["'`]\S+))""")
_CLOSED = re.compile(rb"[\"'`]+[,;.)\]}>]*$")
_PLAIN = re.compile(rb"([A-Za-z0-9+/_-]+)[,;.)\]}>]*$")
_NEXT = re.compile(rb"[&;,?][\w.-]*(?i:%s)\w{0,16}[=:]" % "|".join(CREDENTIAL).encode())


def _chunks(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = column(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    pa.default_memory_pool().release_unused()


def assigned_values(raw: bytes, signs: Sequence[int], bounds: Sequence[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(which sign, start, end) of the values given to the name of a credential: all between quotes, else all up to a space.

    ``signs`` are places of = and :, ``bounds`` their texts. A value without quotes ends before a quote that only
    closes something, and before a delimiter and the name of a further credential; punctuation after plain characters is not of it.
    """
    upto = -1
    for n, (k, (lo, hi)) in enumerate(zip(signs, bounds)):
        if k < upto or not _NAMED.search(raw[max(lo, k - AROUND) : k]):
            continue
        m = _VALUE.match(raw, k + 1, hi)
        if m is None:
            continue
        a, z = m.span(m.lastindex)
        if m.lastindex == 4:
            further = _NEXT.search(raw, a, z)
            z = further.start() if further else z
            upto = z
            if (closed := _CLOSED.search(raw[a:z])) and closed.start():
                z = a + closed.start()
            elif plain := _PLAIN.match(raw[a:z]):
                z = a + plain.end(1)
        yield n, a, z


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for i, j, b, off in _chunks(part.column("_text")):
            s, e = _runs(b, off, _APART)
            digits = np.r_[0, np.cumsum(_DIGIT[b])]
            before = np.r_[np.zeros(3, np.uint8), b]  # b[k - 3] at k
            near = np.zeros(len(s), bool)
            for k in range(3):
                near |= (before[s + k] == 61) | (before[s + k] == 58)
            long = e - s
            hit = np.flatnonzero(((long >= BARE) & (digits[e] > digits[s])) | ((long >= ASSIGNED) & near))
            signs = np.flatnonzero((b == 61) | (b == 58))
            some = len(hit) or len(signs)
            # continuation bytes don't count as characters
            chars = np.r_[0, np.cumsum((b & 0xC0) != 0x80)] if some else None
            raw = b.tobytes() if some else b""
            at = np.searchsorted(off, signs, "right") - 1
            spans = set(zip(s[hit].tolist(), e[hit].tolist()))
            spans |= {(a, z) for _, a, z in assigned_values(raw, signs.tolist(), list(zip(off[at].tolist(), off[at + 1].tolist())))
                      if chars[z] - chars[a] >= ASSIGNED}
            spans = sorted(spans)
            text = np.searchsorted(off, np.array([a for a, _ in spans], np.int64), "right") - 1
            values, left, right, start = [], [], [], []
            for (a, z), t in zip(spans, text):
                lo, hi = int(off[t]), int(off[t + 1])
                values.append(raw[a:z].decode())
                left.append(raw[max(lo, a - AROUND) : a].decode("utf-8", "ignore"))
                right.append(raw[z : min(hi, z + AROUND)].decode("utf-8", "ignore"))
                start.append(int(chars[a] - chars[lo]))
            own = part.drop_columns(["_text"]).take(pa.array(text + i))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(start, pa.int64()), pa.array(values, pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string())],
                [*own.schema.names, "start", "value", "left", "right"])


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, path, start, value, left, right): every run of letters, digits and +/_- that has 16 characters
    and a digit, or 8 characters right after = or : (a quote or a space between), in all of each text. Beside these, every
    value of 8 characters, whatever they are, that = or : gives to the name of a credential (:func:`assigned_values`)."""
    d = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_h"),
                    F.col("source").cast("string").alias("path"), F.col("text").alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = d.mapInArrow(_find, f"_id {kind}, _h long, path string, start long, value string, left string, right string")
    return out.withColumnRenamed("_id", "doc_id").withColumnRenamed("_h", "text_hash")


def _language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of lower-case words of 3 to 8 ASCII letters, as packed bytes, and of pairs of characters (negative keys)."""
    held, pairs = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), np.zeros(1 << 14, np.int64)
    for part in batches:
        for _, _, b, off in _chunks(part.column("_text")):
            s, e = _runs(b, off, _ALPHA)
            wide = np.r_[0, np.cumsum(b >= 128)]  # words with other letters are left out as a whole
            short = (e - s >= 3) & (e - s <= 8) & (wide[e] == wide[s])
            s, e = s[short], e[short]
            if not len(b):
                continue
            padded = np.r_[b | np.uint8(32), np.zeros(8, np.uint8)]
            packed = np.zeros(len(s), np.uint64)
            for k in range(8):
                packed = (packed << np.uint64(8)) | np.where(s + k < e, padded[s + k], 0).astype(np.uint64)
            words, n = np.unique(packed, return_counts=True)
            words, back = np.unique(np.r_[held[0], words], return_inverse=True)
            held = (words, np.bincount(back, np.r_[held[1], n]).astype(np.int64))
            plain = b & np.uint8(127)
            pairs += np.bincount((plain[:-1].astype(np.int64) << 7) | plain[1:], minlength=1 << 14)
        if len(held[0]) > 1 << 20:
            yield batch(key=held[0].view(np.int64), n=held[1])
            held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    yield batch(key=held[0].view(np.int64), n=held[1])
    some = np.flatnonzero(pairs)
    yield batch(key=-1 - some, n=pairs[some])


class Language:
    """A dictionary and the frequency of character pairs, both counted over all texts."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray) -> None:
        self.words = frozenset(words.tolist())
        t = pairs.reshape(128, 128) + 0.5
        self.bits = -np.log2(t / t.sum(1, keepdims=True))

    def transition(self, value: str) -> float:
        """Mean bits of a character given the one before it."""
        b = np.frombuffer(value.encode(), np.uint8) & np.uint8(127)  # as counted
        return float(self.bits[b[:-1], b[1:]].mean()) if len(b) > 1 else 0.0

    def coverage(self, value: str) -> float:
        """Share of the characters covered by dictionary words, longest first from the left."""
        low, i, got = value.lower(), 0, 0
        while i < len(low):
            for n in range(min(8, len(low) - i), 2, -1):
                part = low[i : i + n]
                if part.isalpha() and int.from_bytes(part.encode().ljust(8, b"\0"), "big") in self.words:
                    got, i = got + n, i + n
                    break
            else:
                i += 1
        return got / max(1, len(low))


def learn_language(docs: DataFrame, size: int = DICTIONARY) -> Language:
    """Counted over all texts, added up in each task first. The driver gets ``size`` words and 16,384 pairs at most."""
    got = docs.select(F.col("text").alias("_text")).mapInArrow(_language, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    got, _ = store(got, "language")
    words = got.where("key >= 0 AND n >= 3").orderBy(F.desc("n"), "key").limit(size).toPandas()
    pairs, some = np.zeros(1 << 14), got.where("key < 0").toPandas()
    pairs[(-1 - some["key"].to_numpy(np.int64))] = some["n"]
    return Language(words["key"].to_numpy(np.int64), pairs)


FEATURES = ("length digits upper hexadecimal distinct entropy transition coverage depth tested assigned quoted credential harmless "
            "bucket_before bucket_after").split()


def _neighbours(left: str, right: str) -> tuple[list[str], list[str]]:
    return [x.lower() for x in _WORD.findall(left)][-3:], [x.lower() for x in _WORD.findall(right)][:2]


def features(value: str, path: str | None, left: str, right: str, language: Language) -> list[float]:
    n, counts = len(value), Counter(value)
    before, after = _neighbours(left, right)
    steps = [x for x in re.split(r"[^a-z0-9]+", (path or "").lower()) if x]
    bucket = lambda w: float(int(mix(np.array([hash_word(w)], np.uint64))[0]) % 32)
    return [
        float(n), sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n,
        float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None), len(counts) / n,
        -sum(v / n * log2(v / n) for v in counts.values()), language.transition(value), language.coverage(value),
        float((path or "").count("/")), float(any(s in TESTED for s in steps)),
        float(re.search(r"[=:]\s*[\"'`]?$", left) is not None), float(left[-1:] in "\"'`" and left != ""),
        float(any(w in CREDENTIAL for w in before)), float(any(w in HARMLESS for w in before)),
        bucket(before[-1] if before else ""), bucket(after[0] if after else "")]


def hash_word(word: str) -> int:
    out = 0
    for c in word.encode()[:64]:
        out = (out * 1099511628211 + c + 1) & (2**64 - 1)
    return out


def rule_label(value: str, left: str, right: str) -> int | None:
    """1: assigned to the name of a credential; 0: digits only, a harmless name, or one repeated character; None: not known."""
    before, _ = _neighbours(left, right)
    assigned = re.search(r"[=:]\s*[\"'`]?$", left)
    if assigned and before and before[-1] in CREDENTIAL and len(set(value)) > 4:
        return 1
    if value.isdigit() or (before and before[-1] in HARMLESS) or len(set(value)) <= 2:
        return 0
    return None


def describe(found: DataFrame, language: Language) -> DataFrame:
    """Add ``features`` (array<double>) and ``rule`` (1, 0 or null) to candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = list(zip(*(part.column(c).to_pylist() for c in ("value", "path", "left", "right"))))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([features(*r, language) for r in rows], pa.list_(pa.float64())),
                 pa.array([rule_label(r[0], r[2], r[3]) for r in rows], pa.int32())], [*part.schema.names, "features", "rule"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.mapInArrow(run, f"{schema}, features array<double>, rule int")


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (features, label: 1 secret, 0 not); None if one kind is missing.

    Fitted on ``rows`` findings of each kind, those of least hash. Each finding is also given with its neighbouring words
    blanked, so that the characters alone are learned too.
    """
    shuffled = labelled.where("label IS NOT NULL").select(F.xxhash64("features", "label").alias("o"), "features", F.col("label").cast("double").alias("label"))
    sample = None
    for kind in (0.0, 1.0):
        part = shuffled.where(F.col("label") == kind).orderBy("o").limit(rows)
        sample = part if sample is None else sample.unionByName(part)
    blank = FEATURES.index("assigned")
    bare = F.transform("features", lambda v, i: F.when(i >= blank, F.lit(0.0)).otherwise(v))
    sample = sample.unionByName(sample.withColumn("features", bare))
    sample, n = store(sample.coalesce(1).sortWithinPartitions("label", "o", "features"), "findings")
    if not n or sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="vector", labelCol="label")
    path = f"{shared_folder(labelled.sparkSession)}/forest-{uuid.uuid4().hex}"
    forest.fit(sample.select("label", array_to_vector("features").alias("vector"))).save(path)
    return RandomForestClassificationModel.load(path)  # without the training summary, which can't be sent to executors


def scan(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Findings of all texts with the forest's verdict: doc_id, text_hash, path, start (in characters), length, value,
    probability and is_secret. The value is the finding itself: show its place rather than it.

    ``docs`` has doc_id, source (the path) and text. ``labels`` are labelled findings: value, path, left, right and label;
    without them :func:`rule_label` labels the findings of ``docs`` that it can tell. Where labelled findings of both
    kinds are not at hand, the rule alone decides, and what it doesn't know counts as a secret.

    Null and empty texts have no findings, texts of any length are scanned whole; equal rows have their findings each; a probability at ``threshold`` is a secret; a null path is an empty one; no
    rows give no rows. Other columns are ignored.
    """
    found, _ = store(candidates(small_batches(docs)), "candidates")
    language = learn_language(docs)
    found, _ = store(describe(found, language), "described")
    if labels is None:
        model = fit(found.select("features", F.col("rule").alias("label")))
    else:
        model = fit(describe(labels, language).select("features", "label"))
    if model is None:
        out = found.withColumn("probability", F.coalesce(F.col("rule").cast("double"), F.lit(1.0)))
    else:
        out = model.transform(found.withColumn("vector", array_to_vector("features"))).withColumn(
            "probability", vector_to_array("probability")[1])
    return out.select("doc_id", "text_hash", "path", "start", F.length("value").cast("long").alias("length"), "value", "probability",
                      (F.col("probability") >= threshold).alias("is_secret"))


def _blank(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[pa.RecordBatch]:
    for part in batches:
        out = []
        for text, spans in zip(part.column("_text").to_pylist(), part.column("_spans").to_pylist()):
            if text is not None and spans:
                keep, at = [], 0
                for x in sorted(spans, key=lambda x: x["start"]):
                    if x["start"] >= at:
                        keep += [text[at : x["start"]], mark]
                    at = max(at, x["start"] + x["length"])  # one mark for findings that overlap
                text = "".join([*keep, text[at:]])
            out.append(text)
        own = part.drop_columns(["_text", "_spans"])
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(out, pa.string())], [*own.schema.names, "clean_text"])


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[secret]", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text_hash, n_secrets, clean_text, and the columns ``keep``) for each row of ``docs``: findings that are secrets are replaced by ``mark``."""
    spans = findings.where("is_secret").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "length")).alias("_spans"))
    spans, _ = store(spans.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("j"), "_spans"), "secrets")
    more, types = carried(docs, keep)
    d = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_h"), F.col("text").alias("_text"), *more)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # a merge join whatever the size: the plan is the same on small and large tables
    rows = d.join(spans.hint("merge"), d["_id"].eqNullSafe(F.col("i")) & (d["_h"] == F.col("j")), "left").select(
        "_id", "_h", *(f"c{i}" for i in range(len(keep))), F.greatest(F.size("_spans"), F.lit(0)).cast("long").alias("n_secrets"), "_text", "_spans")
    out = rows.mapInArrow(lambda it: _blank(it, mark), f"_id {kind}, _h long{types}, n_secrets long, clean_text string")
    return restored(out.withColumnRenamed("_id", "doc_id").withColumnRenamed("_h", "text_hash"), keep)
