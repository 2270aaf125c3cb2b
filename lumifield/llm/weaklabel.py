"""Quality classifier from overlapping heuristic labellers: EM label model, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumifield.functions.storage import store
from lumifield.llm.quality import counts
from lumifield.llm.words import Words, batch, hash_runs, mix, words

BUCKETS = 1 << 12
TRAIN_ROWS = 8_000  # documents that the scorer is fitted on
STEPS = 300
PRIOR_WORDS = 10

# labeller -> votes for a good (1) and a bad text (-1), as SQL over the counts; else it abstains
LABELLERS = {
    "symbols": ("n_symbols < 0.02 * n_words", "n_symbols > 0.3 * n_words"),
    "word_length": ("word_chars BETWEEN 4 * n_words AND 6.2 * n_words", "word_chars NOT BETWEEN 3 * n_words AND 7 * n_words"),
    "capitals": ("n_upper < 0.1 * word_chars", "n_upper > 0.5 * word_chars"),
    "marks": ("n_marks < 0.1 * n_words", "n_marks > 0.5 * n_words"),
    "repeats": ("n_repeat_words < 0.05 * n_words", "n_repeat_words > 0.3 * n_words"),
    "lines": ("n_dup_lines < 0.1 * n_lines", "n_dup_lines > 0.4 * n_lines"),
    "letters": ("n_bare < 0.05 * n_words", "n_bare > 0.2 * n_words"),
    "stutter": ("n_stutters < 0.02 * n_words", "n_stutters > 0.15 * n_words"),
}


def votes() -> list[Column]:
    """One column for each labeller; a text without words gets no vote, one of under 20 words only bad ones."""
    return [F.when(F.col("n_words") == 0, 0).when(F.expr(bad), -1).when(F.expr(good) & (F.col("n_words") >= 20), 1).otherwise(0).cast("int").alias(k)
            for k, (good, bad) in LABELLERS.items()]


@dataclass
class LabelModel:
    names: list[str]
    bad_vote: np.ndarray  # (labellers, 2): chance that a vote cast on a bad (0) or good (1) text says bad
    prior: float  # share of good texts

    @property
    def accuracy(self) -> np.ndarray:
        """(labellers, 2): chance that a vote cast on a bad (0) or good (1) text is right."""
        return np.c_[self.bad_vote[:, 0], 1 - self.bad_vote[:, 1]]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance that a text is good, for rows of votes; votes are independent given the truth, abstaining tells nothing."""
        bad, good = np.log(self.bad_vote), np.log1p(-self.bad_vote)
        up = np.where(votes == 1, good[:, 1] - good[:, 0], np.where(votes == -1, bad[:, 1] - bad[:, 0], 0.0))
        return 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + up.sum(1))))


def fit_labels(patterns: pd.DataFrame, names: list[str], rounds: int = 500) -> LabelModel:
    """EM over vote patterns (one row for each pattern that occurs, with its number n): 3^labellers rows at most.

    Starts from texts without a bad vote being good nine times in ten, those with one bad. A labeller says bad at
    least as often on bad texts as on good ones, so that none is turned round; two votes of each kind are added to its counts.
    """
    v, n = patterns[names].to_numpy().reshape(-1, len(names)), patterns["n"].to_numpy(float)
    model = LabelModel(names, np.tile([0.6, 0.1], (len(names), 1)), 0.8)
    p = np.where((v == -1).any(1), 0.1, 0.9)
    for _ in range(rounds if len(v) else 0):
        new = np.empty_like(model.bad_vote)
        for side, weight in ((0, n * (1 - p)), (1, n * p)):
            new[:, side] = ((weight[:, None] * (v == -1)).sum(0) + 2) / ((weight[:, None] * (v != 0)).sum(0) + 4)
        new[:, 0] = np.maximum(new[:, 0], new[:, 1])
        prior = float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98))
        moved = np.abs(new - model.bad_vote).max() + abs(prior - model.prior)
        model = LabelModel(names, new, prior)
        p = model.posterior(v)
        if moved < 1e-9:
            break
    return model


def _slots(w: Words, buckets: int) -> np.ndarray:
    """Buckets of the features of each word: (features, words). The word, its last three bytes, its shape, word and shape before."""
    b = w.data
    first, last = b[w.start], b[w.end - 1]
    kind = np.zeros(256, np.uint64)
    kind[[*range(97, 123), *range(128, 256)]] = 1
    kind[65:91] = 2
    kind[48:58] = 3
    mark = np.where(kind[last] == 0, last.astype(np.uint64) + np.uint64(16), kind[last])
    middle = kind[b[(w.start + w.end - 1) // 2]]
    size = np.minimum(w.end - w.start, 24).astype(np.uint64) // np.uint64(3)
    shape = kind[first] | middle << np.uint64(4) | mark << np.uint64(8) | size << np.uint64(20)
    tail = hash_runs(b, np.maximum(w.start, w.end - 3), w.end, lower=True)
    same = np.zeros(len(w.hash), np.uint64)
    same[1:] = w.hash[1:] == w.hash[:-1]
    rows = [w.hash, mix(tail), mix(shape + np.uint64(7)), mix(mark + np.uint64(1 << 40)), mix(same + np.uint64(1 << 41))]
    return np.stack([(mix(r + np.uint64(i)) % np.uint64(buckets)).astype(np.int64) for i, r in enumerate(rows)])


def _vectors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for w in words(part.column("_text")):
            slots, n = _slots(w, buckets), len(w.upto) - 1
            both, times = np.unique((w.text[None, :] * buckets + slots).ravel(), return_counts=True)
            row = both // buckets
            value = times / np.maximum(np.diff(w.upto), 1)[row]
            off = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            yield batch(good=part.column("good").slice(w.first, n), slots=pa.ListArray.from_arrays(off, pa.array((both % buckets).astype(np.int32))),
                        values=pa.ListArray.from_arrays(off, pa.array(value.astype(np.float32))))


def _train(batches: Iterator[pa.RecordBatch], buckets: int, steps: int) -> Iterator[pa.RecordBatch]:
    """Logistic regression on soft labels; both classes weigh alike; Adam on all rows of the sample at once."""
    goods, slots, values, sizes = [], [], [], []
    for part in batches:
        goods.append(np.asarray(part.column("good")))
        slots.append(np.asarray(part.column("slots").flatten()))
        values.append(np.asarray(part.column("values").flatten(), np.float64))
        sizes.append(np.diff(np.asarray(part.column("slots").offsets)))
    weight, bias = np.zeros(buckets), 0.0
    if goods:
        y, s, v, n = map(np.concatenate, (goods, slots, values, sizes))
        row = np.repeat(np.arange(len(y)), n)
        each = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
        each, goal = each / each.sum(), (y / max(y.sum(), 1e-9)) / each
        m, u = np.zeros(buckets + 1), np.zeros(buckets + 1)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weight[s] * v, len(y)) + bias, -30, 30)))
            err = each * (p - goal)
            g = np.r_[np.bincount(s, err[row] * v, buckets) + 1e-5 * weight, err.sum()]
            m, u = 0.9 * m + 0.1 * g, 0.999 * u + 0.001 * g * g
            move = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.999**t)) + 1e-8)
            weight, bias = weight - move[:-1], bias - move[-1]
    yield batch(weights=pa.array([np.r_[weight, bias]]))


@dataclass
class Scorer:
    weight: np.ndarray
    bias: float
    prior: float = 0.5  # score of a text that tells nothing; it counts as PRIOR_WORDS words

    def score(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for w in words(part.column("_text")):
                n = len(w.upto) - 1
                each = self.weight[_slots(w, len(self.weight))].sum(0)
                size = np.diff(w.upto)
                own_part = np.bincount(w.text, each, n) + size * self.bias
                total = (own_part + PRIOR_WORDS * np.log(self.prior / (1 - self.prior))) / (size + PRIOR_WORDS)
                own = part.slice(w.first, n).drop_columns(["_text"])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], [*own.schema.names, "score"])


def fit_scorer(labelled: DataFrame, rows: int = TRAIN_ROWS, buckets: int = BUCKETS, steps: int = STEPS) -> Scorer:
    """A scorer from ``labelled`` (text, good: chance that the text is good), fitted on the ``rows`` texts of least hash."""
    sample = labelled.where("text IS NOT NULL AND good IS NOT NULL").select(F.xxhash64("text").alias("o"), F.col("good").cast("double"), F.col("text").alias("_text"))
    chosen = sample.select("o").distinct().orderBy("o").limit(rows)
    sample = sample.join(F.broadcast(chosen), "o").dropDuplicates(["o"]).select("o", "good", "_text")
    vectors = sample.mapInArrow(lambda it: _vectors(it, buckets), "good double, slots array<int>, values array<float>")
    vectors, _ = store(vectors, "vectors")
    got = vectors.repartition(1).sortWithinPartitions("good", F.xxhash64("slots", "values")).mapInArrow(
        lambda it: _train(it, buckets, steps), "weights array<double>").first()[0]
    return Scorer(np.array(got[:-1]), float(got[-1]))


def classify(docs: DataFrame, rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """Quality of each document: doc_id, n_words, the labellers' votes, posterior, score and kept.

    ``docs`` has doc_id, lang, source and text. Votes of all rows are counted by pattern; EM on the patterns estimates how far
    each labeller is right; the posterior of a document's pattern labels it; a linear scorer on hashed words and shapes is
    fitted on the posteriors of a bounded sample (``rows`` different documents of five words or more, those of least hash), and scores all texts. A document is kept if its score is at least ``threshold``.

    Null or empty texts and those without a word get no votes, score 0 and are not kept; texts of any length are scored whole. Equal rows get equal results, ties
    of hashes in the sample go by doc_id. A null doc_id is kept as
    it is. No rows give no rows. Other columns are ignored.
    """
    names = list(LABELLERS)
    d = docs.select("doc_id", "lang", "source", "text")
    voted = counts(d.withColumn("doc_id", F.struct("doc_id", F.xxhash64("doc_id", "text").alias("h")))).select("doc_id.*", "n_words", *votes())
    voted, n = store(voted, "votes")
    if not n:
        return voted.select("doc_id", "n_words", *names, F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    # 3^labellers patterns at most
    patterns = voted.where("n_words > 0").groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).toPandas()
    model = fit_labels(patterns, names)
    patterns["posterior"] = model.posterior(patterns[names].to_numpy()) if len(patterns) else []
    table = docs.sparkSession.createDataFrame(
        list(patterns[[*names, "posterior"]].itertuples(index=False, name=None)), ", ".join([*(f"{k} int" for k in names), "posterior double"]))
    voted = voted.join(F.broadcast(table), names, "left").withColumn("posterior", F.coalesce("posterior", F.lit(0.0)))
    keyed = d.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    some = voted.where("n_words >= 5").select(F.col("doc_id").alias("i"), F.col("h").alias("j"), F.col("posterior").alias("good")).distinct().orderBy(
        F.xxhash64("j"), "i").limit(rows)  # equal rows count once before the sample is cut
    some, _ = store(some, "sample")
    labelled = keyed.join(F.broadcast(some), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j"))).select("text", "good")
    scorer = fit_scorer(labelled, rows)
    scorer.prior = model.prior
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = keyed.select(F.col("doc_id").alias("i"), F.col("h").alias("j"), F.col("text").alias("_text")).mapInArrow(
        lambda it: scorer.score(it), f"i {kind}, j long, score double").distinct()
    out = voted.join(scored, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j")))
    score = F.when(F.col("n_words") > 0, F.col("score")).otherwise(0.0)
    return out.select("doc_id", "n_words", *names, "posterior", score.alias("score"), (score >= threshold).alias("kept"))
