"""Quality rules with thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumifield.functions.storage import store
from lumifield.llm.words import batch, covered, lines, repeated, words

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
GROWTH = 1.02  # ratio of neighbouring sketch bins: values are kept within 1 %
UNIT = 1e-3  # below this a value counts as about zero
FENCE = 6.0  # width of the accepted range, in quartile distances
MIN_ROWS = 200  # groups with fewer rows take the thresholds of their language, then of all rows

# metric -> (SQL over the counts, least quartile distance, is there a lower limit too)
METRICS = {
    "mean_chars": ("word_chars / n_words", 0.3, True),
    "symbol_rate": ("n_symbols / n_words", 0.02, False),
    "mark_rate": ("n_marks / n_words", 0.05, False),
    "upper_rate": ("n_upper / greatest(word_chars, 1)", 0.02, False),
    "dup_line_rate": ("n_dup_lines / greatest(n_lines, 1)", 0.08, False),
    "repeat_rate": ("n_repeat_words / n_words", 0.05, False),
    "stutter_rate": ("n_stutters / n_words", 0.03, False),
}


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def _counts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    lead = np.ones(256, bool)
    lead[0x80:0xC0] = False  # bytes that continue a character
    letters = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
    symbols, marks, upper = _table(SYMBOLS), _table(b"!?"), _table(bytes(range(65, 91)))
    for part in batches:
        for w in words(part.column("_text")):
            texts = w.last - w.first
            per_text = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][w.ends])
            length = np.diff(np.r_[0, np.cumsum(lead[w.data])][np.c_[w.start, w.end]], axis=1)[:, 0]
            by_word = lambda v: np.bincount(w.text, v, texts).astype(np.int64)
            s, e, h = lines(w)
            inside = np.searchsorted(w.start, e) > np.searchsorted(w.start, s)  # lines with a word
            line_text = np.searchsorted(w.ends, s[inside], "right") - 1
            again = repeated(line_text, h[inside])[1]
            at, seq = w.windows(window)
            twice = repeated(w.text[at], seq)[0]
            busy = covered(len(w.hash), at[twice], window)
            stutter = np.zeros(len(w.hash), bool)  # words equal to the word before them in the text
            stutter[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
            letter = np.r_[0, np.cumsum(letters[w.data])]
            bare = letter[w.end] == letter[w.start]  # words without a letter
            own = part.slice(w.first, texts)
            yield batch(
                _id=own.column("_id"), lang=own.column("lang"), source=own.column("source"), n_words=np.diff(w.upto),
                word_chars=by_word(length), n_symbols=per_text(symbols[w.data]),
                n_dup_lines=np.bincount(line_text[again], minlength=texts).astype(np.int64),
                n_repeat_words=by_word(busy), n_lines=np.bincount(line_text, minlength=texts).astype(np.int64),
                n_marks=per_text(marks[w.data]), n_upper=per_text(upper[w.data]), n_stutters=by_word(stutter), n_bare=by_word(bare))


def counts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Counts of each text: words, their code points, symbols, repeated lines and words in repeated windows."""
    d = docs.select(F.col("doc_id").alias("_id"), F.col("lang").cast("string").alias("lang"),
                    F.col("source").cast("string").alias("source"), F.col("text").alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(
        lambda it: _counts(it, window),
        f"_id {kind}, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, n_lines long, n_marks long, n_upper long, n_stutters long, n_bare long").withColumnRenamed("_id", "doc_id")


def sketch(rows: DataFrame, by: list[str], value: Column | str) -> DataFrame:
    """Quantile sketch of each group: counts of values in bins of steady relative width.

    Sketches of parts are merged by adding the counts; a group has some hundred bins at most, however
    many rows it has, and they are counted before the shuffle.
    """
    value = F.col(value) if isinstance(value, str) else value
    bin_ = F.floor(F.log1p(value / UNIT) / float(np.log(GROWTH)))
    return rows.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], **at: float) -> DataFrame:
    """Quantiles of each sketch as columns, with ``rows``, the number of values."""
    run = Window.partitionBy(*by).orderBy("bin")
    upto = sketches.withColumn("_upto", F.sum("n").over(run)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    value = (F.exp((F.col("bin") + 0.5) * float(np.log(GROWTH))) - 1) * UNIT
    value = F.when(F.col("bin") == 0, 0.0).otherwise(value)
    return upto.groupBy(*by).agg(
        F.first("_all").alias("rows"),
        *[F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1.0), q * F.col("_all")), value)).alias(k) for k, q in at.items()])


def thresholds(passed: DataFrame, fence: float = FENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, limits): for each group present a map of metric to its least and greatest accepted value."""
    long = passed.select("lang", "source", F.explode(F.create_map(*[
        x for k, (sql, _, _) in METRICS.items() for x in (F.lit(k), F.expr(sql).cast("double"))])).alias("metric", "value"))
    fine, _ = store(sketch(long, ["lang", "source", "metric"], "value"), "sketches")
    q = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    levels = [quantiles(fine, ["lang", "source", "metric"], **q)]
    for by in (["lang", "metric"], ["metric"]):
        levels.append(quantiles(merge(fine, by), by, **q))
    own = levels[0].select("lang", "source", "metric", F.struct("rows", *q).alias("a"))
    lang = levels[1].select(F.col("lang").alias("l"), F.col("metric").alias("m"), F.struct("rows", *q).alias("b"))
    every = levels[2].select(F.col("metric").alias("k"), F.struct("rows", *q).alias("c"))
    t = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m"))).join(every, F.col("metric") == F.col("k"))
    use = F.when(F.col("a.rows") >= min_rows, F.col("a")).when(F.col("b.rows") >= min_rows, F.col("b")).otherwise(F.col("c"))
    t = t.withColumn("u", use)
    floor = F.create_map(*[x for k, (_, f, _) in METRICS.items() for x in (F.lit(k), F.lit(f))])[F.col("metric")]
    both = F.create_map(*[x for k, (_, _, b) in METRICS.items() for x in (F.lit(k), F.lit(b))])[F.col("metric")]
    # each side is scaled by the quartile towards the other side, which bad rows of this side don't widen
    high = F.col("u.q2") + fence * F.greatest(F.col("u.q2") - F.col("u.q1"), floor)
    low = F.when(both, F.col("u.q2") - fence * F.greatest(F.col("u.q3") - F.col("u.q2"), floor)).otherwise(F.lit(float("-inf")))
    return t.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(
        F.struct("metric", F.struct(low.alias("low"), high.alias("high"))))).alias("limits"))


def quality_rules(docs: DataFrame, window: int = WINDOW, fence: float = FENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """Keep documents whose metrics lie within limits learned from their language and source.

    ``docs`` has doc_id, lang, source and text. Returns one row per row: doc_id, lang, source, the counts of :func:`counts`,
    base_failed (fewer than 20 words, or over 30 % of them in repeated windows), kept, and failed (metrics
    out of range). A limit is the median plus ``fence`` quartile distances; quartiles come from sketches of all
    rows that passed the base rules, merged from (language, source) to language to all for groups under ``min_rows``.

    Null or empty texts have no words and fail the base; texts of any length are counted whole; values at a limit are within it. A null language or source is a group of its own. Equal rows
    count each. With no rows that pass, nothing is judged beyond the base. Other columns are ignored.
    """
    rows, _ = store(counts(docs, window), "counts")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    limits = thresholds(rows.where("NOT base_failed"), fence, min_rows).select(
        F.col("lang").alias("_l"), F.col("source").alias("_s"), "limits")
    judged = rows.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    out = [F.when((F.expr(sql) < F.col("limits")[k]["low"]) | (F.expr(sql) > F.col("limits")[k]["high"]), F.lit(k))
           for k, (sql, _, _) in METRICS.items()]
    failed = F.when(F.col("base_failed") | F.col("limits").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*out)))
    return judged.withColumn("failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("_l", "_s", "limits")
