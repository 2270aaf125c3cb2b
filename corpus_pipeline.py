"""A corpus from documents to packed windows, in five stages that each call one operator of ``lumifield.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumifield.functions.storage import store
from lumifield.llm import langid, linededup, minhash, packing, secrets

MIN_SCORE = 0.25  # share of a text's n-grams that its language has to hold


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as x0, x1, ...: names of the caller's columns meet no name that an operator or a stage gives."""
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(_others(docs))])


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _carried(docs: DataFrame) -> list[str]:
    return [f"x{i}" for i in range(len(_others(docs)))]


def _back(docs: DataFrame, out: DataFrame, text: str = "text") -> DataFrame:
    """``out`` in the columns of ``docs``; where the text is a new one, n_chars, if there is such a column, is its length (null for a null text)."""
    source = {"doc_id": F.col("doc_id"), "text": F.col(text)} | {c: F.col(f"x{i}") for i, c in enumerate(_others(docs))}
    if text != "text" and "n_chars" in source:
        source["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*[source[c].alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language; those without a letter or far from all languages go. Learns from every language given.

    Null and empty texts have no letter and go; texts of any length count whole; equal rows are judged alike; ties between
    languages go to the first name; an empty table stays empty. Where no row names a language, nothing can be told and all go.
    """
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], "text")
    found = langid.identify(named, langid.learn(docs.select("text", "lang")))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete common blocks from later documents; documents of which nothing is left go.

    Null and empty texts have no lines and stay; equal rows are one document and lose the same lines; a null doc_id comes
    first in order; long texts are aligned whole; an empty table stays empty.
    """
    out = linededup.dedup_lines(_plain(docs), keep=_carried(docs))
    left = out.where((F.col("n_deleted") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return _back(docs, left, "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, that of least doc_id (null last), then of least text hash: five words a
    shingle, similarity 0.8. Of rows that are equal in doc_id and text one stays, whichever; texts without words, null ones
    too, are in no group. Long texts are compared whole; an empty table stays empty."""
    plain = _plain(docs).withColumn("row_hash", F.xxhash64("doc_id", "text"))
    groups = minhash.near_duplicates(plain, size=5, percent=80, bands=44, rows=5, one=True)
    gone, _ = store(groups.where("NOT stays").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "gone")
    left = plain.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("row_hash") == F.col("gone_hash")), "left_anti")
    return _back(docs, left.dropDuplicates(["doc_id", "row_hash"]))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays.

    Null and empty texts stay as they are, repeated rows are all cleaned, long texts are scanned whole, overlapping findings
    leave one mark; an empty table stays empty.
    """
    out = secrets.redact(_plain(docs), secrets.scan(docs), keep=_carried(docs))
    return _back(docs, out, "clean_text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ids, one row per piece of a document.

    Null and empty texts are the closing id alone, equal rows are packed each, long texts are cut freely, other columns are
    left out; an empty table gives no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

ORACLE_SQL = None  # language filters, sketches, a forest and a tokenizer; the tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
