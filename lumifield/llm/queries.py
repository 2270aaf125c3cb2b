"""Registered queries of the numbered operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumifield.llm import langid, lexical, linededup, merkle, minhash, packing, pieces, pii, quality, secrets, topk, weaklabel
from lumifield.llm.oracles import ORACLES  # noqa: F401
from lumifield.llm.substring import dedup_substrings


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed", ",").alias("failed"))


def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by place; the values themselves are not returned."""
    return secrets.scan(_table(spark, sf, "documents")).select(
        "doc_id", "start", "length", F.round("probability", 6).alias("probability"), "is_secret")


def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return weaklabel.classify(_table(spark, sf, "documents")).select(
        "doc_id", "n_words", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), "kept")


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"]).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op5_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf, "documents")
    ids = pieces.encode(docs.select("doc_id", "text", F.xxhash64(F.replace(F.coalesce("text", F.lit("")), F.lit("\u2581"), F.lit(" "))).alias("was")),
                        model, ["doc_id", "was"])
    back = pieces.decode_ids(ids.withColumn("ids_crc32", F.crc32("ids")).withColumn("n_ids", F.floor(F.length("ids") / 4)),
                             model, ["doc_id", "was", "n_ids", "ids_crc32"])
    return back.select("doc_id", "n_ids", "ids_crc32", (F.xxhash64("decoded") == F.col("was")).alias("round_trip"))


def op6_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf, "documents")).drop("text_hash")


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf, "documents")).select(
        "doc_id", "n_lines", "n_deleted", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    vectors = topk.integers(_table(spark, sf, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors.where("id % 50 = 0"), vectors)


def held_out(key: str = "doc_id"):
    """True for the quarter of ids that language ID doesn't learn from; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of all documents. A null id has no checksum: it is not held out, and nothing is learned from it."""
    docs = _table(spark, sf, "documents")
    filters = langid.learn(docs.where(~held_out()))
    return langid.identify(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), filters).drop("text")


def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup_substrings(_table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and hash of the spans of known forms; all spans, those found by their contexts too."""
    found = pii.find(_table(spark, sf, "documents"))
    known = F.filter("spans", lambda s: s["known"])
    of = lambda k: F.filter("spans", lambda s: s["known"] & (s["kind"] == k))
    n = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *n, F.sha2(pii.written(known).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: ~s["known"])).cast("long").alias("n_found"))


def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; rows whose id's checksum 7 divides are verified with one more n_chars than they have."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0,
                     merkle.leaf([more if c == "n_chars" else F.col(c) for c in merkle.FIELDS]))
    out = merkle.manifest(_table(spark, sf, "documents"), tampered=changed)
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_packing": op4_packing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_topk_search": op8_topk_search,
    "op9_language_id": op9_language_id,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_pii": op11_pii,
    "op12_lexical_search": op12_lexical_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}
