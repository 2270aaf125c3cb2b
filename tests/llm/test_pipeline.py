"""The corpus pipeline: each stage on awkward rows, and the whole on the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumifield.llm import queries
from tests.llm import brute
from tests.llm.test_documents import SCHEMA, SF, awkward, copies, sentence

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("data", ["awkward", "copies", "empty"])
def test_stages(spark, data):
    docs = spark.createDataFrame({"awkward": awkward(), "copies": copies(), "empty": []}[data], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns and docs.count() <= before.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


OWN = "_id _h _i _j kept_text clean_text text_hash n_lines stays kept component_id gone_id row_hash x0 x1 c0 lang_pred n_secrets"


def test_columns_named_as_the_stages_own_are_carried(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars", *[
        F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in OWN.split()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns
        got = docs.collect()
        assert got and all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in got for c in OWN.split())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(got)


def test_near_copies_leave_one_document_of_each_group(spark):
    docs = spark.createDataFrame(awkward() + copies(), SCHEMA).where("doc_id IS NOT NULL")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept >= {d for d, _, c in brute.near_groups(rows, 5, 80) if d == c}


def test_one_row_of_each_group_stays(spark):
    rows, rng = [(r[0], r[1]) for r in copies()], np.random.default_rng(3)
    nulls = [[sentence(500 + k, 90), sentence(500 + k, 90) + " tail"] for k in range(3)]  # groups without an id
    rows += [(None, t) for two in nulls for t in two] + [(7, rows[7][1])] * 2 + [(900, sentence(600, 50))] * 3
    rows += [(901, sentence(601, 90)), (901, sentence(601, 90) + " tail"), (902, None), (903, "")]
    rng.shuffle(order := list(range(len(rows))))
    docs = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string")
    named = {d: c for d, _, c in brute.near_groups([r for r in rows if r[0] is not None], 5, 80)}
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert sorted(d for d, _ in got if d is not None) == sorted({d for d, c in named.items() if d == c})
    left = [t for d, t in got if d is None]
    assert len(left) == 3 and all(len(set(left) & set(two)) == 1 for two in nulls)


def test_pipeline_packs_what_the_stages_kept(spark):
    docs, stages = spark.read.parquet(f"{SF}/documents.parquet"), corpus_pipeline.STAGES
    for _, stage in stages[:-1]:
        docs = stage(spark, docs, SF).cache()
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())
    assert not docs.where("text RLIKE '(?i)token = \"[0-9a-f]{40}'").count()
    assert docs.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    res = con.execute(queries.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in res.fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == want


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
