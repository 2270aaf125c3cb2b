"""Ranked lexical search against scores computed plainly, term by term."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lumifield.llm import lexical
from tests.llm.brute import LOWER
from tests.llm.test_documents import SCHEMA, SF, awkward, copies

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, c, sum(c.values())) for d, c in bags if c]
    df, docs_n, length = Counter(t for _, c, _ in bags for t in c), len(bags), sum(n for *_, n in bags)
    asked, out = {}, []
    for i, text in items:
        asked.setdefault(i, Counter()).update(terms(text))
    for i, want in asked.items():
        scores = []
        for d, c, n in bags:
            m = 25 + 75 * n * docs_n // length
            s = sum(q * math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in want.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "One two ONE 日本語 été x"), (2, None), (3, "..."), (4, "same words same"), (5, "jac"), (None, "words 12 token"), (4, "tail"), (6, "one two" * 3)]


@pytest.mark.parametrize("data", ["given", "awkward", "copies", "empty"])
def test_search(spark, data):
    if data == "given":
        docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    else:
        docs = spark.createDataFrame({"awkward": awkward(), "copies": copies(), "empty": []}[data], SCHEMA)
        words = [(10 + i, " ".join(terms(r[1])[:9])) for i, r in enumerate(awkward() + copies()[:9])]
        items = spark.createDataFrame(ITEMS + words, "item_id int, text string").selectExpr("*", "1 AS n", "'t' AS term")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    for sizes in ({}, {"pairs": 20, "tile_items": 3, "tile_columns": 5}):
        got = lexical.search(docs.repartition(5), items, **sizes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert want or data == "empty"


def test_no_items(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    assert lexical.search(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_tiles_are_exact_up_to_the_largest_weights():
    rng = np.random.default_rng(8)
    item, term = (v.ravel() for v in np.meshgrid(np.arange(6), np.arange(40), indexing="ij"))
    weight = rng.integers(1, 30 * 10**9, len(item))  # a product of the largest ones is 3e16, over 2^53
    tiles = lexical._tiles(item, term, weight, 4, 16)
    doc, has = (v.ravel() for v in np.meshgrid(np.arange(9), np.arange(40), indexing="ij"))
    impact = rng.integers(0, lexical.IMPACT, len(doc))
    want = np.zeros((9, 6), object)
    for d, t, v in zip(doc.tolist(), has.tolist(), impact.tolist()):
        for i in range(6):
            want[d, i] += int(weight[(item == i) & (term == t)][0]) * v
    got = np.concatenate([x.scores(doc, has, impact, 9, x.weights) for x in tiles], axis=1)
    assert (got == want).all()
    for x in tiles:
        assert all(x.weights(a, b).max(axis=1, initial=0).sum() * lexical.IMPACT < lexical.EXACT for a, b in x.tiles)


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical, "hash_runs", lambda b, s, e: (e - s).astype(np.uint64) % np.uint64(2))
    names = ["a", "bb", "ccc", "dddddddddddddddddd", "dddddddddddddddddx", "cc"]
    low = np.frombuffer("xccdddddddddddddddddxbba".encode(), np.uint8)
    start, end = np.array([0, 1, 3, 21, 23, 3]), np.array([1, 3, 21, 23, 24, 20])
    assert lexical.Vocabulary(names).find(low, start, end).tolist() == [-1, 5, 4, 1, 0, -1]
