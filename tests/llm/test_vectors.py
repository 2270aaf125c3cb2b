"""Top-k search against a full matrix product."""

import numpy as np
import pytest

from lumifield.llm import topk

SF = "/root/testdata/sf0.001"


def best(vectors, asked, k):
    out = []
    for q in sorted(asked):
        near = sorted((-sum(a * b for a, b in zip(v, vectors[q])), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return out


def search(spark, vectors, k=5, block=topk.BLOCK):
    df = spark.createDataFrame(list(vectors.items()), "id long, vec array<long>").repartition(3)
    return sorted(map(tuple, topk.top_k(df.where("id % 5 = 0"), df, k, block).collect()))


@pytest.mark.parametrize("seed, n, dims, spread, block", [(0, 300, 16, 50, 64), (1, 500, 64, 200, 10_000), (2, 80, 3, 1, 16), (3, 60, 5, 0, 16), (4, 400, 8, 3, 100)])
def test_random_vectors(spark, seed, n, dims, spread, block):
    rng = np.random.default_rng(seed)
    vectors = {i: [int(x) for x in rng.integers(-spread, spread + 1, dims)] for i in range(n)}  # small spreads make many ties
    assert search(spark, vectors, 5, block) == best(vectors, [i for i in vectors if i % 5 == 0], 5)


def test_clusters_stop_early_and_stay_exact():
    rng = np.random.default_rng(9)
    centre = rng.normal(0, 60, (10, 64))
    v = np.rint(centre[rng.integers(0, 10, 4000)] + rng.normal(0, 10, (4000, 64))).astype(np.int64)
    index = topk.ImpactIndex(np.arange(4000), v)
    for q in range(0, 4000, 400):
        rows, score = index.search(v[q], 5, q)
        s = v @ v[q]
        s[q] = -(2**60)
        want = np.lexsort((np.arange(4000), -s))[:5]
        assert rows.tolist() == want.tolist() and score.tolist() == s[want].tolist()


def test_few_and_odd_vectors(spark):
    vectors = {0: [1, 2], 5: [3], 10: [0, 0], 11: [-4, 7], 12: [], 15: [], 20: [9, 9, 9]}
    assert search(spark, vectors) == best(vectors, [0, 5, 10, 15, 20], 5)
    assert search(spark, {}) == []


def test_integers_leave_out_unsound_vectors(spark):
    rows = [(0, [0.5, -0.001]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [1.0, 0.999])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.integers(df, "vec_id", "embedding").collect())) == [(0, [128, -1]), (5, [256, 255])]


def test_query_on_given_vectors(spark):
    from lumifield.llm import queries

    v = {r.vec_id: [int(np.floor(256 * float(x))) for x in r.embedding] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = sorted(map(tuple, queries.op8_topk_search(spark, SF).collect()))
    assert got == best(v, [i for i in v if i % 50 == 0], 5)
