"""The Merkle manifest against a tree built plainly in memory."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumifield.llm import merkle
from tests.llm.test_documents import SCHEMA, SF, awkward


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r):
    return sha("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in merkle.FIELDS))


def climb(nodes, paths, fanout):
    """The root of ``nodes``; each of ``paths`` gets the siblings on its way, as (before, after)."""
    where = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(where):
            run = nodes[k - k % fanout : k - k % fanout + fanout]
            paths[i].append(("".join(run[: k % fanout]), "".join(run[k % fanout + 1 :])))
        nodes = [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
        where = [k // fanout for k in where]
    return nodes[0]


def plain(rows, fanout):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    langs = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    roots, out = [], []
    for k in langs:
        mine = sorted(by[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        paths = [[] for _ in mine]
        roots.append(climb([leaf(r) for r in mine], paths, fanout))
        out.append(list(zip(mine, paths)))
    heads = [[] for _ in roots]
    root = climb(roots, heads, fanout) if roots else None
    return sorted((repr(r["doc_id"]), leaf(r), roots[i], root, tuple(p + heads[i])) for i, group in enumerate(out) for r, p in group)


@pytest.mark.parametrize("fanout", [2, 3, 5])
@pytest.mark.parametrize("data", ["given", "awkward", "one", "empty"])
def test_manifest(spark, data, fanout):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if data == "given" else spark.createDataFrame(
        {"awkward": awkward(), "one": awkward()[:1], "empty": []}[data], SCHEMA)
    got = merkle.manifest(docs, fanout=fanout, tampered=F.lit("x")).collect()
    want = plain([r.asDict() for r in docs.collect()], fanout)
    assert sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.proof)) for r in got) == want
    assert all(r.tampered == "x" for r in got)


def test_proofs_lead_to_the_root_and_show_changes(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    changed = F.when(F.col("doc_id") % 3 == 0, merkle.leaf([F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]))
    out = merkle.manifest(docs, tampered=changed)
    got = out.select("doc_id", "root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("to"), merkle.proof_hash(F.col("proof")).alias("p"), "proof").collect()
    for r in got:
        assert (r.to == r.root) == (r.doc_id is None or r.doc_id % 3 != 0)
        assert r.p == sha("".join(s.before + s.after for s in r.proof))


def test_query_tampers_with_a_seventh_of_the_ids(spark):
    from lumifield.llm import queries

    got = queries.op13_merkle_manifest(spark, SF).collect()
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in got) and len(got) == 200
