"""Limits and verdicts of the quality rules, computed again from the texts without sketches' tables."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumifield.llm import quality
from tests.llm import brute
from tests.llm.test_documents import SCHEMA, SF, awkward

RATES = {"mean_chars": (0.3, True), "symbol_rate": (0.02, False), "mark_rate": (0.05, False), "upper_rate": (0.02, False),
         "dup_line_rate": (0.08, False), "repeat_rate": (0.05, False), "stutter_rate": (0.03, False)}


def metrics(text):
    n, chars, symbols, dup, repeat, failed = brute.base_counts(text)
    w = brute.split(text)
    lines = sum(bool(brute.split(x)) for x in (text or "").split("\n"))
    if failed:
        return None
    return {"mean_chars": chars / n, "symbol_rate": symbols / n, "mark_rate": sum(c in "!?" for c in text) / n,
            "upper_rate": sum("A" <= c <= "Z" for c in text) / max(chars, 1), "dup_line_rate": dup / max(lines, 1), "repeat_rate": repeat / n,
            "stutter_rate": sum(a == b for a, b in zip(w, w[1:])) / n}


def quartiles(values):
    """From bins of two per cent: the middle of the bin in which the wanted share is reached."""
    bins = sorted(math.floor(math.log1p(v / 1e-3) / math.log(1.02)) for v in values)
    at = lambda q: bins[max(math.ceil(q * len(bins)), 1) - 1]
    return [0.0 if b == 0 else (math.exp((b + 0.5) * math.log(1.02)) - 1) * 1e-3 for b in map(at, (0.25, 0.5, 0.75))]


def plain(rows, min_rows, fence=6.0):
    """{row number: failed metrics, or None where the base failed}."""
    got = [metrics(t) for _, _, t in rows]
    groups = defaultdict(lambda: defaultdict(list))
    for (lang, source, _), m in zip(rows, got):
        for k, v in (m or {}).items():
            for g in (("own", lang, source), ("lang", lang), ("all",)):
                groups[g][k].append(v)
    out = []
    for (lang, source, _), m in zip(rows, got):
        if m is None:
            out.append(None)
            continue
        failed = []
        for k, (least, both) in RATES.items():
            own, mid, every = (groups[g][k] for g in (("own", lang, source), ("lang", lang), ("all",)))
            q1, q2, q3 = quartiles(own if len(own) >= min_rows else mid if len(mid) >= min_rows else every)
            if m[k] > q2 + fence * max(q2 - q1, least) or (both and m[k] < q2 - fence * max(q3 - q2, least)):
                failed.append(k)
        out.append(failed)
    return out


@pytest.mark.parametrize("data, min_rows, fence", [("given", 3, 2.0), ("given", 20, 1.0), ("given", 200, 6.0), ("awkward", 3, 1.0)])
def test_limits_and_verdicts(spark, data, min_rows, fence):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if data == "given" else spark.createDataFrame(awkward(), SCHEMA)
    docs = docs.withColumn("doc_id", F.monotonically_increasing_id()).cache()
    rows = docs.collect()
    want = {r.doc_id: f for r, f in zip(rows, plain([(r.lang, r.source, r.text) for r in rows], min_rows, fence))}
    got = quality.quality_rules(docs, fence=fence, min_rows=min_rows).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.base_failed, r.kept, r.failed) == (want[r.doc_id] is None, want[r.doc_id] == [], want[r.doc_id] or [])
    assert data == "awkward" or fence > 2 or any(want.values())
