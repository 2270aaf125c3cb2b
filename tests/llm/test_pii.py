"""Personal data against the plain expressions and a plain graph of patterns and values."""

import hashlib
import re
from collections import defaultdict

import pytest

from lumifield.llm import pii, queries
from tests.llm.test_documents import SCHEMA, SF, awkward

SPACE = " \t\n\x0b\f\r"
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    """(start, kind, end) in order."""
    out = []
    for k, form in enumerate(PLAIN):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(digits) <= 19 and checksum(digits)
                    or k == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def pieces(text, spans):
    """Each span's last two words before it, since the span before of its list, and first word after it."""
    for n, (a, z) in enumerate(spans):
        before = text[(spans[n - 1][1] if n else 0) : a][-200:].lower()
        after = text[z : spans[n + 1][0] if n + 1 < len(spans) else len(text)][:200].lower()
        left = [w for w in re.split(rf"[{SPACE}]+", before) if w]
        right = [w for w in re.split(rf"[{SPACE}]+", after) if w]
        yield [""] * (2 - len(left)) + [w[-100:] for w in left[-2:]], (right or [""])[0][:100]


def found(texts, rounds=3, support=5, sure=0.75, accept=0.85):
    rows = []
    for i, t in enumerate(texts):
        t, known = t or "", base(t)
        for k, form in enumerate(PLAIN):
            every = [m.span() for m in re.finditer(form, t) if k != 2 or 14 <= len(re.sub("[^0-9]", "", m[0])) <= 19]
            for (a, z), (left, right) in zip(every, pieces(t, every)):
                if (a, k, z) in known:
                    rows.append((i, a, z, k, t[a:z].lower(), left, right))
        every = [m.span() for m in re.finditer(rf"[^{SPACE}]+", t) if "@" in m[0] or re.search(r"[(\[]at[)\]]", m[0]) or len(re.findall("[0-9]", m[0])) >= 4]
        for (a, z), (left, right) in zip(every, pieces(t, every)):
            word = t[a:z]
            a += len(word) - len(word.lstrip("\"'([{<"))
            word = word.lstrip("\"'([{<").rstrip(".,;:!?)]}>\"'")
            z = a + len(word)
            if word and all(z <= x or y <= a for x, _, y in known):
                rows.append((i, a, z, 4, word.lower(), left, right))
    graph, where = {}, []
    for i, a, z, k, v, (l2, l1), r1 in rows:
        for p in [f"{l2} {l1} _"] * bool(l2 and l1) + [f"{l1} _ {r1}"] * bool(l1 and r1):
            graph[p, v] = min(k, graph.get((p, v), 9))
            where.append((i, a, z, k, v, p))
    by = defaultdict(dict)
    for (p, v), k in graph.items():
        by[p][v] = k
    score = {}
    for _ in range(rounds):
        conf = {}
        for p, vs in by.items():
            for k in range(4):
                mass = sum(1 if kind == k else score.get((v, k), 0) if kind == 4 else 0 for v, kind in vs.items())
                if len(vs) >= support and 4 in vs.values() and mass >= support and mass >= sure * (len(vs) + 1):
                    conf[p, k] = mass / (len(vs) + 1)
        score = {}
        for (p, k), c in conf.items():
            for v, kind in by[p].items():
                if kind == 4:
                    score[v, k] = 1 - (1 - score.get((v, k), 0)) * (1 - c)
    out = set()
    for i, a, z, k, v, p in where:
        if k == 4:
            best = max(range(4), key=lambda x: (score.get((v, x), 0), -x))
            if score.get((v, best), 0) >= accept and (p, best) in conf:
                out.add((i, a, best, z))
    return out


def contexts():
    seeds = [f"please write to user{i}@mail{i}.example.com today about {i}" for i in range(45)]
    unseen = ["Please write to john.doe(at)example.org today, thanks", "please write to \"jane@localhost\" today", "they write to nobody today"]
    calls = [f"call me on +1 (212) 555-{1000 + i} now" for i in range(9)] + ["call me on 0049-30-901820 now", "since then 2019-11 and 20191130 passed"]
    # a second context, known only through what the first one found
    second = [f"you reach user{i}(at)far.example soon" for i in range(8)] + [f"please write to user{i}(at)far.example today" for i in range(8)] + ["you reach zz9(at)new.example soon"]
    return seeds + unseen + calls + second + [None, "", "x@y", "a@b.c_d@e.f +1 222 333 4444+1 222 333 4444 1.2.3.4.5.6.7.8 001.2.3.256 0.0.0.0000255",
                                              "4111 1111 1111 1111 4111-1111-1111-1112 1" * 3, "9" * 20000, "a" * 50000 + "@", "(" * 20000 + " " + "[at]" * 3000 + "1.1" * 500,
                                              "été \U0001f600 ü@a.b me@ü.de über.x@a-b.de, 日本 10.0.0.1\x1c7"]


def line(r):
    return [(s.start, s.kind, s.end) for s in r.spans if s.known], {(s.start, s.kind, s.end) for s in r.spans if not s.known}


@pytest.mark.parametrize("data", ["given", "awkward", "contexts", "empty"])
def test_spans(spark, data):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if data == "given" else spark.createDataFrame(
        {"awkward": awkward(), "empty": []}.get(data, [(i, t, "en", "x", 0, 1, 2, "k", 0.5, True, 3) for i, t in enumerate(contexts())]), SCHEMA)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    more = found([t for _, t in texts])
    want = sorted((repr(d), base(t), sorted(x[1:] for x in more if x[0] == i)) for i, (d, t) in enumerate(texts))
    got = sorted((repr(r.doc_id), line(r)[0], sorted(line(r)[1])) for r in pii.find(docs).collect())
    assert got == want
    if data == "contexts":
        seen = {texts[i][1][a:z] for i, a, _, z in more}
        assert seen >= {"john.doe(at)example.org", "jane@localhost", "0049-30-901820", "zz9(at)new.example"} and "20191130" not in seen


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = base(texts[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in spans) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and (r.n_found or r.spans == said)


@pytest.mark.parametrize("seeds, others, finds", [(4, 1, 0), (5, 1, 0), (8, 1, 1), (8, 2, 0), (20, 3, 3)])
def test_confidence_needs_support_and_few_others(spark, seeds, others, finds):
    texts = [f"we write to u{i}@a.b now" for i in range(seeds)] + [f"we write to x{i}(at)y now" for i in range(others)]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(len(line(r)[1]) for r in got) == finds == len(found(texts))


def test_main_path_is_native(spark):
    plan = pii.hits(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
