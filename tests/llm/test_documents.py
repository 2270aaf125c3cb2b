"""Operators on documents against plain computation: the smallest tables, and rows made to be awkward."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumifield.llm import langid, linededup, minhash, packing, pieces, quality, queries, secrets, substring, weaklabel
from tests.llm import brute

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id int, item int, key string, score double, kept boolean, n int"


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(n))


def awkward():
    long = " ".join(sentence(k, 200) for k in range(60))
    passage = sentence(900, 60)
    a, b = sentence(1, 80), sentence(2, 80)
    texts = [
        (1, a), (2, b), (3, a), (4, a.replace(a.split()[40], "x", 1)), (5, f"{sentence(3, 30)} {passage}\n{sentence(4, 30)}"),
        (6, f"{sentence(5, 10)}\n{passage}"), (7, None), (8, ""), (9, " \n\t \r\n"), (10, "one"), (11, "one two"), (12, "One TWO"),
        (13, long), (14, long + " tail"), (None, a), (None, None), (15, "same words " * 60), (16, "\n".join([b, a, b])), (16, "\n".join([b, a, b])),
        (17, "été ÉTÉ ß▁x \U0001f600 日本語   nbsp\x1cfs"), (18, "12 34 ## !!"), (19, 'token = "0123456789abcdef0123456789abcdef01234567" and 4111111111111111'),
        (20, f"{passage}\n{passage}\n{passage}"), (2**40, a.upper())]
    return [(d, t, ["en", "de", None][i % 3], ["x", None][i % 2], 0, 1, 2, "k", 0.5, True, 3) for i, (d, t) in enumerate(texts)]


@pytest.fixture(scope="module", params=["given", "awkward", "empty", "copies"])
def docs(request, spark):
    if request.param == "given":
        return spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows = {"awkward": awkward(), "empty": [], "copies": copies()}[request.param]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def copies():
    """A group of near copies, many of them just too far apart, beside exact copies."""
    rng, base, out = np.random.default_rng(5), sentence(77, 90).split(), []
    for i in range(120):
        w = list(base)
        for _ in range(int(rng.integers(0, 8))):
            k = int(rng.integers(len(w)))
            if rng.random() < 0.5:
                del w[k]
            else:
                w[k] = f"new{rng.integers(9)}"
        out.append((i, " ".join(w), "en", "x", 0, 1, 2, "k", 0.5, True, 3))
    return out + [(200 + i, " ".join(base), "en", "x", 0, 1, 2, "k", 0.5, True, 3) for i in range(20)]


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def have(docs, *names):
    return [n for n in names if n in docs.columns]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same(got, want):
    assert rows(got) == sorted(want, key=repr)


def test_quality_counts(docs):
    got = quality.quality_rules(docs)
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
         [(d, *brute.base_counts(t)) for d, t in pairs(docs)])
    assert not got.where("base_failed AND kept").count()


def test_near_duplicates(docs):
    for size, percent in ((3, 85), (5, 80)):
        got = minhash.near_duplicates(docs, size, percent, 44, 5).select("doc_id", "n_shingles", "component_id", "kept")
        same(got, [(d, n, c, d == c) for d, n, c in brute.near_groups(pairs(docs), size, percent)])


def test_blocks_of_any_size_give_the_same_groups(spark, monkeypatch):
    docs = spark.createDataFrame(copies(), SCHEMA)
    monkeypatch.setattr(minhash, "BLOCK", 200)
    want = [(d, n, c, d == c) for d, n, c in brute.near_groups(pairs(docs))]
    assert len({w[2] for w in want}) > 3  # some copies are too far from all others
    same(minhash.near_duplicates(docs).drop("text_hash"), want)


def test_many_short_sets_of_one_block_are_compared_in_little_memory():
    rng, kinds = np.random.default_rng(4), np.arange(1, 9001, dtype=np.uint64)
    sets = [np.unique(rng.choice(kinds, 2)) for _ in range(8000)]
    assert max(z - a for a, z in minhash._tiles(np.array([len(s) for s in sets]))) <= minhash.TILE
    part = pa.RecordBatch.from_pydict({k: [v] for k, v in (("ca", list(range(8000))), ("cb", list(range(8000))))} | {
        k: pa.array([[s.tobytes() for s in sets]], pa.list_(pa.binary())) for k in ("ma", "mb")})
    import tracemalloc

    tracemalloc.start()
    links = next(minhash._confirm_blocks(iter([part]), 85))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    by = defaultdict(list)
    for i, x in enumerate(sets):
        by[x.tobytes()].append(i)
    want = {(i, j) for same in by.values() for i in same for j in same if i != j}
    assert {tuple(r.values()) for r in links.to_pylist()} == want and peak < 400e6


def test_substrings(docs):
    got = substring.dedup_substrings(docs)
    same(got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)), brute.substrings(pairs(docs)))


def test_substrings_at_other_sizes(docs):
    for window, edge in ((4, 2), (12, 12), (9, 1)):
        got = substring.dedup_substrings(docs, window, edge)
        same(got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)), brute.substrings(pairs(docs), window))


def test_packing(docs):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(WORDS), pairs(docs)
    ids = {}
    for i, (d, text) in enumerate(want):
        ids.setdefault((d, text), []).append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    got = packing.pack_documents(docs, WORDS, have(docs, "doc_id", "text", "kept"), pool=7).collect() if want else []
    sequences, covered = defaultdict(list), defaultdict(Counter)
    for r in got:
        whole = ids[r.doc_id, r.text][0]
        assert np.frombuffer(r.ids, "<u4").tolist() == whole[r.start : r.start + r.length]
        assert r.doc_tokens == len(whole) and r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length, r.tier))
        covered[r.doc_id, r.text].update(range(r.start, r.start + r.length))
    for key, each in ids.items():
        assert covered[key] == {i: len(each) for i in range(len(each[0]))}
    for s in sequences.values():
        at = 0
        for offset, length, tier in sorted(s):
            assert offset == at
            at += length
        assert at == tier <= 2048 and at & (at - 1) == 0  # nothing to pad


def test_step_groups_are_near_each_other():
    rng = np.random.default_rng(0)
    cost = rng.integers(1, 1000, 640).tolist()
    group = packing.step_groups(cost, [64] * 640, 64 * 64)
    sums = [sum(c for c, g in zip(cost, group) if g == k) for k in set(group)]
    assert len(sums) == 10 and max(sums) < 1.05 * min(sums)


def test_line_dedup(docs):
    """Lines go that lie in a run of 12 words which any document before has; in order of id (null first) and hash."""
    lines = lambda t: [tuple(brute.split(x)) for x in (t or "").split("\n") if brute.split(x)]
    plain = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()
    order = sorted({(r.doc_id is not None, r.doc_id or 0, r.h): r.text for r in plain}.items())
    holders, gone = defaultdict(list), {}
    for o, t in order:
        mine = lines(t)
        before = {id(e): e for x in set(mine) for e in holders[x]}.values()
        gone[o] = {k for e in before for k in blocks(e, mine, [len(x) for x in mine], linededup.BLOCK_WORDS)}
        for x in set(mine):
            holders[x].append(mine)
    want = []
    for r in plain:
        mine, out = lines(r.text), gone[r.doc_id is not None, r.doc_id or 0, r.h]
        want.append((r.doc_id, r.h, len(mine), len(out), r.text is None, [x for k, x in enumerate(mine) if k not in out]))
    got = linededup.dedup_lines(docs, keep=have(docs, "kept", "n")).collect()
    assert sorted(((r.doc_id, r.text_hash, r.n_lines, r.n_deleted, r.kept_text is None, lines(r.kept_text)) for r in got), key=repr) == sorted(want, key=repr)


def test_first_copy_of_each_deleted_line_stays(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    out = linededup.dedup_lines(docs).collect()
    lines = lambda texts: {tuple(brute.split(x)) for t in texts for x in (t or "").split("\n")}
    assert lines(r.kept_text for r in out) >= lines(t for _, t in pairs(docs)) - {()}


def phrase(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def deduped(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_deleted, r.kept_text) for r in linededup.dedup_lines(docs).collect()}


def test_block_whose_lines_came_first_elsewhere_goes(spark):
    a, b = phrase("a", 6), phrase("b", 6)
    got = deduped(spark, [f"{a}\nx", f"{b}\ny", f"{a}\n{b}\nz", f"v\n{a}\n{b}\nw"])
    assert got[2] == (0, f"{a}\n{b}\nz") and got[3] == (2, "v\nw")


def blocks(earlier, later, sizes, least):
    """Places in common runs of ``least`` words, by trying every pair of starts."""
    out = set()
    for i in range(len(earlier)):
        for j in range(len(later)):
            n = 0
            while i + n < len(earlier) and j + n < len(later) and earlier[i + n] == later[j + n]:
                n += 1
            if sum(sizes[j : j + n]) >= least:
                out |= set(range(j, j + n))
    return sorted(out)


def test_block_in_more_documents_than_are_rare(spark):
    a, b = phrase("a", 6), phrase("b", 6)
    got = deduped(spark, [f"{a}\nx", f"{b}\ny", *(f"own{i}\n{a}\n{b}" for i in range(70)), *(f"me{i}\n{a}\n{a}" for i in range(70))])
    assert [got[i][0] for i in range(142)] == [0, 0, 0, *[2] * 69, 0, *[2] * 69]


def test_repeated_and_crossed_blocks_are_found():
    assert linededup.common_blocks([1, 9, 1], [5, 1, 6], [3, 12, 3], 12) == [1]
    assert linededup.common_blocks([1, 2], [7, 2, 8, 1, 7], [1, 12, 1, 12, 1], 12) == [1, 3]
    rng = np.random.default_rng(8)
    for _ in range(3000):
        top = int(rng.integers(2, 9))
        width = rng.integers(1, int(rng.integers(2, 14)), top)
        a, b = (rng.integers(0, top, rng.integers(0, 14)).tolist() for _ in range(2))
        assert linededup.common_blocks(a, b, [int(width[x]) for x in b], 12) == blocks(a, b, [int(width[x]) for x in b], 12)


def test_deletions_equal_those_against_every_earlier_document(spark):
    rng, texts = np.random.default_rng(9), []
    pool = [phrase(f"p{k}w", int(rng.integers(1, 15))) for k in range(60)]
    for i in range(150):
        at = rng.integers(0, 60, 3)
        texts.append("\n".join([*(pool[(x + k) % 60] for x in at for k in range(int(rng.integers(1, 4)))), phrase(f"own{i}w", 3)]))
    lines, got = [t.split("\n") for t in texts], deduped(spark, texts)
    for i, mine in enumerate(lines):
        gone = {k for e in lines[:i] for k in blocks(e, mine, [len(x.split()) for x in mine], linededup.BLOCK_WORDS)}
        assert got[i] == (len(gone), "\n".join(x for k, x in enumerate(mine) if k not in gone))


def test_patience():
    assert linededup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert linededup.patience([], [1]) == [] and linededup.patience([7, 7], [8, 8]) == []
    assert linededup.patience([1, 5, 2, 6, 3], [9, 5, 8, 8, 6, 7]) == [(1, 1), (3, 4)]
    assert linededup.common_blocks([1, 2, 3, 4], [0, 1, 2, 9, 4], [1, 6, 6, 1, 6], 12) == [1, 2]


def test_languages(docs):
    learned = langid.learn(docs.select("text", "lang"))
    got = langid.identify(docs, learned).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    for r in got:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and r.lang_pred in [*learned.langs, "und"]


def test_languages_held_out(spark):
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    n = got.where("held_out").agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n[0] > 150 and n[1] >= 0.98 * n[0]


def test_filters_answer_for_all_languages(spark):
    rng = np.random.default_rng(1)
    letters = [chr(97 + i) for i in range(26)]
    langs = [f"l{i:03d}" for i in range(70)]  # over one word of bits
    data = [(k, " ".join("".join(rng.choice(letters[i % 13 :: 13] + letters[(i * 7) % 26 : (i * 7) % 26 + 3], 6)) for _ in range(200))) for i, k in enumerate(langs)]
    learned = langid.learn(spark.createDataFrame(data, "lang string, text string"))
    got = langid.identify(spark.createDataFrame(data, "truth string, text string"), learned).collect()
    assert learned.table.shape[0] == 2 and sum(r.truth == r.lang_pred for r in got) >= 66


def test_pieces(docs):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode(docs, PIECES, ["doc_id", "text"])
    for r in got.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text or "")
    for r in pieces.decode_ids(got, PIECES, ["text"]).collect():
        assert r.decoded == (r.text or "").replace("▁", " ")


def test_viterbi_keeps_a_bounded_window():
    v = pieces.Vocabulary.load(PIECES)
    for text in ("a" * 20_000, "abcde fghij " * 1000, sentence(3, 2000), "日本語" * 3000, " " * 5000):
        search, ids = pieces.Viterbi(v), []
        for p in [*search.feed("▁" + text.replace(" ", "▁")), *search.end()]:
            ids += [v.ids[p]] if p in v.ids else [v.byte_ids[b] for b in p.encode()]
        assert pieces.decode(v, ids) == text
        assert search.widest <= 8 * v.longest


def test_unigram_viterbi_finds_the_best_path():
    rng, letters = np.random.default_rng(2), "abc"
    table = {c: -5.0 for c in letters}
    while len(table) < 25:
        table.setdefault("".join(rng.choice(list(letters), rng.integers(2, 6))), float(-rng.integers(3, 12)))
    v = pieces.Vocabulary([("<unk>", 0.0), *table.items()], [], 0, False, prefix=False)
    for _ in range(200):
        text = "".join(rng.choice(list(letters + "z"), rng.integers(1, 60)))
        best = [0.0]
        for j in range(1, len(text) + 1):
            best.append(max(best[i] + (table[text[i:j]] if text[i:j] in table else v.lowest if j == i + 1 else -1e9) for i in range(max(0, j - 5), j)))
        search = pieces.Viterbi(v)
        got = [*search.feed(text), *search.end()]
        assert "".join(got) == text
        assert sum(table.get(p, v.lowest) for p in got) == pytest.approx(best[-1])


def test_secrets(docs):
    found = secrets.scan(docs)
    got, texts = found.collect(), {}
    for d, t in pairs(docs):
        texts.setdefault(d, []).append(t)
    for r in got:
        assert any(t is not None and t[r.start : r.start + r.length] == r.value for t in texts[r.doc_id])
    if any(d == 19 and t and t.startswith("token") for d, t in pairs(docs)):
        assert {(r.doc_id, r.start, r.is_secret) for r in got if r.doc_id == 19} == {(19, 9, True), (19, 55, False)}
        clean = {r.doc_id: r.clean_text for r in secrets.redact(docs, found, keep=["kept"]).collect()}
        assert clean[19] == 'token = "[secret]" and 4111111111111111' and clean[7] is None


def test_secrets_of_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {(r.doc_id, m) for r in docs.collect() for m in __import__("re").findall(r'(?i)token = "([0-9a-f]{40})"', r.text)}
    got = {(r.doc_id, r.value) for r in secrets.scan(docs).where("is_secret").collect()}
    assert want and got == want


def test_secrets_of_any_characters_are_whole(spark):
    given = [
        ('password = "p@ss!w0rd#24" end', 'password = "[secret]" end'), ('password = "abcdefgh1!xyz" end', 'password = "[secret]" end'),
        ("export DB_PASSWORD=p@ss!w0rd#24\nnext", "export DB_PASSWORD=[secret]\nnext"), ("secret: 'two words, 3 more!' end", "secret: '[secret]' end"),
        ('{"password": "pä$$wörter 1"}', '{"password": "[secret]"}'), ("token: abcdefgh12345678, end", "token: [secret], end"),
        ("u?token=ab$cd%ef!&password=p@ss!w0rd end", "u?token=[secret]&password=[secret] end"), ('cmd "--password=p@ss!w0rd#24", end', 'cmd "--password=[secret]", end'),
        ("password = short! end", "password = short! end"), ("no name = p@ss!w0rd#24", "no name = p@ss!w0rd#24")]
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(given)], "doc_id long, text string, source string")
    clean = {r.doc_id: r.clean_text for r in secrets.redact(docs, secrets.scan(docs)).collect()}
    assert [clean[i] for i in range(len(given))] == [c for _, c in given]


def test_labelled_findings_teach_the_forest(spark):
    rng = np.random.default_rng(4)
    word, code = lambda: sentence(int(rng.integers(9**6)), 3).replace(" ", "") + "1", lambda: "".join(rng.choice(list("abcdef0123456789"), 32))
    labels = [(code(), "a/b.py", "call with ", "", 1) for _ in range(80)] + [(word(), "a/b.py", "call with ", "", 0) for _ in range(80)]
    held = [(i, f"call with {code()} and {word()}", "a/b.py") for i in range(40)]
    docs = spark.createDataFrame(held, "doc_id long, text string, source string")
    got = secrets.scan(docs, spark.createDataFrame(labels, "value string, path string, left string, right string, label int")).collect()
    right = sum(r.is_secret == (r.start == 10) for r in got)
    assert len(got) >= 40 and right >= 0.9 * len(got)


def test_classifier(docs):
    got = weaklabel.classify(docs).collect()
    assert len(got) == docs.count() and Counter(r.doc_id for r in got) == Counter(d for d, _ in pairs(docs))
    for r in got:
        assert 0 <= r.score <= 1 and r.kept == (r.score >= 0.5) and not (r.kept and r.n_words == 0)


def test_classifier_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for quality_, least in ((1, 0.97), (0, 0.85)):
        mine = [r for r in got if r.quality == quality_]
        assert sum(r.kept == bool(quality_) for r in mine) >= least * len(mine)


def test_label_model_finds_accuracies():
    import pandas as pd

    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    bad = np.array([[0.9, 0.1], [0.7, 0.05], [0.6, 0.2], [0.8, 0.02]])
    votes = np.where(rng.random((20_000, 4)) < np.where(truth[:, None], bad[:, 1], bad[:, 0]), -1, 1) * (rng.random((20_000, 4)) < 0.8)
    names = list("abcd")
    p = pd.DataFrame(votes, columns=names).value_counts().rename("n").reset_index()
    model = weaklabel.fit_labels(p, names)
    assert np.abs(model.bad_vote - bad).max() < 0.05 and abs(model.prior - 0.7) < 0.03
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good = [r for r in got if r.quality == 1]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in got if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in got)


def test_sketches_merge_and_are_near_the_quantiles(spark):
    rng = np.random.default_rng(3)
    v = rng.lognormal(0, 2, 4000)
    df = spark.createDataFrame([(i % 3, float(x)) for i, x in enumerate(v)], "g int, v double")
    merged = quality.merge(quality.sketch(df, ["g"], "v").withColumn("all", F.lit(1)), ["all"])
    got = quality.quantiles(merged, ["all"], a=0.1, b=0.5, c=0.99).first()
    assert got.rows == 4000
    for k, q in (("a", 0.1), ("b", 0.5), ("c", 0.99)):
        want = np.quantile(v, q, method="inverted_cdf")
        assert abs(got[k] - want) <= 0.011 * (want + quality.UNIT)
