"""The short-segment search of the piece encoder against the streaming one."""

import numpy as np
import public_tokenizers

from lumifield.llm import pieces


def test_window_gives_the_path_of_the_streaming_search():
    v = pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    encoder, rng = pieces.Encoder(v), np.random.default_rng(17)
    known = [p for p in v.ids if p and "\n" not in p]
    texts = ["", "a", "▁", "▁▁▁", "aaaaaaaaaaaa", "▁été", "日本語日本", "\U0001f600\U0001f600x", "▁Hello▁World", "123456789", "\x00\x7f"]
    texts += ["".join(rng.choice(known, rng.integers(1, 5)))[: 2 * v.longest] for _ in range(400)]
    texts += ["".join(rng.choice(list("▁abcdeéß日1 .,"), rng.integers(1, 2 * v.longest))) for _ in range(200)]
    for t in texts:
        search = pieces.Viterbi(v)
        assert encoder._window(t) == [*search.feed(t), *search.end()], t


def test_letters_and_marks_are_searched_apart_where_no_piece_joins_them():
    path = public_tokenizers.path("piece_bpe_32k.model")
    v = pieces.Vocabulary.load(path)
    encoder, rng = pieces.Encoder(v), np.random.default_rng(18)
    encoder.encode("Hello Hello, Hello!! Hello%Hello")
    assert set(encoder.known) == {"▁Hello", ",", "!!", "%", "Hello"}
    signs = list("▁ab.Zéß²½ŀ1,-日'!\ńªˆ") + ["².", "a².", "▁Hello", "!!"]
    for t in ["".join(rng.choice(signs, rng.integers(1, 30))) for _ in range(400)]:
        search, ids = pieces.Viterbi(v), []
        for p in [*search.feed("▁" + t), *search.end()]:
            ids += [v.ids[p]] if p in v.ids else [v.byte_ids[b] for b in p.encode()]
        assert np.frombuffer(encoder.encode(t.replace("▁", " ")), "<u4").tolist() == ids, t
    mixed = pieces.Vocabulary([("<unk>", 0.0), ("a", -3.0), (".", -3.0), ("a.", -1.0)], [], 0, True, prefix=False)
    assert not mixed.pure and np.frombuffer(pieces.Encoder(mixed).encode("a."), "<u4").tolist() == [3]


def test_a_worker_reads_a_model_once():
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert pieces._encoder(path) is pieces._encoder(path) and pieces._encoder(path).v is pieces._vocabulary(path)
