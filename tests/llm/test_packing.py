"""The word table of the packing operator: what is looked up, and what is remembered."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from lumifield.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_a_word_is_looked_up_once_whatever_marks_follow_it():
    tokens = packing.WordTokens(PATH, remember=12)
    texts = ["Hello, hello hello!! hello", "a1. x.y. ß, é; ŀ. Σ. İ! <|x|>. end.", "one\ntwo. (three)! 'four'", None, "."] * 2
    got = tokens.encode(pa.array(texts[:1])) + tokens.encode(pa.array(texts[1:]))
    for t, ids in zip(texts, got):
        assert ids.tolist() == tokens.tokenizer.encode(t or "", add_special_tokens=False).ids, t
    tokens = packing.WordTokens(PATH)
    tokens.encode(pa.array(texts[:1]))
    assert set(tokens) == {"hello", ",", "!!"}


def test_words_of_the_texts_at_hand_stay_when_the_table_is_full():
    tokens = packing.WordTokens(PATH, remember=4)
    first = tokens.encode(pa.array(["alpha beta gamma"]))[0]
    kept = tokens["alpha"]
    again = tokens.encode(pa.array(["alpha delta epsilon zeta"]))[0]
    assert tokens["alpha"] is kept and "beta" not in tokens
    assert np.array_equal(first[: len(kept) // 4], again[: len(kept) // 4])


def test_a_worker_reads_the_tokenizer_once():
    assert packing._word_tokens(PATH) is packing._word_tokens(PATH)
