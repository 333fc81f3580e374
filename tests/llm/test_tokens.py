"""Words go straight to the model, once while the memo holds them, and their ids are those of the whole text."""

from __future__ import annotations

import random
from itertools import product

import pyarrow as pa

from lectern.llm import tokens


def test_accented_words_need_no_cutting():
    e = tokens.Encoder(tokens.vocabulary_path())
    whole = e.first.encode
    texts = ["Éclair l'été, naïve ß ÿ", "ª º µm à", "a\xa0b ×y ÷ Ænd!ß?", "ÀÁ\nß über", " É"]
    assert [e(t) for t in texts] == [tokens.pack(whole(t, add_special_tokens=False).ids) for t in texts]
    calls = []
    for memo in (e.first, e.spaced):
        memo.encode = lambda text, **options: calls.append(text) or whole(text, **options)
    words = "été naïveté Übermaß señorita"
    assert e(words) == tokens.pack(whole(words, add_special_tokens=False).ids) and not calls


def test_words_are_encoded_once():
    e = tokens.Encoder(tokens.vocabulary_path())
    text = " ".join(map("".join, product("abcdefghijklmnopqrstuv", repeat=4)))  # 234,256 different words
    first = e(text)
    calls = []
    for memo in (e.first, e.spaced):
        memo.encode = memo.tokenize = lambda *a, **options: calls.append(a)
    assert e(text) == first and not calls


def test_batches_of_odd_texts(monkeypatch):
    e = tokens.Encoder(tokens.vocabulary_path())
    pieces = ["a", "The", " ", "  ", "\n", ".", ",", "?!", "é", "ß", "'s", "\x00", "\xa0", " ", "\x85", "\x1c", "中", "😀", "1", "²", "(", "…", "\t", "\r\n", "\v"]
    rng = random.Random(5)
    texts = [None, "", " ", "\n", *("".join(rng.choices(pieces, k=rng.randrange(14))) for _ in range(3000))]
    want = [tokens.pack(e.first.encode(t or "", add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 200)  # parts are left out and met again
    for at in range(0, len(texts), 50):
        ids, begin = e.batch(pa.array([None, *texts[at : at + 50]]).slice(1))
        assert [ids[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)] == want[at : at + 50]
        assert len(e.first.parts) <= 200
    ids, begin = e.batch(pa.array([], pa.string()))
    assert len(ids) == 0 and begin.tolist() == [0]
