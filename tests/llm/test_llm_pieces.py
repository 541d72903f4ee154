"""Pieces of texts that the tokenizer has not seen yet, and those that stay."""

import random

import numpy as np
from tokenizers import Tokenizer

from scriptorium.llm import kept, tokens
from scriptorium.llm.queries import BYTE_BPE


def test_pieces_behind_blanks_are_learned_without_line_ends():
    enc, sent = tokens.Encoder(BYTE_BPE), []
    whole = enc.whole
    enc.whole = lambda text: sent.append(text) or whole(text)
    text = "Ab cd's 12ab 漢字 é. x,y (z) Ġq <b> _ ''' 's word, word. -"
    assert enc.encode([text]) == [whole(text)]
    assert "\n" not in "".join(sent)


def test_frequent_pieces_stay_when_there_are_too_many(monkeypatch):
    monkeypatch.setattr(tokens, "_PIECES", 200)
    rng = random.Random(1)
    enc, plain = tokens.Encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for i in range(40):
        texts = [" ".join(["the", "and", *(f"w{rng.randrange(10**6)}{rng.choice(',.x é')}" for _ in range(30))]) + rng.choice(["", "\nthe and", " ", "  ", "\t", "\n\nq"]) for _ in range(4)]
        before = set(enc.spaced)
        got = enc.encode([*texts, "", " ", "\n", " a", "a ", "a  ", "  a", "a\n\n", "a b"])
        want = plain.encode_batch([*texts, "", " ", "\n", " a", "a ", "a  ", "  a", "a\n\n", "a b"], add_special_tokens=False)
        assert got == [np.array(e.ids, "<u4").tobytes() for e in want]
        if i:
            assert "and" in before & set(enc.spaced) and len(before & set(enc.spaced)) >= 40


def test_words_are_not_encoded_again_for_the_marks_behind_them():
    enc, plain, sent = tokens.Encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE), []
    whole = enc.whole
    enc.whole = lambda text: sent.append(text) or whole(text)
    enc.encode(["so windowlike mountainlike"])
    sent.clear()
    texts = ["a windowlike&&& mountainlike***", "so windowlike?!\n\nmountainlike', é... 3,, ʰ, '',"]
    got = enc.encode(texts)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert "windowlike" not in "".join(sent) and "mountainlike***" not in "".join(sent)


def test_pieces_that_come_again_stay_though_others_came_first(monkeypatch):
    monkeypatch.setattr(tokens, "_PIECES", 200)
    enc, plain = tokens.Encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    enc.encode([" ".join(f"first{i}" for i in range(150))])
    sent, whole = [], enc.whole
    enc.whole = lambda text: sent.append(text) or whole(text)
    for i in range(12):
        sent.clear()
        text = " ".join(["x", "afterwards", *(f"rare{i}q{j}" for j in range(60))])
        assert enc.encode([text]) == [np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        assert len(enc.spaced) <= 200 + 62 and (i < 2 or "afterwards" not in "".join(sent))


def test_a_worker_hands_memory_back_before_it_keeps_another_thing(monkeypatch):
    calls = []
    monkeypatch.setattr(kept, "trim", lambda: calls.append(1))
    assert kept.kept("first", lambda: 1) == 1 and kept.kept("first", lambda: 2) == 1 and len(calls) == 1
    assert kept.kept("second", lambda: 3) == 3 and len(calls) == 2
    kept.release()
