"""Encoding of many texts together, against the library."""

import random

import numpy as np
import pytest
from sluice.llm import tokens

ODD = [
    *(None, "", " ", "x", "x.", ".", "...", "abc,%%% x", 'abc"!? def_ gh-', "a$ b^^ c~`", "don't abc's. x.'", "a'' b", "i'll. can't, we'd", "x''. y", "12, a1. b"),
    *("ünï,;: éé)( q", "ª, º!", "ɐx, ab ɐ", "文字, 字。 a", "ab..\nCd!!! e", "a <|endoftext|> b", "a <|endof b", "a\tb c", "a  b", "a \n b", "\nab c", " ab", "a b ", "a\nb", "a\nb c\nd", "a\u00a0b c"),
]


@pytest.fixture
def encoder():
    return tokens.Encoder(tokens.default_vocabulary())


def library(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block", [2, 1 << 18])
def test_many_texts_together(encoder, monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK", block)
    rng = random.Random(5)
    alphabet = "abcé. ,%!'\n1_"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(500)]
    got = encoder.encode_all(texts)
    assert [np.frombuffer(g, encoder.dtype).tolist() for g in got] == [library(encoder, t) for t in texts]
    assert got == [encoder.encode(t) for t in texts]
    assert encoder.encode_all([]) == [] and encoder.encode_all([None, ""]) == [b"", b""]


def test_each_part_is_looked_up_once(encoder):
    """A word with marks isn't given to the whole tokenizer, and a part of many texts is encoded once."""
    asked, whole = [], encoder.parts.whole
    encoder.parts.whole = lambda text, **given: asked.append(text) or whole(text, **given)
    texts = [f"alpha word{chr(97 + i % 26)},%%% é!? a" for i in range(300)]
    got = encoder.encode_all(texts)
    assert [np.frombuffer(g, encoder.dtype).tolist() for g in got] == [library(encoder, t) for t in texts]
    assert len(asked) <= 3 + 26 and " worda,%%%" not in asked


def test_parts_that_stay(encoder, monkeypatch):
    """Beyond the limit the first parts stay and the others are found again."""
    monkeypatch.setattr(tokens, "CACHED_PARTS", 20)
    monkeypatch.setattr(tokens, "FIRST_PARTS", 5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    for lo in range(0, 200, 20):
        text = " ".join(["first", "often", *words[lo : lo + 20]])
        assert np.frombuffer(encoder.encode_all([text])[0], encoder.dtype).tolist() == library(encoder, text)
        assert "often" in encoder.parts and len(encoder.parts) <= 20 + 22
