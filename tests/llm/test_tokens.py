"""Parts of texts, each encoded once, against the tokenizers themselves."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from serigraph.llm import packing, token_files
from serigraph.llm.queries import BYTE_TOKENIZER, TOKENIZER

FILE, BYTE_FILE = public_tokenizers.path(TOKENIZER), public_tokenizers.path(BYTE_TOKENIZER)
PIECES = [
    "a", "B", "ab", " ", "  ", "\n", ".", ",", " wörd", "\t", "é", "À", "\xa0", " ", "　", "'s", "'", "'RE", "'ll", "'l", "'st", "1", "23", "!", "<|endoftext|>", "<|", "|", "<", "\x1c", "\x85", "\x00", "日本",
    "İ", "Ⱥ", "ǅ", "ß", "Σ", "é", "́", "😀", "𝐀", "½", "²", "\xad", "ﬁ", "Don't stop, they're here.", "﻿", "￿", "",
]


def odd_texts(n):
    rng = random.Random(4)
    return ["", " ", "'s", "|", "'", "日", *("".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(n))]


@pytest.mark.parametrize("kept", [1_000_000, 50])
def test_packing_encoder_equals_the_tokenizer(monkeypatch, kept):
    monkeypatch.setattr(packing, "KEPT", kept)
    direct, encode, texts = Tokenizer.from_file(FILE), packing.PartEncoder(FILE, 7), odd_texts(5_000)
    for some in (texts[:2_000], texts[2_000:2_001], texts[2_001:], texts, []):
        ids, ends = encode([t.encode() for t in some])
        for text, own in zip(some, np.split(ids, ends[:-1]), strict=bool(some)):
            assert own.tolist() == [*direct.encode(text, add_special_tokens=False).ids, 7]


def test_packing_encodes_a_word_once_however_it_is_written(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 40)
    encode, asked = packing.encoder.__wrapped__(FILE, 0), []
    batch = encode.parts.tokenizer.encode_batch_fast
    monkeypatch.setattr(encode.parts, "encoded", lambda strings: asked.extend(x for s in strings for x in s.split()) or [np.array(e.ids, "<u4").tobytes() for e in batch(strings, add_special_tokens=False)])
    for text in ("Some (words): here", "HERE, some", "'words' \"here\"", *(f"here {'some words ' * (i % 2)}other{chr(97 + i)}" for i in range(26))):
        encode([text.encode()])
    assert len(encode.parts.strings) <= 41  # what was met least lately is forgotten, not what an earlier run used
    assert [asked.count(w) for w in ("some", "words", "here")] == [1, 1, 1]


@pytest.mark.parametrize(("kept", "end"), [(1_000_000, 7), (50, 7), (50, None)])
def test_byte_encoder_equals_the_tokenizer(monkeypatch, kept, end):
    monkeypatch.setattr(token_files, "KEPT", kept)
    direct, encode, texts = Tokenizer.from_file(BYTE_FILE), token_files.Encoder(BYTE_FILE, end), odd_texts(5_000)
    for some in (texts[:2_000], texts[2_000:2_001], texts[2_001:], texts, []):
        ids, n = encode([t.encode() for t in some])
        for text, own in zip(some, np.split(ids, np.cumsum(n)[:-1]), strict=bool(some)):
            assert own.tolist() == [*direct.encode(text, add_special_tokens=False).ids, *([] if end is None else [end])]


def test_byte_encoder_keeps_what_is_met_often(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT", 40)
    encode, asked = token_files.Encoder(BYTE_FILE, 0), []
    batch = encode.parts.tokenizer.encode_batch_fast
    monkeypatch.setattr(encode.parts, "encoded", lambda strings: asked.extend(x for s in strings for x in s.split()) or [np.array(e.ids, "<u4").tobytes() for e in batch(strings, add_special_tokens=False)])
    for text in ("of (some words): here", "the here, some", "\"some\" words!", *(f"so here,{' some words.' * (i % 2)} other{chr(97 + i)}\nmore" for i in range(26))):
        encode([text.encode()])
    assert len(encode.parts.strings) <= 41
    assert [asked.count(w) for w in ("words", "here")] == [1, 1]
