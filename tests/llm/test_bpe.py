"""The BPE transducer against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from depscope.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    "a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "'re", "é", "中", "🎉", "\x1c", "\x85", " ", "1", "23", "!", "<|endoftext|>",
    "<|end", "́", "‍", "ing", "er", "\r\n", "$", "_", "﻿", "ⅷ", "²",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_vocabulary(PATH))


def _encoded(vocabulary, text):
    return [t for tokens in bpe.encode(vocabulary, text) for t in tokens]


def test_random_texts_in_any_chunks(library, vocabulary):
    r = random.Random(3)
    for _ in range(1500):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(0, 30)))
        expected = library.encode(text, add_special_tokens=False).ids
        assert _encoded(vocabulary, text) == expected
        encoder, got, at = bpe.Encoder(vocabulary), [], 0
        while at < len(text):
            size = r.randint(1, 5)
            got += encoder.feed(text[at : at + size])
            at += size
        assert got + list(encoder.finish()) == expected
        decoder = bpe.Decoder(vocabulary)
        assert "".join(decoder.feed([t]) for t in expected) + decoder.finish() == text


@pytest.mark.parametrize("unit", ["a", "ab", "=", "中文", " ", " \n", "1", "....a"])
def test_words_longer_than_a_chunk(library, vocabulary, unit):
    for end in ("", " q", "z", "\n\nk", "<|endoftext|>x"):
        text = "x " + unit * 90_000 + end
        assert _encoded(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


def test_tokens_before_the_lookahead_never_change(library, vocabulary):
    r = random.Random(5)
    for _ in range(30):
        data = "".join(r.choice("etaoinshrdluaaee") for _ in range(3 * vocabulary.lookahead))
        run = bpe._Run(vocabulary)
        early = list(run.feed(data.encode()))
        for tail in ("", "ing", "e" * 40, "zq"):
            assert library.encode(data + tail, add_special_tokens=False).ids[: len(early)] == early


def test_bytes_that_are_no_text(vocabulary):
    for data in (b"\xff", b"a\xe4\xb8", b"\xe4\xb8\x41", b"\xf0\x9f\x8e", b"\xc3\xc3\xa9", b"\xe0\x80\x80"):
        tokens = [vocabulary.byte_ids[b] for b in data]
        decoder = bpe.Decoder(vocabulary)
        assert "".join(decoder.feed([t]) for t in tokens) + decoder.finish() == data.decode("utf-8", "replace")


def test_merges_that_come_too_early_are_refused():
    text = bpe.read_vocabulary(PATH)
    import json

    data = json.loads(text)
    data["model"]["merges"] = data["model"]["merges"][::-1]
    with pytest.raises(ValueError, match="later merges"):
        bpe.Vocabulary(json.dumps(data))


def test_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello  world", "x"), (3, "hello  world", "x"), (None, "tab\tend ", None), (5, "long " * 40_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in bpe.round_trip(docs, PATH).collect())
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((str(doc), len(ids), digest(",".join(map(str, ids))), digest(text or "")))
    assert got == sorted(expected)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
