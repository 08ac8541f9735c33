"""Encoding and decoding against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tests.llm.test_operators import ODD_TEXTS, frame, odd
from wickmill.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return sp.Pieces(sp.read_model(PATH))


ODD = [
    *(t for t in ODD_TEXTS if t is not None),
    "  ", "x▁y", "▁", " ▁ ▁a", "ﬁ\x00", "<s></s><unk><0x41>", "🙂🙂👨‍👩‍👧", "a\r\nb\t", "  lead", "trail  ", "﻿x", " a",
    "\U0010ffff", "aaaaab" * 300, "abcdefgh" * 4000, "日本語のテキスト" * 2000,
]


def test_odd_texts_as_the_library_does(library, coder):
    for text, ids in zip(ODD, coder.encode(ODD)):
        assert ids == library.encode(text) + [library.eos_id()]
        assert coder.decode(ids) == library.decode(ids)


def test_random_texts_as_the_library_does(library, coder):
    rng = random.Random(5)
    pool = [piece.replace("▁", " ") for piece in coder.ids]
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 14))) for _ in range(3000)]
    texts += ["".join(rng.choices("ab \n▁é日🙂thein  0019", k=rng.randrange(1, 60))) for _ in range(2000)]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids == library.encode(text) + [library.eos_id()]
        assert coder.decode(ids) == library.decode(ids)


def test_bytes_that_are_no_text_decode_as_the_library_does(library, coder):
    rng = random.Random(6)
    for _ in range(300):
        ids = [coder.byte_ids[rng.randrange(1, 256)] if rng.random() < 0.3 else rng.randrange(300, coder.size) for _ in range(8)]
        joined = [k for n, k in enumerate(ids) if n == 0 or not (k in coder.byte_ids.values() and ids[n - 1] in coder.byte_ids.values())]
        valid = [k for k in joined if k not in coder.byte_ids.values() or coder.surface[k].isascii()]
        assert coder.decode(valid) == library.decode(valid)


def test_memory_of_words_is_bounded_and_changes_nothing(coder, monkeypatch):
    texts = [f"word{k} " * 3 for k in range(50)]
    whole = coder.encode(texts)
    monkeypatch.setattr(sp, "REMEMBERED", 10)
    monkeypatch.setattr(sp, "BLOCK", 20)
    assert [coder.encode([t])[0] for t in texts] == whole
    long = "b" * (sp.LONGEST_REMEMBERED + 1)
    coder.encode([long])
    assert sp.MARK + long not in coder.known


def test_digests_of_documents(spark, library):
    docs = odd(spark)
    got = sp.encoding_digests(docs, PATH).collect()
    assert len(got) == docs.count()
    want = []
    for row in docs.select("doc_id", "text").collect():
        ids = library.encode(row.text or "") + [library.eos_id()]
        hexes = [hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), library.decode(ids))]
        want.append((row.doc_id, len(ids), *hexes))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sp.encoding_digests(docs.limit(0), PATH).collect() == []
    kept = {r.doc_id: r for r in sp.encode_and_decode(frame(spark, ["a b", None]), PATH).collect()}
    assert kept[0].decoded == "a b" and kept[1].ids == [2] and kept[1].decoded == ""
