import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from driftsum.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(bpe.default_vocabulary())


def same(library, encoder, texts):
    for text, other in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text).tolist() == other.ids, text[:80]


def test_like_the_library_on_mixtures(library, encoder):
    r = random.Random(4)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "<|endoftext|>", "'s", "'ll", "é", "日本", "0", "1234", "!", "??", "aaaa", "AB", "\x85", "\x1c", " ", "\U0001f600", "ß"]
    same(library, encoder, ["".join(r.choices(parts, k=r.randint(0, 50))) for _ in range(3000)])
    same(library, encoder, ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=400)) for _ in range(100)] + ["a" * n for n in range(200)] + [" " * n for n in range(200)])


def test_like_the_library_on_every_character(library, encoder):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(library, encoder, ["a" + "".join(points[i : i + 64]) + " 1" for i in range(0, len(points), 64)])


def test_naive_merges_agree(encoder):
    r = random.Random(6)

    def naive(piece):
        out = [encoder.ids[c] for c in piece]
        while True:
            ranks = [(encoder.merge[a, b], i) for i, (a, b) in enumerate(zip(out, out[1:], strict=False)) if (a, b) in encoder.merge]
            if not ranks:
                return out
            _, i = min(ranks)
            out[i : i + 2] = [merged[out[i], out[i + 1]]]

    merged = {v[:2]: k for k, v in encoder.parts.items()}
    for _ in range(400):
        piece = "".join(r.choices("etaoinshr th", k=r.randint(1, 30)))
        assert encoder.encode_piece(piece) == naive(piece)


def test_decoding(library):
    decoder, r = bpe.decoder(bpe.default_vocabulary()), random.Random(9)
    for _ in range(500):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 30))]
        assert decoder.decode(np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False)


def test_hard_texts(hard, library):
    encoded = bpe.encode_documents(hard)
    rows = bpe.decode_documents(encoded).collect()
    key = lambda x: repr((x is not None, x))
    texts = sorted(((r["doc_id"], r["text"] or "") for r in hard.collect()), key=key)
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=key) == texts
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["text"], add_special_tokens=False).ids


def test_empty_table(nothing):
    assert bpe.decode_documents(bpe.encode_documents(nothing)).collect() == []
