"""Ids and texts against the public library itself."""

import random

import public_tokenizers
import pytest

from docvet.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coder():
    return pieces.pieces(MODEL)


def same(coder, text):
    assert coder.encode(text).tolist() == coder.library.encode(text), text[:80]


def test_random_texts(coder):
    rng = random.Random(5)
    odd = [chr(c) for c in [*range(1, 128), 0x2581, 0x3000, 0xE9, 0x4E00, 0x6570, 0x636E, 0x1F600, 0x627, 0x644, 0x301]]
    known = sorted(coder.piece)
    for n in (1, 2, 3, 5, 8, 20, 60, 300):
        for _ in range(60):
            same(coder, "".join(rng.choices(odd, k=n)))
            same(coder, "".join(rng.choices("abetrins ▁\n  ()=-_", k=n)))
            same(coder, "".join(coder.piece[k] for k in rng.choices(known, k=n)))


@pytest.mark.parametrize("text", [" " * 40_000, "a" * 40_000, "\n" * 40_000, "-" * 30_000 + " " * 777 + "=" * 5000, "ab" * 30_000, "▁" * 17 + "x", "お前" * 20_000, "e" * 20_000 + " the"])
def test_long_runs(coder, text):
    same(coder, text)


def test_steps_back_over_blocks(coder, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 5)
    rng = random.Random(6)
    for _ in range(200):
        same(coder, "".join(rng.choices("etaoinshr", k=80)))


def test_neighbours_fit_as_merged(coder):
    """fit() is what merging the joint characters gives."""
    rng = random.Random(7)
    known = [i for i in sorted(coder.piece) if coder.history(i)]
    for a, b in zip(rng.choices(known, k=3000), rng.choices(known, k=3000)):
        symbols = list(coder.piece[a] + coder.piece[b])
        while True:
            able = [(-coder.score[x + y], k) for k, (x, y) in enumerate(zip(symbols, symbols[1:])) if x + y in coder.score]
            if not able:
                break
            k = min(able)[1]
            symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
        assert coder.fit(a, b) == (symbols == [coder.piece[a], coder.piece[b]])


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    own = pieces.Pieces(MODEL)
    rng = random.Random(8)
    for _ in range(300):
        same(own, "".join(rng.choices("abcdef gh", k=30)))
    assert len(own.parts) <= 20 and len(own.merges) <= 20


def test_rows(make_docs, odd_rows, coder):
    docs = make_docs(odd_rows)
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in pieces.encode_texts(docs, MODEL).collect()), key=str)
    want = sorted(((i, coder.library.encode(t or ""), coder.library.decode(coder.library.encode(t)) if t else "") for i, t in odd_rows), key=str)
    assert got == want


def test_empty_table(make_docs):
    assert pieces.encode_texts(make_docs([]), MODEL).collect() == []
