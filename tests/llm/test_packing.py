import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from docvet.llm import packing

VOCABULARY, TOKENIZER = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def nnls(a, b, rounds=20_000):
    """Projected gradient, to compare the residual with."""
    x = np.zeros(a.shape[1])
    step = 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(rounds):
        x = np.maximum(0, x - step * (a.T @ (a @ x - b)))
    return x


def test_repeats_are_least_squares():
    combos = packing.combinations(12)
    histogram = np.random.default_rng(2).integers(0, 40, 13)
    histogram[0] = histogram[5] = 0
    usable = (histogram > 0)[combos] | (combos == 0)
    a = np.zeros((13, len(combos)))
    for c, row in enumerate(combos):
        for k in row[row > 0]:
            a[k, c] += 1
    able = usable.all(axis=1)
    x = packing.repeats(histogram, combos)
    y = nnls(a[:, able], histogram.astype(float))
    assert (x >= 0).all() and np.sum((a @ x - histogram) ** 2) <= np.sum((a[:, able] @ y - histogram) ** 2) + 1e-3


@pytest.mark.parametrize("seed", range(4))
def test_blocks_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    tokens = [rng.integers(1, 6000, 900), np.full(500, 1500), np.array([1]), rng.integers(1, 40, 2000)][seed]
    doc, start, length, sequence, offset = packing.pack_block(tokens, 2048)
    ends = {}
    for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist()):
        assert s == ends.get(d, 0) and n > 0
        ends[d] = s + n
    assert [ends[d] for d in range(len(tokens))] == tokens.tolist()
    order = np.lexsort((offset, sequence))
    total = {}
    for q, o, n in zip(sequence[order].tolist(), offset[order].tolist(), length[order].tolist()):
        assert o == total.get(q, 0)
        total[q] = o + n
    assert max(total.values()) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in total.values())
    assert padding <= 0.01 * tokens.sum() + 32


def test_ids_are_those_of_the_tokenizer(spark, make_docs, odd_rows):
    rows = [(k, t) for k, (_, t) in enumerate(odd_rows)] + [(900, "<|endoftext|> it's 12,345  \n\n x"), (901, "naïve ﬁ 漢字😀​")]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = make_docs(rows)
    got = {}
    for r in packing.pack(docs, VOCABULARY, P.PATTERN, TOKENIZER).orderBy("doc_id", "start").collect():
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length and r.start == len(got.setdefault(r.doc_id, []))
        got[r.doc_id] += ids
    for k, text in rows:
        assert got[k] == t.encode(text or "", add_special_tokens=False).ids + [1]
    assert packing.pack(docs.where("false"), VOCABULARY, P.PATTERN, TOKENIZER).count() == 0


def test_very_long_runs(spark, make_docs):
    rows = [(k, t) for k, t in enumerate((" " * 3_000_000, "x" + "\n" * 3_000_000 + "y", "a" * 3_000_000, " \t\n" * 400_000 + "end", "short"))]
    t = Tokenizer.from_file(TOKENIZER)
    got = {}
    for r in packing.pack(make_docs(rows), VOCABULARY, P.PATTERN, TOKENIZER).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, dtype="<u4").tolist())
    assert all(got[k] == t.encode(x, add_special_tokens=False).ids + [1] for k, x in rows)


def test_blocks_in_a_task(spark, make_docs, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 300)
    got = packing.pack(make_docs([(k, "some words here " * (k % 9)) for k in range(200)]), VOCABULARY, P.PATTERN, TOKENIZER).collect()
    assert {r.doc_id for r in got} == set(range(200))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
