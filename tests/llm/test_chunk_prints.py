import hashlib

import numpy as np

from docvet.llm import chunk_prints as C


def test_gear_and_boundaries(monkeypatch):
    data = np.random.default_rng(0).integers(0, 256, 5000, dtype=np.uint8)
    want, h = [], 0
    for b in data.tolist():
        h = ((h << 1) + int(C._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert C.gear(data).tolist() == want
    ends, start, plain = C.boundaries(data.tobytes()), 0, []
    while start < len(data):
        for k in range(start, len(data)):
            size = k + 1 - start
            mask = C.STRICT if size < C.NORMAL else C.LOOSE
            if size >= C.LEAST and want[k] & int(mask) == 0 or size == C.MOST:
                break
        start = k + 1
        plain.append(start)
    assert ends == plain
    monkeypatch.setattr(C, "BLOCK", 700)
    assert C.boundaries(data.tobytes()) == ends


def test_shift_resistance():
    text = " ".join(f"word{k * 7919 % 1000}" for k in range(600))
    a, b = C.chunk_set(text), C.chunk_set("An edit in front. " + text)
    assert C.likeness(a, b) > 0.9 and C.likeness(a, C.chunk_set(text[::-1])) < 0.1
    assert C.from_text(C.as_text(a)) == a and C.likeness({}, {}) == 1 and C.likeness(a, a) == 1 and C.likeness({}, a) == 0


def test_study_equals_brute_force(spark, make_docs, odd_rows):
    rows = [(i, t) for i, t in odd_rows if i != 9] + [(200, None), (200, "again " * 9)]
    for ranges in (1, 3, 40):
        got = C.edit_study(make_docs(rows), ranges=ranges).collect()
        assert len(got) == len(rows)
        by_id = {}
        for i, t in rows:
            by_id.setdefault(i, []).append(t or "")
        order = sorted(by_id, key=lambda i: (i is not None, i or 0))
        for r in got:
            if len(by_id[r.doc_id]) > 1:
                continue  # the order of rows of one id is theirs to choose
            text = by_id[r.doc_id][0]
            nexts = by_id[order[(order.index(r.doc_id) + 1) % len(order)]]
            hits = [n for n in nexts if hashlib.sha256(C.edit(text, n).encode()).hexdigest() == r.edited_sha256]
            assert hits and r.n_chars == len(text) and r.fingerprint == C.as_text(C.chunk_set(text))
            assert r.edited_fingerprint == C.as_text(C.chunk_set(C.edit(text, hits[0])))
            assert abs(r.near_edited - C.likeness(C.chunk_set(text), C.chunk_set(C.edit(text, hits[0])))) < 1e-12
            assert any(abs(r.near_next - C.likeness(C.chunk_set(text), C.chunk_set(n))) < 1e-12 for n in nexts)


def test_single_and_empty(spark, make_docs):
    one = C.edit_study(make_docs([(5, "abcdefgh")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1
    assert C.edit_study(make_docs([(5, "x")]).where("false")).count() == 0
    assert C.fingerprints(make_docs([(5, None)])).first().fingerprint == ""
