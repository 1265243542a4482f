import random
import time

import numpy as np

from docvet.llm import contamination as C


def smith_waterman(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_plain_recursion():
    rng = np.random.default_rng(5)
    left, right = rng.integers(1, 6, (60, 12)).astype(np.uint64), rng.integers(1, 6, (60, 20)).astype(np.uint64)
    left[:, 9:] = np.where(rng.random((60, 1)) < 0.5, 0, left[:, 9:])
    best, _, end = C.align(left, right)
    for k in range(60):
        assert best[k] == smith_waterman([x for x in left[k] if x], right[k].tolist())
    assert (end <= 20).all()


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [f"new{rng.randrange(99)}"] if x < 2 * share / 3 else [w, "also"] if x < share else [w]
    return out


def test_copies_are_found_and_others_left(spark, make_docs, odd_rows):
    rng = random.Random(6)
    common = [f"c{k}" for k in range(12)]
    items = {k: [rng.choice(common) if rng.random() < 0.5 else f"b{rng.randrange(3000)}" for _ in range(rng.randrange(15, 300))] for k in range(12)}
    rows, truth = [r for r in odd_rows if r[0] != 9], set()
    for k in range(240):
        body = [rng.choice(common) if rng.random() < 0.5 else f"d{rng.randrange(3000)}" for _ in range(rng.randrange(20, 200))]
        if k % 2:
            item, share = k % 12, rng.choice((0, 0.1, 0.15))
            at = rng.randrange(len(body))
            body[at:at] = edited(rng, items[item], share)
            truth.add((5000 + k, item))
        rows.append((5000 + k, " ".join(body).capitalize() + "."))
    tests = [(k, " ".join(w).title(), 1, "x") for k, w in items.items()] + [(90, None, 1, "x"), (91, "", 1, "x"), (92, "too short", 1, "x"), (None, "w " * 20, 1, "x")]
    benchmark = spark.createDataFrame(tests, "item_id bigint, text string, k1 int, score string")
    docs = make_docs(rows)
    leaks = C.find_leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in leaks} == truth
    texts = dict(rows)
    for r in leaks:
        part = texts[r.doc_id][r.start:r.end].lower().strip(".").split()
        assert 0.5 <= r.score <= 1 and len(part) > 5 and (r.score < 1 or part == items[r.item_id][:128] or len(items[r.item_id]) > 128)
    kept = C.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len({d for d, _ in truth})
    assert C.find_leaks(docs.where("false"), benchmark).count() == 0 and C.find_leaks(docs, benchmark.where("false")).count() == 0


def test_blocks_of_items(spark, make_docs, monkeypatch):
    rng = random.Random(8)
    items = [(k, " ".join(f"z{rng.randrange(9999)}" for _ in range(30))) for k in range(6)]
    docs = make_docs([(k, f"start {t} end") for k, t in items])
    monkeypatch.setattr(C, "BLOCK_WORDS", 50)
    leaks = C.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.score, r.start) for r in leaks) == [(k, k, 1.0, 6) for k in range(6)]


def test_common_items_keep_seeds():
    """Every run of n + spread - 1 unchanged words has a seed, though all n-grams are counted as common."""
    words = np.random.default_rng(9).integers(1, 1 << 63, 60).astype(np.uint64)
    p = C.Passages(np.array([0]), np.array([1]), np.array([0]), np.array([60]), words)
    grams = C.gram_hashes(words, 3)
    seeds = p.seeds(3, 4, {int(g): 10**9 for g in grams})
    for at in range(55):
        assert any(len(x[0]) for x in seeds.hits(C.gram_hashes(words[at:at + 6], 3)))


def test_evenly_spaced_edits(spark, make_docs):
    """Copies with every k-th word replaced, beside whole copies that hold what the edits have destroyed."""
    rng = random.Random(10)
    items = {k: [f"e{rng.randrange(9999)}" for _ in range(rng.randrange(20, 60))] for k in range(20)}
    rows, truth, long = [], set(), set()
    for k, w in items.items():
        for step in (4, 5, 6):
            for shift in range(step):
                copy = [f"y{rng.randrange(9999)}" if j % step == shift else x for j, x in enumerate(w)]
                body = [f"d{rng.randrange(9999)}" for _ in range(40)]
                body[20:20] = copy
                rows.append((1000 * k + 10 * step + shift, " ".join(body)))
                score = smith_waterman(w, body)
                if score >= 0.5 * len(w):
                    truth.add((rows[-1][0], k))
                elif score >= 20:
                    long.add((rows[-1][0], k))
        if k % 2:
            rows.append((1000 * k, " ".join(w)))
            truth.add((1000 * k, k))
    leaks = C.find_leaks(make_docs(rows), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string"))
    assert truth <= {(r.doc_id, r.item_id) for r in leaks.collect()} <= truth | long and len(truth) > 200


def test_parts_of_long_items_and_short_items(spark, make_docs):
    rng = random.Random(11)
    fresh = lambda c, n: [f"{c}{rng.randrange(99999)}" for _ in range(n)]
    long, mid = fresh("l", 300), fresh("m", 59)
    items = {1: long, 2: mid, 3: ["one", "short", "item", "here"], 4: ["two", "parts"], 5: ["single"]}
    inner = {
        10: (long[65:191], {1}), 11: (long[10:73], {1}), 12: (mid[20:41], {2}), 13: (items[3], {3}), 14: (items[4], {4}), 15: (items[5], {5}),
        16: (["one", "short", "x", "item", "here"], set()), 17: (["two", "x", "parts"], set()), 18: (mid[20:36], set()), 19: (long[280:], {1}),
    }
    rows = [(k, " ".join(fresh("d", 30) + body + fresh("d", 30))) for k, (body, _) in inner.items()]
    leaks = C.find_leaks(make_docs(rows), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in leaks} == {(k, i) for k, (_, found) in inner.items() for i in found}
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start:r.end].split() == inner[r.doc_id][0] for r in leaks if r.doc_id in (12, 13, 14, 15))


def test_repeated_items_have_their_rows(spark, make_docs, monkeypatch):
    rng = random.Random(12)
    text = " ".join(f"r{rng.randrange(9999)}" for _ in range(30))
    other = " ".join(f"s{rng.randrange(9999)}" for _ in range(30))
    docs = make_docs([(1, f"a {text} b"), (2, f"a {other} b"), (2, f"a {other} b")])
    benchmark = spark.createDataFrame([(7, text), (7, text), (7, other)], "item_id bigint, text string")
    for words in (1_000_000, 10):
        monkeypatch.setattr(C, "BLOCK_WORDS", words)
        assert sorted((r.doc_id, r.item_id) for r in C.find_leaks(docs, benchmark).collect()) == [(1, 7), (1, 7), (2, 7), (2, 7)]


def test_a_phrase_that_many_items_share(monkeypatch):
    """4,000 passages share four words; a document full of them takes a scan for each passage, not one for each meeting."""
    rng = np.random.default_rng(13)
    known = {}
    phrase = C.words_of("which of the following is", known)
    passages = [np.concatenate([phrase, rng.integers(1, 1 << 63, 40).astype(np.uint64)]) for _ in range(4000)]
    sizes = np.full(4000, 45)
    p = C.Passages(np.arange(4000), np.arange(4000), np.arange(4000) * 45, sizes, np.concatenate(passages))
    seeds, need = {3: p.seeds(3, 1, None)}, np.full(4000, 20)
    text = " ".join(("which of the following is " + " ".join(f"w{k}x{j}" for j in range(75))) for k in range(75))
    start = time.perf_counter()
    assert C.find_matches([text], p, seeds, need) == {}
    assert time.perf_counter() - start < 8
    monkeypatch.setattr(C, "HITS", 700)
    start = time.perf_counter()
    assert C.find_matches([text[:2000]], p, seeds, need) == {}


def test_parts_of_hits_give_the_same(monkeypatch):
    rng = np.random.default_rng(14)
    words = rng.integers(1, 40, 3000).astype(np.uint64)
    p = C.Passages(np.arange(30), np.arange(30), np.arange(30) * 100, np.full(30, 100), words)
    seeds = p.seeds(3, 1, None)
    grams = C.gram_hashes(rng.integers(1, 40, 5000).astype(np.uint64), 3)
    whole = [np.concatenate(x) for x in zip(*seeds.hits(grams))]
    monkeypatch.setattr(C, "HITS", 7)
    assert all((a == np.concatenate(b)).all() for a, b in zip(whole, zip(*seeds.hits(grams)))) and len(whole[0])
