import random

from docvet.llm import near_copies as N


def brute(rows, least=0.8):
    """Class of each row: the least id reachable by pairs of texts as similar as `least`."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9 and both:
                root[find(i)] = find(j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return [min(g) for g in groups.values()]


def copies(rng, count, base, edits):
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


def test_equals_brute_force(spark, make_docs, odd_rows):
    rng = random.Random(12)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        texts += copies(rng, 6, base, (1, 2, 4, 8))
    rows = [(5000 + k, t) for k, t in enumerate(texts)] + [r for r in odd_rows if r[0] is not None]
    want = brute(rows)
    kept = N.keep_one(make_docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert 50 < len(want) < len(rows) - 45
    assert N.keep_one(make_docs(rows).where("false")).count() == 0


def test_chains_across_parts(spark, make_docs, monkeypatch):
    """Chains in which no text is like all others, in clusters of several parts."""
    monkeypatch.setattr(N, "PART_NODES", 4)
    rng = random.Random(13)
    rows = []
    for c in range(3):
        w = [f"c{c}w{k}" for k in range(100)]
        for k in range(40):
            rows.append((1000 * c + k, " ".join(w)))
            for _ in range(2 if k % 13 else 7):
                w[rng.randrange(100)] = f"n{rng.randrange(99999)}"
    want = brute(rows)
    assert sorted(r.doc_id for r in N.keep_one(make_docs(rows)).collect()) == sorted(want)
    assert 3 < len(want) < 60


def test_stage_takes_five_words_at_080(spark, make_docs):
    import corpus_pipeline

    rng = random.Random(14)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = [" ".join(base), " ".join([*base[:50], "p", *base[51:120], "q", *base[121:]])]
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, make_docs(list(enumerate(texts))), "").collect()] == [0]
