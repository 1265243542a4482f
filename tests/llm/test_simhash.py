import random

import numpy as np
import xxhash

from docvet.llm import simhash

MASK = (1 << 64) - 1


def brute(text, k=3):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def classes(rows, budget):
    """[(class id, links)] by comparing every pair; two classes may share an id that two rows have."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and (rows[a][1] ^ rows[b][1]).bit_count() <= budget:
                links[a] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for a, (i, _) in enumerate(rows):
        ids.setdefault(find(a), []).append(i)
    least = {r: min((i for i in group if i is not None), default=None) for r, group in ids.items()}
    classes.heads = sorted(map(str, least.values()))
    return [(least[find(a)], links[a]) for a in range(len(rows))]


def test_fingerprints_and_classes(spark, make_docs, odd_rows):
    got = [(r.doc_id, r.fp & MASK, r.component_id, r.links) for r in simhash.near_duplicates(make_docs(odd_rows)).collect()]
    rows = [(i, brute(t)) for i, t in odd_rows]
    want = [(i, f, c, n) for (i, f), (c, n) in zip(rows, classes(rows, 3))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_runs_of_long_texts_join(monkeypatch):
    rng = random.Random(1)
    text = " ".join(f"x{rng.randrange(99)}" for _ in range(5000))
    monkeypatch.setattr("docvet.llm.common.RUN_BYTES", 100)
    assert simhash.fingerprint(text) & MASK == brute(text)


def test_trie_join_equals_all_pairs(spark):
    """Dense clusters and random keys, with small nodes so that Spark walks the upper levels too."""
    rng = random.Random(7)
    keys = {0, MASK}
    for _ in range(12):
        center = rng.getrandbits(64)
        keys |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(30)}
    keys |= {rng.getrandbits(64) for _ in range(150)}
    keys = sorted(keys)
    n = [1 + k % 3 for k in range(len(keys))]
    df = spark.createDataFrame([(int(np.uint64(k).astype(np.int64)), c) for k, c in zip(keys, n)], "fp bigint, n bigint")
    for leaf, stride in ((16, 2), (4, 4), (10_000, 2)):
        found = simhash.link(df, 3, leaf, stride).collect()
        linked, parent = {}, {k: k for k in keys}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in found:
            linked[r.fp & MASK] = linked.get(r.fp & MASK, 0) + r.linked
            a, b = find(r.fp & MASK), find(r.root & MASK)
            parent[max(a, b)] = min(a, b)
        truth = {k: k for k in keys}

        def top(x):
            while truth[x] != x:
                x = truth[x]
            return x

        for i, a in enumerate(keys):
            total = 0
            for j, b in enumerate(keys):
                if i != j and (a ^ b).bit_count() <= 3:
                    total += n[j]
                    truth[max(top(a), top(b))] = min(top(a), top(b))
            assert linked.get(a, 0) == total
        assert [find(k) for k in keys] == [top(k) for k in keys]


def test_one_stays_and_empty_table(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(i, brute(t)) for i, t in odd_rows]
    classes(rows, 3)
    assert sorted(str(r.doc_id) for r in kept.collect()) == classes.heads
    assert simhash.near_duplicates(docs.where("false")).count() == 0 and simhash.keep_one(docs.where("false")).count() == 0
