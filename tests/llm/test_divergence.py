"""The audit against a plain count of every term in every group."""

import random
import re
from collections import Counter

import numpy as np

from docvet.llm import divergence

FIELDS = "lang string, source string, text string, doc_id bigint, part string, item string, rank int, n int, term string, z string, total string, p int"


def brute(rows, least=3, ranks=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for _, _, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        held = Counter(w for r, ws in zip(rows, words) if r[0] == lang for w in set(ws))
        kept = sorted((w for w, n in held.items() if n >= least), key=lambda w: w.encode())

        def shares(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 1) // (total + len(kept)) for w in kept}

        counts = {}
        for r, ws in zip(rows, words):
            if r[0] == lang:
                counts.setdefault(r[1], Counter()).update(ws)
        q = shares(sum(counts.values(), Counter()))
        p = {s: shares(c) for s, c in counts.items()}
        f = lambda x, y: (x - y) * (x - y) // y
        for s in counts:
            pair = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in counts if o != s]
            term = [(f(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pair, None), ("term", term, ranks)):
                for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, s, part, item, v, k + 1))
    return out


def check(spark, rows, **other):
    docs = spark.createDataFrame([(*r, 1, "a", "b", 1, 2, "c", "d", "e", 3) for r in rows], FIELDS).repartition(3)
    got = [tuple(r) for r in divergence.audit(docs, **other).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, **({"least": other["least_docs"]} if "least_docs" in other else {}), ranks=other.get("ranks", 200))
    return got


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    pool = ["the", "The", "été", "Été", "été", "x", "naïve", "漢字", "İ", "zz"] + [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(8) for b in range(8)]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "ß", None]), " ".join(rng.choices(pool, k=rng.randrange(40))) + rng.choice([".", "1", "_x_", ""])) for _ in range(150)]
    rows += [("en", "empty", None), ("en", "empty", ""), ("solo", "only", "one two"), ("nil", "a", "one"), ("nil", "b", "12 34"), ("en", "s1", "hot " * 5000), *[("en", "s1", "same text here")] * 4]
    got = check(spark, rows)
    assert {r[4] for r in got if r[0] == "nil"} == {0}
    check(spark, rows, least_docs=1, ranks=3)


def test_long_text_and_empty_table(spark):
    rng = random.Random(2)
    rows = [("en", s, " ".join(rng.choices(["aa", "bb", "cc", "dd"], k=400_000 if s == "a" else 50))) for s in ("a", "b", "c")] + [("en", "d", "q" * 300_000)]
    check(spark, rows)
    assert check(spark, []) == []


def test_joint_tables_of_panels(monkeypatch):
    """A block's prices are those of every two groups' cells, however its columns are cut."""
    rng = np.random.default_rng(3)
    row = np.repeat(np.arange(60), 5)
    group = np.concatenate([rng.permutation(7)[:5] for _ in range(60)])
    level = rng.integers(1, 9, 300)
    z = group * 3 + 2
    p = z + level * 11
    want = {}
    for a in range(300):
        for b in range(300):
            if row[a] == row[b] and group[a] != group[b]:
                f = lambda x, y: int((x - y) ** 2 // y)
                value = f(p[a], p[b]) - f(p[a], z[b]) - f(z[a], p[b]) + f(z[a], z[b])
                want[int(group[a]), int(group[b])] = want.get((int(group[a]), int(group[b])), 0) + value
    for panel in (3, 16, 2048):
        monkeypatch.setattr(divergence, "PANEL", panel)
        a, b, value = divergence.joint_prices(row, group.astype(np.int64), level, p, z)
        assert dict(zip(zip(a.tolist(), b.tolist()), value.tolist())) == want


def test_shares_beyond_64_bits(spark):
    one = spark.range(1).select(divergence.share(divergence.F.lit(9 * 10**18), divergence.F.lit(9 * 10**18 + 5), divergence.F.lit(10**9)).alias("p")).first().p
    assert one == 1 + 10**9 * (9 * 10**18 + 1) // (9 * 10**18 + 5 + 10**9)
