import random

import numpy as np

from docvet.llm import importance as I


def corpus(rng, n=300):
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.8
        words = [f"g{rng.randrange(200)}" for _ in range(rng.randrange(20, 80))]
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words) if k % 2 else " ".join([words[0]] * 50)
        rows.append((k, text))
        if k % 2 == 0 or k % 5 == 0:
            labels.append((k, int(good)))
    return rows, labels


def test_good_stay_bad_go(spark, make_docs, odd_rows):
    rows, labels = corpus(random.Random(1))
    docs = make_docs(rows + [(1000, None), (1001, "")])
    known = spark.createDataFrame([(i, q, 0) for i, q in labels] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    scores, model, cut = I.sample(docs, known)
    got = {r.doc_id: r for r in scores.collect()}
    assert len(got) == 302 and got[1000].log_weight == got[1001].log_weight == 0 and got[1000].selected
    assert all(got[i].selected == bool(q) for i, q in labels)
    assert sum(r.selected for r in got.values()) == sum(r.log_weight >= model.level for r in got.values())
    kept = I.keep_selected(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.selected}


def test_model_equals_counts(spark, make_docs):
    rows = [(1, "a b a"), (2, "b b c"), (3, "a c")]
    known = spark.createDataFrame([(1, 1), (3, 1)], "doc_id bigint, quality int")
    model = I.fit(make_docs(rows), known, seed=1)
    size, words = len(model.ratios), I.Words()
    total, target = np.ones(size), np.ones(size)
    for i, text in rows:
        n = np.bincount(I.gram_buckets(text, size, words), minlength=size)
        total += n
        if i in (1, 3) and spark.sql(f"SELECT pmod(xxhash64(1, CAST({i} AS BIGINT)), 3) < 2 AS t").first().t:
            target += n
    assert np.allclose(model.ratios, np.log(target / target.sum()) - np.log(total / total.sum())) and model.level == 0


def test_kth_greatest(spark):
    rng = random.Random(2)
    values = [rng.choice((0.0, rng.gauss(0, 1), 1e300, -5.5)) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 700, 1500, 3000):
        assert I.kth_greatest(df, "v", k, bins=8, exact=5) == sorted(values, reverse=True)[k - 1]
    assert I.kth_greatest(df, "v", 0) == float("inf") and I.kth_greatest(df.where("false"), "v", 3) == float("inf")


def test_odd_and_empty_tables(spark, make_docs, odd_rows):
    known = spark.createDataFrame([], "doc_id bigint, quality int")
    docs = make_docs(odd_rows)
    scores, _, _ = I.sample(docs, known, k=10)
    got = scores.collect()
    assert len(got) == len(odd_rows) and sum(r.selected for r in got) >= 10
    assert {len({r.key for r in got if r.doc_id == 12})} == {1}  # repeated rows share their key
    assert I.keep_selected(docs.where("false"), known).count() == 0
    drawn = I._gumbel(np.arange(200_000, dtype=np.int64), 3)
    assert abs(drawn.mean() - 0.5772) < 0.02 and abs(drawn.var() - np.pi**2 / 6) < 0.05
