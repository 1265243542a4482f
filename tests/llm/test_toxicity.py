import itertools
import random

import numpy as np

from docvet.llm import toxicity as X


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    crf = X.Field(None, rng.normal(size=(2, 2)), rng.normal(size=2))
    chains = [rng.normal(size=n) * 3 for n in (5, 0, 1, 8, 3, 0, 2)]
    got, at = X.marginals(chains, crf), 0
    for p in chains:
        total, weight = 0.0, np.zeros(len(p))
        for y in itertools.product((0, 1), repeat=len(p)) if len(p) else ():
            v = np.exp(crf.start[y[0]] + sum(p[t] * y[t] for t in range(len(p))) + sum(crf.move[y[t - 1], y[t]] for t in range(1, len(p))))
            total, weight = total + v, weight + v * np.array(y)
        assert not len(p) or np.allclose(weight / total, got[at:at + len(p)])
        at += len(p)


def test_training_climbs_to_labels():
    ids = np.array([[0, 1, 2, 0], [2, 0, 0, 0], [0, 2, 1, 0]])
    labels = (ids == 1).astype(np.int8)
    words = np.array([X.features(w) for w in ("plain", "slur", "other")])
    crf = X._train(ids, labels, np.array([3, 2, 4]), words, 60, 0.5)
    p = X.marginals([X.Words(crf).potentials("plain slur other"), X.Words(crf).potentials("other plain")], crf)
    assert p[1] > 0.5 > max(p[0], p[2], p[3], p[4])


def test_spans_scores_and_odd_rows(spark, make_docs, odd_rows):
    rng = random.Random(3)
    bad = ["vile", "nasty", "foul"]
    rows, labels = list(odd_rows), []
    for k in range(2000, 2400):
        words = [f"t{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        toxic = k % 5 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs = make_docs(rows)
    known = spark.createDataFrame([(i, x) for i, x in labels if i % 4] + [(None, 1), (2001, None)], "doc_id bigint, toxic int")
    got = X.score(docs, X.fit(docs, known)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    texts = dict(rows)
    for i, toxic in labels:
        assert (by_id[i].score >= 0.3) == bool(toxic)
        assert {w for s in by_id[i].spans for w in texts[i][s.start:s.end].split()} <= set(bad) and bool(by_id[i].spans) == bool(toxic)
    assert len({r.score for r in got if r.doc_id == 12}) == 1 and by_id[4].score < 0.3 and by_id[5].score == by_id[4].score
    assert X.score(docs.where("false"), X.fit(docs.where("false"), known)).count() == 0


def test_no_labels(spark, make_docs):
    crf = X.fit(make_docs([(1, "a b"), (2, "c")]), spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int"))
    assert crf.score(np.array([0.0, 0.9])).max() < 0.01
