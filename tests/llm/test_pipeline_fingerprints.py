"""The stage near_duplicates walks the trie of fingerprints: it drops what only they link."""

import corpus_pipeline as C
from docvet.llm import near_copies, simhash


def test_texts_of_one_fingerprint_are_one_document(spark):
    tail = lambda w: " ".join(f"{w}{k}" for k in range(30))
    rows = [(k, "red green blue " * 50 + tail(w)) for k, w in enumerate(("east", "west"))] + [(2, tail("north"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert simhash.fingerprint(rows[0][1]) == simhash.fingerprint(rows[1][1])
    assert near_copies.keep_one(docs).count() == 3
    assert sorted(r.doc_id for r in C.near_duplicates(spark, docs, "").collect()) == [0, 2]
