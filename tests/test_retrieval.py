import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docvet.functions import vectors as V
from docvet.operators import retrieval as R
from docvet.operators.chunking import chunk_artifacts, with_metadata
from docvet.operators.embeddings import EmbeddingProvider, chunk_embeddings, query_embeddings

DOC = "# Tool\nOverview text.\n\n## Permissions\nNeeds an API key and network access.\n\n## Risks\nPrompt injection may leak secrets.\n\n## Notes\nNothing else."


def plain_embedding(text):
    tokens = re.findall("[a-z0-9]+", text.lower().replace("_", " ").replace("-", " ")) or ["empty"]
    vector = [0.0] * 64
    for token in tokens:
        digest = hashlib.sha256(f"local-hash-embedding-v1:{token}".encode()).digest()
        vector[int.from_bytes(digest[:4], "big") % 64] += (1 if digest[4] % 2 == 0 else -1) * (1 + digest[5] / 255)
    size = math.sqrt(sum(v * v for v in vector))
    return [round(v / size, 6) if size else v for v in vector]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("a", "README.md", DOC)] + [(f"n{i}", "notes.md", f"filler number {i} about tools\n\nmonkey business {i}") for i in range(40)]
    return chunk_artifacts(spark.createDataFrame(rows, "artifact_id string, path string, raw_text string")).persist()


@pytest.fixture(scope="module")
def index(chunks):
    return R.build_index(chunks, EmbeddingProvider())


def queries(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")


def test_hash_embedding_matches_plain_python(spark):
    texts = ["", "Hello_world foo-bar hello", "api key " * 40]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(V.hash_embedding(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [plain_embedding(t) for t in texts]


def test_lexical_finds_the_right_section(spark, index):
    rows = R.retrieve_lexical(index, queries(spark, "api key network access", "prompt injection secrets", "--")).where("rank = 1").collect()
    top = {r.query_id: r.heading_path[-1] for r in rows}
    assert top == {"q0": "Permissions", "q1": "Risks"}
    assert {r.query_id: r.matched_terms for r in rows}["q0"] == ["api", "key", "network", "access"]


def test_phrase_inside_a_word_still_scores(spark, index):
    rows = R.lexical_scores(index, queries(spark, "onke")).collect()
    assert len(rows) == 40 and all(r.score == 1.0 and r.matched_terms == [] for r in rows)


def tokens(text):
    out = []
    for t in re.findall("[a-z0-9]+", text.lower().replace("_", " ").replace("-", " ")):
        if len(t) > 4 and t.endswith("ies"):
            t = t[:-3] + "y"
        elif len(t) > 3 and t.endswith("s") and not t.endswith(("ss", "us", "is")):
            t = t[:-1]
        out.append(t)
    return out


class BruteForce:
    """Every chunk scored one by one, straight from the definition."""

    def __init__(self, chunks):
        self.docs = [(r.chunk_id, r.chunk_index, tokens(r.text), tokens((r.path or "") + " " + " ".join(r.heading_path)),
                      plain_embedding("\n".join(p for p in [r.path, " > ".join(r.heading_path)] if p) + "\n" + r.text)) for r in chunks.collect()]
        self.mean = max(sum(len(d[2]) for d in self.docs) / len(self.docs), 1)
        self.df = Counter(t for d in self.docs for t in set(d[2]) | set(d[3]))

    def lexical(self, query):
        terms = list(dict.fromkeys(tokens(query)))
        phrase = " ".join(terms)
        scores = []
        for _, _, text, context, _ in self.docs:
            score = 0.0
            for t in terms:
                idf = math.log(1 + (len(self.docs) - self.df[t] + 0.5) / (self.df[t] + 0.5))
                tf = text.count(t)
                if tf:
                    score += idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * max(len(text), 1) / self.mean)))
                score += context.count(t) * idf * 0.35
            if terms:
                score += 1.0 * (phrase in " ".join(text)) + 0.4 * (phrase in " ".join(context))
            scores.append(score)
        return scores

    def top(self, query, k):
        rows = [(-round(s, 9), d[1], d[0]) for d, s in zip(self.docs, self.lexical(query)) if s > 0]
        return [(r[2], round(-r[0], 6)) for r in sorted(rows)[:k]]

    def hybrid(self, query, k):
        lexical = [round(s, 6) for s in self.lexical(query)]
        best = max(lexical)
        q = plain_embedding(query)
        rows = []
        for (cid, index, _, _, v), lex in zip(self.docs, lexical):
            emb = max(0.0, sum(a * b for a, b in zip(q, v)) / (math.sqrt(sum(a * a for a in q)) * math.sqrt(sum(b * b for b in v))))
            norm = lex / best if best else 0.0
            hybrid = 0.6 * norm + 0.4 * emb
            if hybrid > 0:
                rows.append((-round(hybrid, 6), -round(norm, 6), -round(emb, 6), index, cid))
        return [r[4] for r in sorted(rows)[:k]]


@pytest.mark.parametrize("query", ["api key network access", "filler tool", "zebra unknownword", "monkey"])
def test_hybrid_equals_brute_force(spark, chunks, index, query):
    got = R.retrieve_hybrid(index, queries(spark, query), max_results=7).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == BruteForce(chunks).hybrid(query, 7)


@pytest.fixture(scope="module")
def corpus(spark):
    """Chunks of skewed words, some in headings, words inside words, and equal texts."""
    rng = random.Random(7)
    pool = [f"{a}{b}" for a in ("net", "work", "key", "to", "ken") for b in ("", "s", "work", "ing", "ies", "token")]
    pick = lambda n: " ".join(rng.choices(pool, weights=[1 / (k + 1) for k in range(len(pool))], k=n))
    rows = [(f"a{k}", f"docs/{rng.choice(pool)}.md", "\n".join([f"# {pick(2)}", pick(rng.randrange(1, 60)), "", "## " + pick(1), pick(rng.randrange(1, 30))])) for k in range(120)]
    rows += [(f"c{k}", "same.md", "network key token") for k in range(9)]
    asked = [pick(rng.choice([1, 1, 2, 2, 3, 4])) for _ in range(900)] + [rng.choice(pool)[: rng.randrange(1, 5)] for _ in range(60)]
    asked += [f"{rng.choice(pool)[2:]} {rng.choice(pool)[:3]}" for _ in range(40)]
    chunks = chunk_artifacts(spark.createDataFrame(rows, "artifact_id string, path string, raw_text string")).persist()
    return chunks, asked


def test_a_thousand_queries_equal_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_BITS", 3)
    chunks, asked = corpus
    brute, index = BruteForce(chunks), R.build_index(chunks)
    got = {}
    for r in R.retrieve_lexical(index, queries(spark, *asked), max_results=4).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert {q: [c for c, _ in v] for q, v in got.items()} == {f"q{i}": [c for c, _ in top] for i, t in enumerate(asked) if (top := brute.top(t, 4))}
    assert all(abs(s - w) < 2e-6 for i, t in enumerate(asked) for (_, s), (_, w) in zip(got.get(f"q{i}", []), brute.top(t, 4)))


def test_blocks_under_the_threshold_are_not_read(spark, corpus, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_BITS", 1)
    index = R.build_index(corpus[0])
    weighted = R._weighted(index, R.query_terms(queries(spark, "kentoken nets keying tokenies")))
    every = weighted.join(index.blocks, "term").select("block").distinct().count()
    assert 0 < R._surviving_blocks(index, weighted, 1).count() < every


def test_hybrid_over_groups_of_queries_and_chunks(spark, corpus, monkeypatch):
    monkeypatch.setattr(R, "GROUP_BITS", 4)
    monkeypatch.setattr(R, "QUERY_GROUP", 8)
    chunks, asked = corpus
    asked = asked[:30] + asked[-10:] + ["zebra"]
    index, brute = R.build_index(chunks, EmbeddingProvider()), BruteForce(chunks)
    got = {}
    for r in R.retrieve_hybrid(index, queries(spark, *asked), max_results=6).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {f"q{i}": top for i, t in enumerate(asked) if (top := brute.hybrid(t, 6))}


def test_hybrid_hashes_are_those_of_the_records(spark, index, chunks):
    hits = {r.chunk_id: (r.metadata_hash, r.embedding_hash) for r in R.retrieve_hybrid(index, queries(spark, "api key")).collect()}
    records = {r.chunk_id: (r.metadata_hash, r.embedding_hash) for r in chunk_embeddings(with_metadata(chunks)).collect()}
    assert hits and all(records[c] == h for c, h in hits.items())


def test_odd_queries_and_empty_corpus(spark, index, chunks):
    odd = spark.createDataFrame([("a", None), (None, "api"), ("b", ""), ("c", "--"), ("d", "zebra"), ("d", "api"), ("d", "api")], "query_id string, query string")
    assert {r.query_id for r in R.retrieve_lexical(index, odd).collect()} == {"d"}
    assert R.retrieve_lexical(index, odd.where("false")).collect() == [] and R.retrieve_hybrid(index, odd.where("false")).collect() == []
    empty = R.build_index(chunks.where("false"), EmbeddingProvider())
    assert R.retrieve_lexical(empty, odd).collect() == [] and R.retrieve_hybrid(empty, odd).collect() == []


def test_wrong_provider_length_is_an_error(spark, chunks):
    provider = EmbeddingProvider(dimensions=3, embed=lambda c: F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="embedding vector length"):
        query_embeddings(queries(spark, "x"), provider).collect()


def test_outputs_carry_no_query_text_or_vectors(spark, index):
    columns = set(R.retrieve_hybrid(index, queries(spark, "api key")).columns)
    assert not columns & {"query", "vector", "text", "raw_text"}
    assert "query" not in query_embeddings(queries(spark, "api key")).columns


def test_postings_are_built_in_the_chunk_without_a_shuffle_of_tokens(spark, monkeypatch):
    """Slices of a few tokens, long and empty rows, nulls: the postings are those of plain Python."""
    monkeypatch.setattr(R, "SLICE_TOKENS", 5)
    texts = ["keys key b", "", "z " * 40, None, "b keys", "--", "a b c d e f g"]
    rows = [(f"c{i}", i, "a", 1, 1, "paragraph", "p.md", ["Key b"], t, "h") for i, t in enumerate(texts)]
    fields = "chunk_id string, chunk_index int, artifact_id string, start_line int, end_line int, chunk_type string, path string, heading_path array<string>, text string, content_hash string"
    index = R.build_index(spark.createDataFrame(rows, fields))
    want = set()
    stem = lambda t: t[:-1] if len(t) > 3 and t.endswith("s") else t
    for i, text in enumerate(texts):
        if text is not None:
            words = [stem(t) for t in re.findall("[a-z0-9]+", text)]
            context = ["p", "md", "key", "b"]
            want |= {(f"c{i}", t, tuple(k for k, w in enumerate(words) if w == t), tuple(k for k, w in enumerate(context) if w == t)) for t in {*words, *context}}
    got = index.postings.join(index.documents.select("doc", "chunk_id"), "doc").collect()
    assert {(r.chunk_id, r.term, tuple(r.text_at), tuple(r.context_at)) for r in got} == want and len(got) == len(want)
    plan = index.documents.select("doc", "text_length", F.concat("text_tokens", "context_tokens").alias("tokens")).mapInArrow(R._term_places(5), R._PLACES)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_few_queries_do_not_shuffle_the_postings(spark, index):
    scores = R.term_scores(index, R.query_terms(queries(spark, "api key", "onke")))
    assert "SortMergeJoin" not in scores._jdf.queryExecution().optimizedPlan().toString()
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def stored_columns(df):
    import pyarrow.parquet as pq

    return {c.path_in_schema.split(".")[0]: c.compression for f in df.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in range(m.num_row_groups) for c in map(m.row_group(g).column, range(m.num_columns))}


def exchanged(df):
    """The lines of the plan that make what an exchange moves."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [next(x for x in lines[n + 1:] if "Exchange" not in x) for n, line in enumerate(lines) if "Exchange" in line]


def test_the_index_stores_nothing_that_follows_from_what_it_stores(index):
    documents, postings = stored_columns(index.documents), stored_columns(index.postings)
    assert {"text", "vector", "doc"} <= documents.keys() and not {"text_tokens", "context_tokens"} & documents.keys()
    assert {"term", "doc", "text_at", "context_at"} <= postings.keys() and not {"saturation", "block"} & postings.keys()
    assert {*documents.values(), *postings.values(), *stored_columns(index.blocks).values()} == {"ZSTD"}


def test_parts_of_blocks_add_up(index):
    want = {(r.term, r.block): (r.n, r.most) for r in index.postings.groupBy("term", "block").agg(F.count("*").alias("n"), F.max(F.col("saturation") + 0.35 * F.col("context_count")).alias("most")).collect()}
    got = {(r.term, r.block): (r.n, r.most) for r in index.blocks.groupBy("term", "block").agg(F.sum("postings").alias("n"), F.max("most").alias("most")).collect()}
    assert got == want and sum(r.document_frequency for r in index.terms.collect()) == index.postings.count()


def test_texts_postings_and_vectors_are_not_shuffled(spark, index, monkeypatch):
    lexical, hybrid = (f(index, queries(spark, "api key", "onke")) for f in (R.retrieve_lexical, R.retrieve_hybrid))
    assert not any("text#" in x or "text_at#" in x or "vector#" in x for x in exchanged(lexical) + exchanged(hybrid))
    want = [sorted(map(str, df.collect())) for df in (lexical, hybrid)]
    monkeypatch.setattr(R, "FEW_ROWS", 0)
    assert [sorted(map(str, f(index, queries(spark, "api key", "onke")).collect())) for f in (R.retrieve_lexical, R.retrieve_hybrid)] == want


def test_words_of_bytes_are_the_stemmed_tokens(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE_TOKENS", 2)
    texts = ["Keys_and-LADIES bus class", "", None, "é1ies漢bees", "--", "ab", "s ss ies ties \x00pies", "x" * 50 + " \n9s", "Kİs ÀS"]
    rows = [(f"c{i}", i, "a", 1, 1, "paragraph", p, h, t, "h") for i, (t, p, h) in enumerate(zip(texts, ["é.md", None, "a", "", "Bs", "b", "c", "d", "e"], [["Dogs"], [], None, ["", "x"], [], [], [], [], ["ß tags"]]))]
    fields = "chunk_id string, chunk_index int, artifact_id string, start_line int, end_line int, chunk_type string, path string, heading_path array<string>, text string, content_hash string"
    index = R.build_index(spark.createDataFrame(rows, fields).repartition(1))
    want = {(r.doc, t, tuple(k for k, w in enumerate(r.text_tokens) if w == t), tuple(k for k, w in enumerate(r.context_tokens) if w == t))
            for r in index.documents.where("text IS NOT NULL").collect() for t in {*r.text_tokens, *r.context_tokens}}
    assert {(r.doc, r.term, tuple(r.text_at), tuple(r.context_at)) for r in index.postings.collect()} == want
    assert index.average_length == index.documents.agg(F.avg("text_length")).first()[0]


def test_matrices_come_back_as_they_were():
    import numpy as np

    rng = np.random.default_rng(2)
    for m in (np.round(rng.normal(size=(7, 5)), 6), rng.normal(size=(7, 5)), np.array([[1e300, np.nan, np.inf]]), np.empty((0, 5)), np.empty((3, 0))):
        kind, data = R._packed(m)
        assert np.array_equal(R._unpacked(kind, data, *m.shape), m, equal_nan=True)
    assert R._packed(np.array([[0.123456]]))[0] == "<i4" and R._packed(np.array([[0.1234567]]))[0] == "<f8"


def test_embeddings_do_not_depend_on_how_many_tokens_are_remembered(spark, monkeypatch):
    texts = [f"alpha {k} beta {k % 3} " + "gamma " * k for k in range(40)] + ["", None]
    monkeypatch.setattr(V, "_KNOWN_TOKENS", 5)
    monkeypatch.setattr(V, "_TOKENS_AT_ONCE", 3)
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(V.hash_embedding(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [plain_embedding(t or "") for t in texts]
