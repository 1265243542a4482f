"""Registered queries: tokens, embeddings, lexical and hybrid retrieval."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docvet.functions import text as X
from docvet.functions import vectors as V
from docvet.operators import embeddings as E
from docvet.operators import quality as Q
from docvet.operators import retrieval as R
from docvet.operators.chunking import chunk_artifacts, chunk_metadata, with_metadata
from docvet.plans import inputs as I
from docvet.plans.parse_queries import CHUNKS_SQL, chunks
from docvet.plans.scan_queries import artifact_texts

QUERIES_TEXT = (
    ("q1", "api key network access"), ("q2", "reveal passwords"), ("q3", "token"), ("q4", "deep setup"), ("q5", "--"),
    ("q6", "ver"),
)


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES_TEXT, "query_id string, query string")


_INDEXES: dict[tuple, R.Index] = {}


def index(spark: SparkSession, d: str) -> R.Index:
    """The index over all chunks, written once per application and folder, like the stored table it stands for."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = R.build_index(chunk_artifacts(artifact_texts(spark, d)), E.EmbeddingProvider())
    return _INDEXES[key]


def term_query(spark, d):
    docs = I.table(spark, d, "documents")
    return docs.select(F.explode(X.stemmed_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def token_query(spark, d):
    tokens = X.plain_tokens(F.col("text"))
    return I.table(spark, d, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.sha2(F.array_join(tokens, " "), 256).alias("token_hash"))


def embedding_query(spark, d):
    docs = I.table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(V.hash_embedding(F.col("text"))).alias("dim", "value")).where("value <> 0")


def input_query(spark, d):
    return chunks(spark, d).select("artifact_id", "chunk_index", F.sha2(E.embedding_input(E.EmbeddingProvider()), 256).alias("input_hash"))


def metadata_query(spark, d):
    rows = chunk_metadata(chunks(spark, d))
    return rows.select("artifact_id", "chunk_index", "line_count", "heading_depth", "has_heading_context", "char_count", "word_count", "metadata_hash")


def cosine_query(spark, d):
    vectors = I.table(spark, d, "embeddings")
    other = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return vectors.join(other, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 5).alias("cosine"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _length_and_spaces(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [float(len(t)), float(t.count(" "))])


def provider_query(spark, d):
    """A user provider: an Arrow UDF with two dimensions."""
    provider = E.EmbeddingProvider("custom", "length-and-spaces", 2, False, embed=_length_and_spaces)
    docs = I.table(spark, d, "documents")
    vector = provider.vector(F.col("text"))
    rows = X.compute_once(docs.select("doc_id", "text"), v=vector)
    return rows.select("doc_id", F.get("v", F.lit(0)).alias("v0"), F.get("v", F.lit(1)).alias("v1"))


def record_query(spark, d):
    """Every record's vector as rows of its non-zero numbers, beside its configuration.

    A generator over the bare column would have Spark test its size below the Arrow function, which would then run twice.
    """
    rows = E.chunk_embeddings(with_metadata(chunks(spark, d)))
    return rows.select("chunk_id", "provider", "model_name", "dimensions", "normalize", "strategy_version", "embedding_hash", F.inline(V.non_zero("vector")))


def statistics_query(spark, d):
    return R.corpus_statistics(index(spark, d)).select("document_count", F.round("average_length", 6).alias("average_length"))


def frequency_query(spark, d):
    return R.document_frequency(index(spark, d), R.query_terms(queries(spark)))


def bm25_query(spark, d):
    rows = R.lexical_scores(index(spark, d), queries(spark))
    return rows.select("query_id", "chunk_id", F.round("score", 5).alias("score"), F.array_join("matched_terms", " ").alias("matched_terms"))


def lexical_query(spark, d):
    rows = R.retrieve_lexical(index(spark, d), queries(spark), snippet_chars=60)
    return rows.withColumn("matched_terms", F.array_join("matched_terms", " ")).withColumn("heading_path", F.array_join("heading_path", " > "))


def maximum_query(spark, d):
    rows = R.lexical_scores(index(spark, d), queries(spark), best=1)
    return rows.groupBy("query_id").agg(F.round(F.max("score"), 5).alias("max_score"))


def hybrid_query(spark, d):
    rows = R.retrieve_hybrid(index(spark, d), queries(spark), max_results=20, snippet_chars=60)
    public = Q.public_projection(rows)
    return public.withColumn("matched_terms", F.array_join("matched_terms", " ")).withColumn("heading_path", F.array_join("heading_path", " > "))


_TOK = "regexp_extract_all(replace(replace(lower({0}), '_', ' '), '-', ' '), '[a-z0-9]+')"
_STEM = "CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 3 AND t LIKE '%s' AND NOT regexp_matches(t, '(ss|us|is)$') THEN t[:-2] ELSE t END"
_STEMS = f"list_transform({_TOK}, lambda t: {_STEM})"
_Q = ", ".join(f"('{i}', '{q}')" for i, q in QUERIES_TEXT)
_BM25 = f"""{CHUNKS_SQL}, q AS (SELECT * FROM (VALUES {_Q}) AS v(query_id, query)),
qs AS (SELECT query_id, query, {_STEMS.format('query')} AS terms FROM q), qt AS (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM qs),
docs AS (SELECT c.*, a.path, {_STEMS.format('c.text')} AS st, {_STEMS.format("a.path || ' ' || heading_path")} AS sc FROM chunks c JOIN artifacts a USING (artifact_id)),
tc AS (SELECT chunk_id, term, sum(i) AS tf, sum(1 - i) AS cf FROM (SELECT chunk_id, unnest(st) AS term, 1 AS i FROM docs UNION ALL SELECT chunk_id, unnest(sc), 0 FROM docs) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS document_frequency FROM tc GROUP BY 1), st AS (SELECT count(*) AS n, greatest(avg(len(st)), 1) AS avg_len FROM docs),
tp AS (SELECT query_id, chunk_id, pos, qt.term, ln(1 + (n - document_frequency + 0.5) / (document_frequency + 0.5)) * (CASE WHEN tf > 0 THEN tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(len(docs.st), 1) / avg_len)) ELSE 0 END + cf * 0.35) AS pts
 FROM tc JOIN qt USING (term) JOIN dfs USING (term) JOIN docs USING (chunk_id), st),
ph AS (SELECT query_id, chunk_id, CASE WHEN contains(array_to_string(st, ' '), array_to_string(terms, ' ')) THEN 1.0 ELSE 0 END + CASE WHEN contains(array_to_string(sc, ' '), array_to_string(terms, ' ')) THEN 0.4 ELSE 0 END AS pts
 FROM docs, qs WHERE len(terms) > 0),
scores AS (SELECT query_id, chunk_id, sum(pts) AS score, coalesce(string_agg(term, ' ' ORDER BY pos) FILTER (term IS NOT NULL), '') AS matched_terms
 FROM (SELECT query_id, chunk_id, pos, term, pts FROM tp UNION ALL SELECT query_id, chunk_id, NULL, NULL, pts FROM ph WHERE pts > 0) GROUP BY ALL HAVING sum(pts) > 0)"""
_EMB = """{0} AS (SELECT {1}, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY {1})), 6) AS v FROM (SELECT {1}, ('0x' || substr(h, 1, 8))::UBIGINT % 64 AS bucket,
 sum(CASE WHEN ('0x' || substr(h, 10, 1))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END * (1 + ('0x' || substr(h, 11, 2))::UBIGINT / 255.0)) AS v
 FROM (SELECT {1}, sha256('local-hash-embedding-v1:' || t) AS h FROM (SELECT {1}, unnest(CASE WHEN len({2}) = 0 THEN ['empty'] ELSE {2} END) AS t FROM {3})) GROUP BY ALL))"""
_HYBRID = f"""{_BM25}, ein AS (SELECT chunk_id, path || chr(10) || CASE WHEN heading_path = '' THEN '' ELSE heading_path || chr(10) END || text AS t0 FROM docs),
{_EMB.format('ce', 'chunk_id', _TOK.format('t0'), 'ein')}, {_EMB.format('qe', 'query_id', _TOK.format('query'), '(SELECT * FROM qs WHERE len(terms) > 0)')},
cn AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM ce GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qe GROUP BY 1),
cosv AS (SELECT query_id, chunk_id, greatest(0, sum(ce.v * qe.v) / (any_value(cn.n) * any_value(qn.n))) AS emb FROM ce JOIN qe USING (bucket) JOIN cn USING (chunk_id) JOIN qn USING (query_id) GROUP BY ALL),
lx AS (SELECT query_id, chunk_id, round(score, 6) AS lex, max(round(score, 6)) OVER (PARTITION BY query_id) AS mx FROM scores),
hy AS (SELECT query_id, chunk_id, coalesce(lex / mx, 0) AS nl, coalesce(emb, 0) AS emb FROM lx FULL JOIN cosv USING (query_id, chunk_id)),
rk AS (SELECT query_id, hy.chunk_id, round(0.6 * nl + 0.4 * emb, 6) AS hybrid, round(nl, 6) AS nl, round(emb, 6) AS emb, chunk_index FROM hy JOIN docs USING (chunk_id) WHERE 0.6 * nl + 0.4 * emb > 0)"""
_PATH_JSON = "to_json(CASE WHEN heading_path = '' THEN []::VARCHAR[] ELSE string_split(heading_path, ' > ') END)"
_WORDS = r"len(regexp_extract_all(text, '[\pL\pN\pM_]+(?:[-''][\pL\pN\pM_]+)*'))"
# The JSON that the hashes are taken of, with sorted keys.
_META = f"""meta AS (SELECT chunk_id, sha256('{{"artifact_id":"' || artifact_id || '","char_count":' || length(text) || ',"chunk_id":"' || chunk_id || '","chunk_index":' || chunk_index || ',"chunk_type":"' || chunk_type
 || '","content_hash":"' || content_hash || '","end_line":' || end_line || ',"has_heading_context":' || (heading_path <> '') || ',"heading_depth":' || CASE WHEN heading_path = '' THEN 0 ELSE len(string_split(heading_path, ' > ')) END
 || ',"heading_path":' || {_PATH_JSON} || ',"line_count":' || (end_line - start_line + 1) || ',"path":"' || path || '","start_line":' || start_line || ',"word_count":' || {_WORDS} || '}}') AS metadata_hash FROM docs)"""
# Numbers as JSON of the JVM: below a thousandth with an exponent.
_NUMBER = """CASE WHEN v = 0 OR abs(v) >= 0.001 THEN v::VARCHAR WHEN abs(v) >= 0.0001 THEN (round(v * 1e6) / 100)::VARCHAR || 'E-4'
 WHEN abs(v) >= 0.00001 THEN (round(v * 1e6) / 10)::VARCHAR || 'E-5' ELSE round(v * 1e6)::VARCHAR || 'E-6' END"""
_RECORD = f"""full_v AS (SELECT chunk_id, b.bucket, coalesce(ce.v, 0)::DOUBLE AS v FROM docs CROSS JOIN (SELECT unnest(range(64)) AS bucket) b LEFT JOIN ce USING (chunk_id, bucket)),
record AS (SELECT chunk_id, sha256('{{"artifact_id":"' || artifact_id || '","chunk_id":"' || chunk_id || '","chunk_index":' || chunk_index || ',"content_hash":"' || content_hash || '","dimensions":64,"end_line":' || end_line
 || ',"heading_path":' || {_PATH_JSON} || ',"metadata_hash":"' || metadata_hash || '","model_name":"local-hash-embedding-v1","normalize":true,"path":"' || path || '","provider":"deterministic_hash","start_line":' || start_line
 || ',"strategy_version":"chunk-embedding-strategy/v0.1","vector":[' || vs || ']}}') AS embedding_hash FROM docs JOIN meta USING (chunk_id) JOIN (SELECT chunk_id, string_agg({_NUMBER}, ',' ORDER BY bucket) AS vs FROM full_v GROUP BY 1) USING (chunk_id))"""
_KEYS = "query_id, rank, chunk_id, artifact_id, path, chunk_index, start_line, end_line, heading_path"
_CUT = """a AS (SELECT *, coalesce(list_min(list_filter(list_transform(string_split(matched_terms, ' '), lambda t: CASE WHEN t = '' THEN -1 ELSE instr(lower(f), t) - 1 END), lambda p: p >= 0)), 0) AS anchor FROM f),
b AS (SELECT *, least(greatest(anchor - 20, 0) + 60, length(f)) AS e FROM a), c AS (SELECT *, greatest(e - 60, 0) AS s FROM b),
cut AS (SELECT *, CASE WHEN length(f) <= 60 THEN f ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || trim(substr(f, s + 1, e - s)) || CASE WHEN e < length(f) THEN '...' ELSE '' END END AS cut FROM c)"""
_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"

QUERIES = {
    "b23_chunk_metadata": (metadata_query, f"""{CHUNKS_SQL}, docs AS (SELECT c.*, a.path FROM chunks c JOIN artifacts a USING (artifact_id)), {_META} SELECT artifact_id, chunk_index, end_line - start_line + 1 AS line_count,
 CASE WHEN heading_path = '' THEN 0 ELSE len(string_split(heading_path, ' > ')) END AS heading_depth, heading_path <> '' AS has_heading_context, length(text) AS char_count, {_WORDS} AS word_count, metadata_hash FROM docs JOIN meta USING (chunk_id)"""),
    "b24_stemmed_terms": (term_query, f"SELECT t AS term, count(*) AS n FROM (SELECT unnest({_STEMS.format('text')}) AS t FROM documents) GROUP BY 1"),
    "b25_plain_tokens": (token_query, f"SELECT doc_id, len({_TOK.format('text')}) AS n_tokens, sha256(array_to_string({_TOK.format('text')}, ' ')) AS token_hash FROM documents"),
    "b27_hash_embeddings": (embedding_query, f"WITH {_EMB.format('e', 'doc_id', _TOK.format('text'), 'documents')} SELECT doc_id, bucket AS dim, v AS value FROM e WHERE v <> 0"),
    "b28_embedding_input": (input_query, f"""{CHUNKS_SQL} SELECT artifact_id, chunk_index, sha256(path || chr(10) || CASE WHEN heading_path = '' THEN '' ELSE heading_path || chr(10) END || text) AS input_hash
FROM chunks JOIN artifacts USING (artifact_id)"""),
    "b29_cosine_similarity": (cosine_query, "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"),
    "j1_custom_provider": (provider_query, "SELECT doc_id, length(text)::DOUBLE AS v0, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS v1 FROM documents"),
    "j4_embedding_records": (record_query, f"""{CHUNKS_SQL}, docs AS (SELECT c.*, a.path FROM chunks c JOIN artifacts a USING (artifact_id)), ein AS (SELECT chunk_id, path || chr(10) || CASE WHEN heading_path = '' THEN '' ELSE heading_path || chr(10) END || text AS t0 FROM docs),
{_EMB.format('ce', 'chunk_id', _TOK.format('t0'), 'ein')}, {_META}, {_RECORD} SELECT chunk_id, 'deterministic_hash' AS provider, 'local-hash-embedding-v1' AS model_name, 64 AS dimensions, true AS normalize, 'chunk-embedding-strategy/v0.1' AS strategy_version, embedding_hash,
 bucket AS dim, v AS value FROM ce JOIN record USING (chunk_id) WHERE v <> 0"""),
    "d8_corpus_statistics": (statistics_query, f"{_BM25} SELECT n AS document_count, round(avg_len, 6) AS average_length FROM st"),
    "d8_document_frequency": (frequency_query, f"{_BM25} SELECT term, document_frequency FROM dfs"),
    "d9_bm25_scores": (bm25_query, f"{_BM25} SELECT query_id, chunk_id, round(score, 5) AS score, matched_terms FROM scores"),
    "d10_maximum_scores": (maximum_query, f"{_BM25} SELECT query_id, round(max(score), 5) AS max_score FROM scores GROUP BY 1"),
    "f2_lexical_topk": (lexical_query, f"""{_BM25}, {_META}, r AS (SELECT query_id, s.chunk_id, score, matched_terms, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, s.chunk_id)::INT AS rank
 FROM (SELECT query_id, chunk_id, round(score, 9) AS score, matched_terms FROM scores) s JOIN docs USING (chunk_id) QUALIFY rank <= 5),
f AS (SELECT r.*, d.* EXCLUDE (chunk_id), {_FLAT} AS f FROM r JOIN docs d USING (chunk_id)), {_CUT}
SELECT {_KEYS}, round(score, 6) AS score, matched_terms, cut AS snippet, content_hash, metadata_hash FROM cut JOIN meta USING (chunk_id)"""),
    "f3_hybrid_topk": (hybrid_query, f"""{_HYBRID}, {_META}, {_RECORD}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, nl DESC, emb DESC, chunk_index, chunk_id)::INT AS rank FROM rk QUALIFY rank <= 20),
f AS (SELECT r.* EXCLUDE (chunk_index), d.* EXCLUDE (chunk_id), coalesce(lex, 0) AS lexical_score, coalesce(s.matched_terms, '') AS matched_terms, {_FLAT} AS f
 FROM r JOIN docs d USING (chunk_id) LEFT JOIN lx USING (query_id, chunk_id) LEFT JOIN scores s USING (query_id, chunk_id)), {_CUT}
SELECT {_KEYS}, hybrid AS hybrid_score, lexical_score, nl AS normalized_lexical_score, emb AS embedding_score, matched_terms,
 CASE WHEN lexical_score > 0 OR length(f) <= 60 THEN cut ELSE trim(substr(f, 1, 60)) || '...' END AS snippet, content_hash, metadata_hash, embedding_hash
FROM cut JOIN meta USING (chunk_id) JOIN record USING (chunk_id)"""),
}
