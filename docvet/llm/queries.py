"""The registered queries opN_<name>: each applies one operator, with its production parameters, to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from docvet.llm import (
    chunk_prints, contamination, divergence, importance, license_scan, line_windows, negatives, packing, pieces, sharding, simhash, toxicity, url_filter,
)
from docvet.llm.common import documents

URL_RULES = (
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
)
#: Pages whose host says so make up the list that op1 looks URLs up in.
LISTED_HOSTS = r"(^|[.-])(adult|spam|casino|malware|phish)"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    return url_filter.judge_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


_OP1_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[\s\S]*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS kept
  FROM pages
), named AS (
  SELECT *, CASE WHEN regexp_replace(host, ':(80|443)?$', '') <> '' THEN regexp_replace(host, ':(80|443)?$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS name
  FROM parts
), list AS (SELECT DISTINCT name FROM named WHERE regexp_matches(host, '(^|[.-])(adult|spam|casino|malware|phish)')),
ruled AS (
  SELECT named.*, list.name IS NOT NULL AS listed, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM named LEFT JOIN list ON named.name = list.name
)
SELECT page_id, host, path, rule, CASE rule WHEN 'www.example.com/en/' THEN 'allow' WHEN 'com/' THEN 'allow' WHEN 'example.com/en/' THEN 'block'
  WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block' ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict, listed
FROM ruled
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    crf = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    return toxicity.score(docs, crf).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = contamination.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.select("doc_id", "item_id", "score", "start", "end")


def packed(docs: DataFrame) -> DataFrame:
    """The pieces with a digest of their ids; the vocabulary is that of byte_bpe_50k.json, whose ids a test compares."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _, _ = importance.sample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores.select("doc_id", "log_weight", "key", "selected")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return license_scan.scan(docs, license_scan.fit(docs))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_documents(documents(spark, sf_dir), shards=8)
    crc = F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    return dealt.select("doc_id", "size", crc, F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.remove_repeats(documents(spark, sf_dir)).select("doc_id", "lines", "removed", "text")


#: Sentence ends get a mark, as this dialect has no look-behind; the documents hold no such mark.
_OP9_SQL = r"""
WITH pieces AS (
  SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '(\n|[.!?] )', '\1' || chr(30), 'g'), chr(30)), lambda x: x <> '') AS parts FROM documents
), line AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS place FROM pieces
), real AS (
  SELECT doc_id, place, lower(trim(part, chr(32) || chr(9) || chr(10) || chr(13))) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS rn
  FROM line WHERE trim(part, chr(32) || chr(9) || chr(10) || chr(13)) <> ''
), three AS (
  SELECT doc_id, rn, l || chr(10) || lead(l, 1) OVER w || chr(10) || lead(l, 2) OVER w AS win FROM real WINDOW w AS (PARTITION BY doc_id ORDER BY rn)
), ranked AS (
  SELECT doc_id, rn, row_number() OVER (PARTITION BY win ORDER BY doc_id, rn) AS k FROM three WHERE win IS NOT NULL
), later AS (
  SELECT doc_id, rn, CASE WHEN rn - lag(rn) OVER (PARTITION BY doc_id ORDER BY rn) < 3 THEN 0 ELSE 1 END AS begins FROM ranked WHERE k > 1
), run AS (
  SELECT doc_id, min(rn) AS first, max(rn) + 2 AS last FROM (SELECT doc_id, rn, sum(begins) OVER (PARTITION BY doc_id ORDER BY rn) AS g FROM later) GROUP BY doc_id, g
), gone AS (
  SELECT doc_id, unnest(places) AS place FROM (
    SELECT r.doc_id, list(x.place) AS places FROM run r JOIN real x ON x.doc_id = r.doc_id AND x.rn BETWEEN r.first AND r.last GROUP BY r.doc_id, r.first
    HAVING sum(greatest(length(x.l) - length(replace(x.l, ' ', '')) + 1, len(regexp_extract_all(x.l, '[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]')) // 2)) >= 8)
), texts AS (
  SELECT l.doc_id, count(*) AS lines, coalesce(list(l.place ORDER BY l.place) FILTER (g.place IS NOT NULL), []) AS removed,
    coalesce(string_agg(l.part, '' ORDER BY l.place) FILTER (g.place IS NULL), '') AS text
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(t.lines, 0)::INT AS lines, coalesce(t.removed, [])::INT[] AS removed, coalesce(t.text, d.text) AS text
FROM documents d LEFT JOIN texts t USING (doc_id)
"""


def op10_chunk_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_prints.edit_study(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(rows, F.col("vec_id") % 50 == 0, label_col=label)


_OP11_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.rn, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e a JOIN e b ON a.rn <> b.rn WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT rn, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rn ORDER BY score DESC, other_id) AS p FROM scored WHERE same QUALIFY p <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.rn, p.p ORDER BY n.score DESC, n.other_id) AS rank, n.other_id AS negative_id,
    p.positive_score, n.score AS negative_score
  FROM positive p JOIN scored n ON p.rn = n.rn AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""


def op12_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_texts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x, name: F.sha2(x.cast("binary"), 256).alias(name)
    decimal_ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), sha(decimal_ids, "ids_sha256"), sha(F.col("decoded"), "decoded_sha256"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


_OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
word AS (
  SELECT rn, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), cell AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rn) AS docs FROM word GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM cell GROUP BY ALL HAVING sum(docs) >= 3),
of_lang AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY ALL),
grp AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT cell.* FROM cell JOIN kept USING (lang, term)) c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v) AS q
  FROM grp g JOIN of_lang l ON g.lang = l.lang JOIN kept k ON g.lang = k.lang LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM part QUALIFY part = 'pair' OR rank <= 200
"""


#: name: (query, SQL or None)
QUERIES = {
    "op1_url_filter": (op1_url_filter, _OP1_SQL),
    "op2_simhash": (op2_simhash, None),
    "op3_toxicity": (op3_toxicity, None),
    "op4_contamination": (op4_contamination, None),
    "op5_packing": (op5_packing, None),
    "op6_importance": (op6_importance, None),
    "op7_license_scan": (op7_license_scan, None),
    "op8_sharding": (op8_sharding, None),
    "op9_line_windows": (op9_line_windows, _OP9_SQL),
    "op10_chunk_prints": (op10_chunk_prints, None),
    "op11_hard_negatives": (op11_hard_negatives, _OP11_SQL),
    "op12_piece_ids": (op12_piece_ids, None),
    "op13_source_audit": (op13_source_audit, _OP13_SQL),
}
