"""Registered queries: markdown elements, tool schemas, chunks, repository crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.operators import chunking as C
from docvet.operators import crawl as K
from docvet.operators import markdown as M
from docvet.operators import report as P
from docvet.operators import schemas as H
from docvet.plans import inputs as I
from docvet.plans.oracle import ART, CHECKED, FINDINGS, LINES, RISK
from docvet.plans.scan_queries import admitted, artifacts, assessment, checked
from docvet.session import shared_folder, shared_table
from docvet.sources import files as S
from docvet.sources import stores as ST
from docvet.sources.files import suffix


def classed(spark: SparkSession, d: str) -> DataFrame:
    return M.with_line_classes(artifacts(spark, d).select("artifact_id", "raw_text"))


def schemas(spark: SparkSession, d: str) -> DataFrame:
    return H.parse_schema_texts(I.derived(spark, d, I.SCHEMAS), "doc_id")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return H.tool_candidates(schemas(spark, d), "doc_id")


def parsed_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Type, item count and parse error of every admitted artifact, counted inside its own row."""
    rows = admitted(spark, d).select("artifact_id", "run_id", "path", "raw_text").withColumn(
        "artifact_type", H.artifact_type(suffix(F.col("path")))
    )
    keys = ("artifact_id", "run_id", "path", "artifact_type")
    markdown = M.element_counts(M.with_line_classes(rows.where("artifact_type = 'markdown'")), *keys)
    total = sum((F.col(c) for c in ("heading_count", "paragraph_count", "code_block_count", "link_count")), F.col("env_var_count"))
    markdown = markdown.select(*keys, total.alias("parsed_item_count"), F.lit(None).cast("string").alias("parse_error"))
    documents = rows.where(F.col("artifact_type").isin("json", "yaml")).select(
        *keys, F.col("artifact_type").alias("schema_format"), F.col("raw_text").alias("schema_text")
    )
    parsed = H.parse_schema_texts(documents, *keys)
    tool_counts = H.tool_candidates(parsed, "artifact_id").groupBy("artifact_id").agg(F.count("*").alias("tools"))
    documents = parsed.join(tool_counts, "artifact_id", "left").select(
        *keys, (F.coalesce("tools", F.lit(0)) + F.size("urls")).alias("parsed_item_count"), "parse_error"
    )
    others = rows.where(~F.col("artifact_type").isin("markdown", "json", "yaml")).select(
        *keys, F.lit(0).alias("parsed_item_count"), F.lit(None).cast("string").alias("parse_error")
    )
    return markdown.unionByName(documents).unionByName(others)


def scan_summary_query(spark, d):
    skipped = checked(spark, d).where(F.col("skip_reason").isNotNull())
    return P.scan_summary(admitted(spark, d), skipped, parsed_artifacts(spark, d), assessment(spark, d))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_artifacts(artifacts(spark, d))


def tree(spark: SparkSession, d: str) -> DataFrame:
    return I.derived(spark, d, I.TREE)


def tree_file_query(spark, d):
    """The listing written as JSON lines, with items that are no part of a tree, and read by the tree reader."""
    rows = tree(spark, d).select("repo", "path", F.when(F.col("doc_id") % 97 == 0, "commit").otherwise(F.col("type")).alias("type"), F.when(F.col("doc_id") % 89 == 0, -1).otherwise(F.col("size")).alias("size"))
    folder = f"{shared_folder(spark)}/tree"
    ST.write_jsonl(rows, folder)
    return S.read_tree(spark, folder)


def manifest_file_query(spark, d):
    """Crawl manifests written and read back: all files of all crawls, and no text."""
    selected, fetched, skipped = crawl_tables(spark, d)
    folder = shared_folder(spark)
    ST.write_crawl_manifests(K.crawl_summary(selected, fetched, skipped), {"selected": selected, "fetched": fetched, "skipped": skipped}, folder)
    parts = [spark.read.schema("repo string, path string").json(f"{folder}/{part}").select(F.lit(part).alias("part"), "repo", "path") for part in ST.MANIFEST_PARTS]
    return parts[0].union(parts[1]).union(parts[2])


def selection(spark: SparkSession, d: str, max_selected_files: int = 100) -> DataFrame:
    return K.select_relevant_files(tree(spark, d), max_file_size_bytes=1_000_000, max_selected_files=max_selected_files)


def responses(spark: SparkSession, d: str) -> DataFrame:
    pages = I.table(spark, d, "pages")
    p = F.col("page_id")
    body = F.encode("html", "UTF-8")
    content = (
        F.when(p % 13 == 3, F.concat(body, F.lit(b"\xff\xfe"))).when(p % 13 == 4, F.concat(body, F.lit(b"a\x00b")))
        .when(p % 13 == 5, F.concat(F.lit(b"\xef\xbb\xbf"), body)).otherwise(body)
    )
    length = F.when(p % 11 == 0, "many").when(p % 11 == 1, "2000000").when(p % 11 == 2, F.octet_length(body).cast("string"))
    kind = F.when(p % 7 == 0, "image/png").when(p % 7 == 1, " Application/JSON ; charset=utf-8").when(p % 7 == 2, "text/html")
    entries = F.filter(
        F.array(F.struct(F.lit("content-length").alias("k"), length.alias("v")), F.struct(F.lit("content-type").alias("k"), kind.alias("v"))),
        lambda e: e["v"].isNotNull(),
    )
    return pages.select(
        "page_id", "url", F.when(p % 17 == 0, 404).when(p % 17 == 1, 503).otherwise(200).alias("status"),
        F.map_from_entries(entries).alias("headers"), content.alias("content"),
    )


def responses_query(spark, d):
    rows = K.admit_responses(responses(spark, d), max_file_size_bytes=1_000_000)
    return rows.select("page_id", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"), "size_bytes",
                       F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("text_hash"))


def crawl_tables(spark, d):
    """Selected, fetched and skipped rows with seeded faults. The selection is used many times."""
    chosen = shared_table(selection(spark, d))
    selected = chosen.where("skip_reason IS NULL").select("repo", "doc_id", "path", "artifact_type", "priority", "size_bytes")
    dup = F.when(F.col("doc_id") % 50 == 1, 2).otherwise(1)
    urls = K.raw_file_urls(selected.select(
        "repo", "doc_id", "path", "artifact_type", "size_bytes", F.lit("acme").alias("owner"), F.col("repo").alias("repo_name"), F.lit("main").alias("ref")
    ))
    fetched = urls.where("doc_id % 4 <> 0").select(
        "repo", F.explode(F.sequence(F.lit(1), dup)).alias("copy"),
        F.when(F.col("doc_id") % 40 == 2, F.concat("path", F.lit(".bak"))).otherwise(F.col("path")).alias("path"),
        F.when(F.col("doc_id") % 30 == 7, F.lit("https://example.com/x")).otherwise(F.col("raw_url")).alias("raw_url"),
        "artifact_type", F.coalesce("size_bytes", F.lit(10)).alias("size_bytes"),
        F.when(F.col("doc_id") % 20 == 5, F.lit("ABC")).otherwise(F.sha2("path", 256)).alias("content_hash"),
    ).drop("copy")
    failed = urls.where("doc_id % 4 = 0").select("repo", "path", F.lit("fetch failed").alias("reason"))
    skipped = K.tag_skips(chosen.where("skip_reason IS NOT NULL").select("repo", "path", F.col("skip_reason").alias("reason")), failed)
    return selected.drop("doc_id"), fetched, skipped


def manifests(selected, fetched, skipped):
    """Recorded manifests; repositories with short names carry a wrong byte total."""
    off = (F.length("repo") == 5).cast("bigint")
    return shared_table(
        K.recorded_manifests(selected, fetched, skipped).withColumn("total_fetched_bytes", F.col("total_fetched_bytes") + off)
        .withColumn("owner", F.lit("acme")).withColumn("repo_name", F.col("repo")).withColumn("ref", F.lit("main"))
    )


def quality_query(spark, d):
    tables = crawl_tables(spark, d)
    issues = K.crawl_quality_issues(manifests(*tables), *tables, max_fetch_skip_ratio=0.3)
    return issues.select("repo", "code", "severity", "message", F.coalesce("path", F.lit("")).alias("path"))


def quality_report_query(spark, d):
    tables = crawl_tables(spark, d)
    recorded = manifests(*tables)
    return K.crawl_quality_reports(recorded, K.crawl_quality_issues(recorded, *tables, max_fetch_skip_ratio=0.3))


def summary_query(spark, d):
    return K.crawl_summary(*crawl_tables(spark, d))


def manifest_query(spark, d):
    return K.manifest_hashes(*crawl_tables(spark, d))


def classify_query(spark, d):
    rows = K.classify_tree(tree(spark, d))
    return rows.select("repo", "doc_id", "path", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"),
                       F.coalesce("artifact_type", F.lit("")).alias("artifact_type"), F.coalesce("priority", F.lit(-1)).alias("priority"))


def selection_query(spark, d):
    """The few best files of a repository: the limit is what is asked for."""
    rows = selection(spark, d, max_selected_files=7)
    return rows.select("repo", "doc_id", "path", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"), F.coalesce("artifact_type", F.lit("")).alias("artifact_type"))


def repo_url_query(spark, d):
    rows = K.canonicalize_repo_urls(I.derived(spark, d, I.REPO_URLS))
    return rows.select("page_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("error", "canonical_url", "owner", "repo_name")])


def raw_url_query(spark, d):
    files = tree(spark, d).select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a b/ü*"), "path")).otherwise(F.col("path")).alias("path"),
        F.lit("acme").alias("owner"), F.col("repo").alias("repo_name"), F.when(F.col("doc_id") % 10 == 0, "bad ref").otherwise("v1.0").alias("ref"),
    )
    return K.raw_file_urls(files).select("doc_id", F.coalesce("url_error", F.lit("")).alias("url_error"), F.coalesce("raw_url", F.lit("")).alias("raw_url"))


def skips_query(spark, d):
    return crawl_tables(spark, d)[2].select("repo", "path", "stage", "reason")


def chunk_query(spark, d):
    rows = chunks(spark, d)
    return rows.select("artifact_id", "chunk_index", "start_line", "end_line", "chunk_type", F.array_join("heading_path", " > ").alias("heading_path"), "content_hash", "chunk_id")


def section_query(spark, d):
    rows = C.sections(artifacts(spark, d).select("artifact_id", "raw_text"))
    return rows.select("artifact_id", F.inline("sections")).select(
        "artifact_id", F.col("start").alias("start_line"), F.col("end").alias("end_line"), "chunk_type",
        F.array_join("heading_path", " > ").alias("heading_path"),
    )


def tools_query(spark, d):
    rows = H.tools(candidates(spark, d), "doc_id")
    return rows.select("doc_id", "tool_pos", "name", F.coalesce("description", F.lit("")).alias("description"),
                       F.array_join("required_fields", ",").alias("required_fields"), F.array_join("examples", "|").alias("examples"), F.array_join("urls", " ").alias("urls"))


def parameters_query(spark, d):
    rows = H.tool_parameters(candidates(spark, d), "doc_id")
    return rows.select("doc_id", "tool_pos", "name", F.coalesce("description", F.lit("")).alias("description"), "required", "raw_schema")


def schema_url_query(spark, d):
    rows = schemas(spark, d)
    return rows.select("doc_id", F.array_join("urls", " ").alias("urls"), F.coalesce("parse_error", F.lit("")).alias("parse_error"))


_L = f"WITH {ART}, {CHECKED}, {LINES}"
_HEAD = r"'^(#{1,6})\s+(.+?)\s*$'"
_FENCE = r"'^(```|~~~)\s*([A-Za-z0-9_+.-]*)\s*$'"
# Fence state per line: each seeded text opens at most one block of a kind, so a block runs from its
# fence to the next line of the same marker, or to the end.
_MARKED = f"""{_L}, f AS (SELECT *, regexp_extract(line, {_FENCE}, 1) AS fence FROM lines),
opens AS (SELECT artifact_id, min(line_no) AS open_line, arg_min(fence, line_no) AS marker, arg_min(regexp_extract(line, {_FENCE}, 2), line_no) AS language FROM f WHERE fence <> '' GROUP BY 1),
ends AS (SELECT artifact_id, max(line_no) AS last_line FROM lines GROUP BY 1),
blocks AS (SELECT o.artifact_id, open_line, language, coalesce(min(f.line_no), max(last_line)) AS close_line, min(f.line_no) IS NOT NULL AS closed
 FROM opens o JOIN ends USING (artifact_id) LEFT JOIN f ON f.artifact_id = o.artifact_id AND f.fence = marker AND f.line_no > open_line GROUP BY ALL),
m AS (SELECT f.*, coalesce(f.line_no BETWEEN open_line AND close_line, false) AS in_code FROM f LEFT JOIN blocks b USING (artifact_id)),
typed AS (SELECT *, NOT in_code AND regexp_matches(line, {_HEAD}) AS is_head, NOT in_code AND trim(line) <> '' AND NOT regexp_matches(line, {_HEAD}) AS is_text FROM m)"""
_PARAGRAPHS = """p AS (SELECT *, line_no - row_number() OVER (PARTITION BY artifact_id ORDER BY line_no) AS island FROM typed WHERE is_text),
paragraphs AS (SELECT artifact_id, min(line_no) AS start_line, max(line_no) AS end_line, string_agg(trim(line), ' ' ORDER BY line_no) AS text FROM p GROUP BY artifact_id, island)"""
_LINK = r"'\[([^\]\n]+)\]\(([^)\s]+)\)'"
_ENV = r"'\b([A-Z][A-Z0-9_]{2,})\b'"
_LINKS = f"links AS (SELECT artifact_id, line_no, unnest(regexp_extract_all(line, {_LINK}, 1)) AS label, unnest(regexp_extract_all(line, {_LINK}, 2)) AS url FROM typed)"
_ENVS = rf"envs AS (SELECT DISTINCT artifact_id, line_no, name FROM (SELECT artifact_id, line_no, unnest(regexp_extract_all(line, {_ENV}, 1)) AS name FROM typed) WHERE name LIKE '%\_%' ESCAPE '\' OR regexp_matches(name, '(KEY|TOKEN|SECRET|PASSWORD|URL|HOST)$'))"

_JSON = f"""s AS ({I.SCHEMAS}), js AS (SELECT doc_id, TRY_CAST(schema_text AS JSON) AS j FROM s),
ident AS (SELECT doc_id, j, json_type(j) AS jt, (json_exists(j, '$.name') OR json_exists(j, '$.tool_name')) AND json_exists(j, '$.description') AS self_ok,
 coalesce(json_type(j, '$.function') = 'OBJECT' AND (json_exists(j, '$.function.name') OR json_exists(j, '$.function.tool_name')) AND json_exists(j, '$.function.description'), false) AS fn_ok FROM js),
cand AS (SELECT doc_id, 0 AS grp, unnest(json_extract(j, '$[*]')) AS t FROM ident WHERE jt = 'ARRAY'
 UNION ALL SELECT doc_id, 0, json_extract(j, '$.function') FROM ident WHERE fn_ok
 UNION ALL SELECT doc_id, 1, unnest(json_extract(j, '$.tools[*]')) FROM ident WHERE jt = 'OBJECT' AND NOT fn_ok
 UNION ALL SELECT doc_id, 2, unnest(json_extract(j, '$.functions[*]')) FROM ident WHERE jt = 'OBJECT' AND NOT fn_ok
 UNION ALL SELECT doc_id, 3, json_extract(j, '$.tool') FROM ident WHERE jt = 'OBJECT' AND NOT fn_ok AND json_type(j, '$.tool') = 'OBJECT'
 UNION ALL SELECT doc_id, 4, j FROM ident WHERE jt = 'OBJECT' AND NOT fn_ok AND self_ok),
tools AS (SELECT doc_id, t, coalesce(nullif(t ->> '$.name', ''), nullif(t ->> '$.tool_name', ''), 'unknown_tool') AS name,
 coalesce(t -> '$.parameters', t -> '$.input_schema', t -> '$.inputSchema', t -> '$.schema') AS ps,
 row_number() OVER (PARTITION BY doc_id ORDER BY grp, CASE WHEN json_exists(t, '$.homepage') THEN 0 ELSE 1 END) - 1 AS tool_pos FROM cand WHERE json_type(t) = 'OBJECT')"""
_URLS = r"""list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(CAST({0} AS VARCHAR), '"[^"]*"\s*:', '', 'g'), 'https?://[^\s"''<>),\]]+'), lambda u: rtrim(u, '.,;:'))))"""

_PARSED = f"""{_MARKED}, {_PARAGRAPHS}, {_LINKS}, {_ENVS}, u AS (SELECT artifact_id FROM typed WHERE is_head UNION ALL SELECT artifact_id FROM paragraphs UNION ALL SELECT artifact_id FROM blocks
 UNION ALL SELECT artifact_id FROM links UNION ALL SELECT artifact_id FROM envs), mc AS (SELECT artifact_id, count(*) AS n FROM u GROUP BY 1),
{_JSON}, tc AS (SELECT doc_id, count(*) AS n FROM tools GROUP BY 1), uc AS (SELECT doc_id, j IS NULL AS bad, CASE WHEN j IS NULL THEN 0 ELSE len({_URLS.format('j')}) END AS n FROM js),
parsed AS (SELECT c.artifact_id, c.run_id, CASE WHEN extension IN ('.md', '.markdown') THEN 'markdown' ELSE substr(extension, 2) END AS artifact_type,
 CASE WHEN extension IN ('.md', '.markdown') THEN coalesce(mc.n, 0) WHEN extension = '.json' THEN coalesce(tc.n, 0) + uc.n ELSE 0 END AS parsed_item_count,
 CASE WHEN extension = '.json' AND bad THEN 'Invalid JSON schema' ELSE '' END AS parse_error
FROM checked c LEFT JOIN mc USING (artifact_id) LEFT JOIN tc ON tc.doc_id = -1 - c.doc_id LEFT JOIN uc ON uc.doc_id = -1 - c.doc_id WHERE skip_reason IS NULL)"""

# Chunk oracle: sections by windows, split points by a recursive walk over the lines of a section.
_SECTIONS = f"""{_L}, h AS (SELECT artifact_id, line_no, line, regexp_matches(line, {_HEAD}) AS is_head, length(regexp_extract(line, {_HEAD}, 1)) AS level,
 trim(regexp_extract(line, {_HEAD}, 2)) AS head_text FROM lines),
g AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY artifact_id ORDER BY line_no) AS sec, bool_or(is_head) OVER (PARTITION BY artifact_id) AS has_head,
 line_no - sum((trim(line) <> '')::INT) OVER (PARTITION BY artifact_id ORDER BY line_no) AS island FROM h),
headed AS (SELECT artifact_id, min(line_no) AS start_line, max(line_no) AS end_line, CASE WHEN sec = 0 THEN 'text_window' ELSE 'markdown_section' END AS chunk_type
 FROM g WHERE has_head GROUP BY artifact_id, sec HAVING bool_or(trim(line) <> '')),
paras AS (SELECT artifact_id, min(line_no) AS start_line, max(line_no) AS end_line, 'paragraph' AS chunk_type FROM g WHERE NOT has_head AND trim(line) <> '' GROUP BY artifact_id, island),
heads AS (SELECT artifact_id, line_no, level, head_text FROM h WHERE is_head),
trail AS (SELECT a.artifact_id, a.line_no, string_agg(b.head_text, ' > ' ORDER BY b.line_no) AS heading_path FROM heads a JOIN heads b ON b.artifact_id = a.artifact_id AND b.line_no <= a.line_no
 AND (b.line_no = a.line_no OR b.level < a.level) AND NOT EXISTS (SELECT 1 FROM heads c WHERE c.artifact_id = a.artifact_id AND c.line_no > b.line_no AND c.line_no <= a.line_no AND c.level <= b.level) GROUP BY ALL),
sections AS (SELECT s.*, coalesce(heading_path, '') AS heading_path FROM (SELECT * FROM headed UNION ALL SELECT * FROM paras) s LEFT JOIN trail t ON t.artifact_id = s.artifact_id AND t.line_no = s.start_line)"""
CHUNKS_SQL = f"""{_SECTIONS.replace('WITH ', 'WITH RECURSIVE ', 1)},
sl AS (SELECT s.artifact_id, s.start_line AS sec_start, s.end_line AS sec_end, s.chunk_type, s.heading_path, l.line_no, l.line, length(l.line) AS n FROM sections s JOIN lines l ON l.artifact_id = s.artifact_id AND l.line_no BETWEEN s.start_line AND s.end_line),
walk AS (SELECT artifact_id, sec_start, line_no, n AS chars, 1 AS cnt, line_no AS chunk_start FROM sl WHERE line_no = sec_start
 UNION ALL SELECT sl.artifact_id, sl.sec_start, sl.line_no,
  CASE WHEN w.cnt >= 80 OR w.chars + sl.n + 1 > 1200 THEN sl.n ELSE w.chars + sl.n + 1 END,
  CASE WHEN w.cnt >= 80 OR w.chars + sl.n + 1 > 1200 THEN 1 ELSE w.cnt + 1 END,
  CASE WHEN w.cnt >= 80 OR w.chars + sl.n + 1 > 1200 THEN sl.line_no ELSE w.chunk_start END
 FROM walk w JOIN sl ON sl.artifact_id = w.artifact_id AND sl.sec_start = w.sec_start AND sl.line_no = w.line_no + 1),
ck AS (SELECT w.artifact_id, sl.chunk_type, sl.heading_path, chunk_start AS start_line, max(w.line_no) AS end_line, trim(string_agg(sl.line, chr(10) ORDER BY w.line_no), chr(10) || chr(9) || ' ') AS text
 FROM walk w JOIN sl ON sl.artifact_id = w.artifact_id AND sl.sec_start = w.sec_start AND sl.line_no = w.line_no GROUP BY w.artifact_id, sl.chunk_type, sl.heading_path, w.sec_start, chunk_start),
ck2 AS (SELECT *, sha256(text) AS content_hash, row_number() OVER (PARTITION BY artifact_id ORDER BY start_line) - 1 AS chunk_index FROM ck),
chunks AS (SELECT *, 'chunk_' || substr(sha256(artifact_id || ':' || chunk_index || ':' || start_line || ':' || end_line || ':' || content_hash), 1, 16) AS chunk_id FROM ck2)"""

_NAME = "lower(regexp_extract(p, '([^/]+)$', 1))"
_TREE = f"""tree AS ({I.TREE}), n0 AS (SELECT *, trim(path) AS p FROM tree),
n1 AS (SELECT *, p = '' OR p LIKE '/%' OR contains(p, chr(92)) OR list_has_any(string_split(p, '/'), ['', '.', '..']) AS unsafe, {_NAME} AS nm,
 lower(regexp_extract(p, '.(\\.[^./]+)$', 1)) AS ext, list_has_any(list_transform(string_split(p, '/')[:-2], lambda x: lower(x)), ['docs', 'doc', 'documentation', 'examples', 'example']) AS in_docs,
 list_transform(string_split(p, '/'), lambda x: lower(x)) AS parts FROM n0),
n2 AS (SELECT *, CASE WHEN nm LIKE 'readme%' AND ext IN ('.md', '.markdown', '.txt') THEN 'readme'
 WHEN nm IN ({', '.join(f"'{x}'" for x in K.SCHEMA_NAMES)}) OR nm LIKE '%.schema.json' THEN 'tool_schema'
 WHEN nm IN ({', '.join(f"'{x}'" for x in K.MANIFEST_NAMES)}) THEN 'package_manifest' WHEN ext IN ('.md', '.markdown', '.txt') AND in_docs THEN 'documentation'
 WHEN ext IN ('.json', '.yaml', '.yml') AND in_docs THEN 'documentation_metadata' END AS kind FROM n1),
n3 AS (SELECT repo, doc_id, CASE WHEN unsafe THEN path ELSE p END AS path, size, kind, CASE WHEN unsafe THEN 'unsafe_path' WHEN type <> 'blob' THEN 'not_a_file'
 WHEN list_has_any(parts, [{', '.join(f"'{x}'" for x in K.IGNORED_PARTS)}]) OR nm IN ('.env', '.env.local', '.env.production', '.npmrc', '.pypirc', 'package-lock.json', 'pnpm-lock.yaml', 'yarn.lock', 'poetry.lock') OR nm LIKE '.env.%' THEN 'ignored_path'
 WHEN size > 1000000 THEN 'file_too_large' WHEN kind IS NULL THEN 'unsupported_file' END AS reason FROM n2),
n4 AS (SELECT *, CASE WHEN reason IS NULL THEN CASE kind WHEN 'readme' THEN 0 WHEN 'tool_schema' THEN 10 WHEN 'package_manifest' THEN 20 WHEN 'documentation' THEN 30 ELSE 40 END END AS priority FROM n3),
n5 AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY repo, reason IS NULL ORDER BY priority, lower(path), path) END AS rn FROM n4),
sel AS (SELECT repo, doc_id, path, size, priority, CASE WHEN rn > 100 THEN 'selection_limit' ELSE reason END AS skip_reason, CASE WHEN reason IS NULL AND rn <= 100 THEN kind END AS artifact_type FROM n5)"""
_ENC = "replace(replace(replace(replace({0}, '%', '%25'), ' ', '%20'), 'ü', '%C3%BC'), '*', '%2A')"
_CRAWL = f"""{_TREE}, selected AS (SELECT repo, doc_id, path, artifact_type, priority, size AS size_bytes FROM sel WHERE skip_reason IS NULL),
fetched AS (SELECT repo, path || CASE WHEN doc_id % 40 = 2 THEN '.bak' ELSE '' END AS path, path AS plain, doc_id, artifact_type, coalesce(size_bytes, 10) AS size_bytes,
 unnest(range(CASE WHEN doc_id % 50 = 1 THEN 2 ELSE 1 END)) AS cp FROM selected WHERE doc_id % 4 <> 0),
skipped AS (SELECT repo, path, 'discovery' AS stage, skip_reason AS reason FROM sel WHERE skip_reason IS NOT NULL UNION ALL SELECT repo, path, 'fetch', 'fetch failed' FROM selected WHERE doc_id % 4 = 0),
repos AS (SELECT DISTINCT repo FROM tree),
facts AS (SELECT repo, (SELECT count(*) FROM selected s WHERE s.repo = r.repo) AS ns, (SELECT count(*) FROM fetched s WHERE s.repo = r.repo) AS nf, (SELECT count(*) FROM skipped s WHERE s.repo = r.repo) AS nx,
 (SELECT count(*) FROM skipped s WHERE s.repo = r.repo AND stage = 'fetch') AS nfx, (SELECT coalesce(sum(size_bytes), 0) FROM fetched s WHERE s.repo = r.repo) AS nb,
 (SELECT count(*) FROM selected s WHERE s.repo = r.repo AND artifact_type = 'readme') AS nr,
 (SELECT count(*) FROM selected s JOIN fetched f ON f.repo = s.repo AND f.path = s.path WHERE s.repo = r.repo AND s.artifact_type = 'readme') AS nrf FROM repos r),
issues AS (SELECT repo, 'summary_mismatch' AS code, 'error' AS severity, 'Manifest summary field total_fetched_bytes does not match sum of fetched file sizes.' AS message, '' AS path FROM facts WHERE length(repo) = 5
 UNION ALL SELECT repo, 'insufficient_fetched_files', 'error', 'Crawl fetched fewer files than the minimum quality threshold.', '' FROM facts WHERE nf < 1
 UNION ALL SELECT repo, 'high_fetch_skip_ratio', 'warning', 'More fetched candidates failed than the crawl quality threshold allows.', '' FROM facts WHERE nf + nfx > 0 AND nfx / (nf + nfx) > 0.3
 UNION ALL SELECT repo, 'readme_not_selected', 'warning', 'Crawl did not select a README artifact.', '' FROM facts WHERE nr = 0
 UNION ALL SELECT repo, 'readme_not_fetched', 'warning', 'Crawl selected a README artifact but did not fetch it.', '' FROM facts WHERE nr > 0 AND nrf = 0
 UNION ALL SELECT repo, 'duplicate_fetched_path', 'error', 'Crawl manifest contains duplicate paths.', path FROM fetched GROUP BY repo, path HAVING count(*) > 1
 UNION ALL SELECT repo, 'fetched_file_not_selected', 'error', 'Fetched file was not present in selected file list.', path FROM fetched WHERE doc_id % 40 = 2
 UNION ALL SELECT repo, 'invalid_content_hash', 'error', 'Fetched file content hash is not a SHA-256 hex digest.', path FROM fetched WHERE doc_id % 20 = 5
 UNION ALL SELECT repo, 'raw_url_mismatch', 'error', 'Fetched file raw URL does not match the manifest source, ref, and path.', path FROM fetched WHERE doc_id % 30 = 7 OR doc_id % 40 = 2)"""
_URL = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
_MAN_SQL = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::HUGEINT)::VARCHAR" for i in range(4))

QUERIES = {
    "a3_tree_file": (tree_file_query, f"WITH tree AS ({I.TREE}) SELECT repo, path, type, CASE WHEN doc_id % 89 = 0 THEN -1 ELSE size END AS size FROM tree WHERE doc_id % 97 <> 0 AND doc_id % 89 <> 0"),
    "a13_crawl_manifests": (manifest_file_query, f"WITH {_CRAWL} SELECT 'selected' AS part, repo, path FROM selected UNION ALL SELECT 'fetched', repo, path FROM fetched UNION ALL SELECT 'skipped', repo, path FROM skipped"),
    "a4_response_admission": (responses_query, """WITH r AS (SELECT page_id, page_id AS p, strlen(html) AS hl, html,
 CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 17 = 1 THEN 503 ELSE 200 END AS status,
 strlen(html) + CASE page_id % 13 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 3 ELSE 0 END AS size_bytes FROM pages),
c AS (SELECT *, CASE WHEN status <> 200 THEN 'GitHub raw file fetch returned HTTP ' || status || '.'
 WHEN p % 11 = 0 THEN 'GitHub raw file response has an invalid Content-Length.' WHEN p % 11 = 1 OR (p % 11 = 2 AND hl > 1000000) THEN 'GitHub raw file exceeds the maximum allowed size.'
 WHEN size_bytes > 1000000 THEN 'Fetched GitHub file exceeds the maximum allowed size.' WHEN p % 7 = 0 THEN 'Fetched GitHub file is not a supported text content type.'
 WHEN p % 13 = 4 THEN 'Fetched GitHub file contains binary data.' WHEN p % 13 = 3 THEN 'Fetched GitHub file is not valid UTF-8 text.' ELSE '' END AS skip_reason FROM r)
SELECT page_id, skip_reason, size_bytes, CASE WHEN skip_reason = '' THEN sha256(CASE WHEN p % 13 = 5 THEN chr(65279) ELSE '' END || html) ELSE '' END AS content_hash,
 CASE WHEN skip_reason = '' THEN sha256(html) ELSE '' END AS text_hash FROM c"""),
    "b8_headings": (lambda s, d: M.headings(classed(s, d), "artifact_id"), f"""{_MARKED} SELECT artifact_id, length(regexp_extract(line, {_HEAD}, 1)) AS level,
 trim(regexp_extract(line, {_HEAD}, 2)) AS text, line_no AS start_line, line_no AS end_line FROM typed WHERE is_head"""),
    "b9_code_blocks": (lambda s, d: M.code_blocks(classed(s, d), "artifact_id").withColumn("language", F.coalesce("language", F.lit(""))), f"""{_MARKED}
SELECT b.artifact_id, open_line AS start_line, close_line AS end_line, b.language, coalesce((SELECT string_agg(line, chr(10) ORDER BY line_no) FROM lines l
 WHERE l.artifact_id = b.artifact_id AND l.line_no > open_line AND (l.line_no < close_line OR (NOT closed AND l.line_no = close_line))), '') AS text FROM blocks b"""),
    "b10_paragraphs": (lambda s, d: M.paragraphs(classed(s, d), "artifact_id").select("artifact_id", "start_line", "end_line", F.sha2("text", 256).alias("text_hash")),
                       f"{_MARKED}, {_PARAGRAPHS} SELECT artifact_id, start_line, end_line, sha256(text) AS text_hash FROM paragraphs"),
    "b11_links": (lambda s, d: M.links(classed(s, d), "artifact_id").drop("pos"), f"{_MARKED}, {_LINKS} SELECT artifact_id, label, url, line_no AS start_line, line_no AS end_line FROM links"),
    "b12_env_vars": (lambda s, d: M.env_vars(classed(s, d), "artifact_id"), f"{_MARKED}, {_ENVS} SELECT artifact_id, name, line_no AS start_line, line_no AS end_line FROM envs"),
    "b13_tool_schemas": (tools_query, f"""WITH {_JSON} SELECT doc_id, tool_pos, name, coalesce(t ->> '$.description', '') AS description,
 coalesce(array_to_string(CAST(ps -> '$.required' AS VARCHAR[]), ','), '') AS required_fields,
 coalesce(array_to_string(list_transform(CASE WHEN json_exists(t, '$.examples') THEN json_extract(t, '$.examples[*]') WHEN json_exists(t, '$.example') THEN [t -> '$.example'] END, lambda x: CAST(x AS VARCHAR)), '|'), '') AS examples,
 array_to_string({_URLS.format('t')}, ' ') AS urls FROM tools"""),
    "b15_tool_parameters": (parameters_query, f"""WITH {_JSON}, pairs AS (SELECT doc_id, tool_pos, ps, json_exists(ps, '$.properties') AS in_props,
 CASE WHEN json_exists(ps, '$.properties') THEN ps -> '$.properties' ELSE ps END AS src FROM tools WHERE ps IS NOT NULL),
kv AS (SELECT *, unnest(json_keys(src)) AS name FROM pairs), v AS (SELECT *, json_extract(src, '$."' || name || '"') AS v FROM kv WHERE in_props OR name NOT IN ('type', 'required', 'description', 'title', 'examples', 'example'))
SELECT doc_id, tool_pos, name, coalesce(CASE WHEN json_type(v) = 'OBJECT' THEN v ->> '$.description' END, '') AS description,
 coalesce(list_contains(CAST(ps -> '$.required' AS VARCHAR[]), name), false) AS required,
 CASE WHEN json_type(v) = 'OBJECT' THEN CASE WHEN json_exists(v, '$.description') AND json_exists(v, '$.type') THEN '{{"description":' || CAST(v -> '$.description' AS VARCHAR) || ',"type":' || CAST(v -> '$.type' AS VARCHAR) || '}}' ELSE CAST(v AS VARCHAR) END
  ELSE '{{"value":' || CAST(v AS VARCHAR) || '}}' END AS raw_schema FROM v"""),
    "b16_schema_urls": (schema_url_query, f"""WITH s AS ({I.SCHEMAS}), js AS (SELECT doc_id, TRY_CAST(schema_text AS JSON) AS j FROM s)
SELECT doc_id, CASE WHEN j IS NULL THEN '' ELSE array_to_string({_URLS.format('j')}, ' ') END AS urls, CASE WHEN j IS NULL THEN 'Invalid JSON schema' ELSE '' END AS parse_error FROM js"""),
    "b18_parsed_artifacts": (lambda s, d: parsed_artifacts(s, d).select("artifact_id", "artifact_type", "parsed_item_count", F.coalesce("parse_error", F.lit("")).alias("parse_error")),
                             f"{_PARSED} SELECT artifact_id, artifact_type, parsed_item_count, parse_error FROM parsed"),
    "d4_scan_summary": (scan_summary_query, f"""{_PARSED}, {FINDINGS}, {RISK}, pc AS (SELECT run_id, count(*) AS n, sum(parsed_item_count) AS items, count(*) FILTER (parse_error <> '') AS bad FROM parsed GROUP BY 1),
 sk AS (SELECT run_id, count(*) AS n FROM checked WHERE skip_reason IS NOT NULL GROUP BY 1)
SELECT r.run_id, coalesce(pc.n, 0) AS scanned_file_count, coalesce(sk.n, 0) AS skipped_count, coalesce(items, 0) AS parsed_item_count, coalesce(bad, 0) AS parse_error_count,
 finding_count, risk_score, risk_level, policy_decision FROM risk r LEFT JOIN pc USING (run_id) LEFT JOIN sk USING (run_id)"""),
    "b19_repo_urls": (repo_url_query, rf"""WITH u AS ({I.REPO_URLS}), a AS (SELECT page_id, trim(raw_url) AS t FROM u),
b AS (SELECT *, lower(regexp_extract(t, {_URL}, 1)) AS scheme, regexp_extract(t, {_URL}, 2) AS auth, list_filter(string_split(regexp_extract(t, {_URL}, 3), '/'), lambda x: x <> '') AS seg,
 regexp_extract(t, {_URL}, 4) AS q, regexp_extract(t, {_URL}, 5) AS fr FROM a),
c AS (SELECT *, regexp_extract(auth, '([^@]*)$', 1) AS hp, lower(seg[1]) AS o, regexp_replace(lower(seg[2]), '\.git$', '') AS r FROM b),
e AS (SELECT *, CASE WHEN t = '' THEN 'GitHub repository URL is required.' WHEN scheme NOT IN ('http', 'https') THEN 'GitHub repository URL must use http or https.'
 WHEN lower(regexp_extract(hp, '^([^:]*)', 1)) NOT IN ('github.com', 'www.github.com') THEN 'GitHub repository URL must use github.com.' WHEN contains(auth, '@') THEN 'GitHub repository URL must not include credentials.'
 WHEN regexp_matches(hp, ':.*[^0-9]') THEN 'GitHub repository URL has an invalid port.' WHEN regexp_matches(hp, ':.+') THEN 'GitHub repository URL must not include a port.'
 WHEN q <> '' OR fr <> '' THEN 'GitHub repository URL must not include query strings or fragments.' WHEN len(seg) <> 2 THEN 'GitHub repository URL must point to a repository root.'
 WHEN NOT regexp_matches(o, '^[a-z0-9](?:[a-z0-9-]{{0,37}}[a-z0-9])?$') THEN 'GitHub repository owner is invalid.' WHEN contains(seg[2], '%') THEN 'GitHub repository repository name contains unsafe characters.'
 WHEN NOT regexp_matches(r, '^[a-z0-9._-]{{1,100}}$') THEN 'GitHub repository name is invalid.' ELSE '' END AS error FROM c)
SELECT page_id, error, CASE WHEN error = '' THEN 'https://github.com/' || o || '/' || r ELSE '' END AS canonical_url, CASE WHEN error = '' THEN o ELSE '' END AS owner, CASE WHEN error = '' THEN r ELSE '' END AS repo_name FROM e"""),
    "b21_tree_classification": (classify_query, f"""WITH {_TREE} SELECT repo, doc_id, path, coalesce(reason, '') AS skip_reason, CASE WHEN reason IS NULL THEN kind ELSE '' END AS artifact_type, coalesce(priority, -1) AS priority FROM n4"""),
    "b22_raw_urls": (raw_url_query, f"""WITH tree AS ({I.TREE}), a AS (SELECT doc_id, repo, trim(CASE WHEN doc_id % 3 = 0 THEN 'a b/ü*' || path ELSE path END) AS p, doc_id % 10 = 0 AS bad FROM tree),
e AS (SELECT *, CASE WHEN bad THEN 'GitHub ref must be a simple branch, tag, or commit identifier.' WHEN p = '' OR p LIKE '/%' OR contains(p, chr(92)) OR list_has_any(string_split(p, '/'), ['', '.', '..']) THEN 'GitHub file path is unsafe.' ELSE '' END AS url_error FROM a)
SELECT doc_id, url_error, CASE WHEN url_error = '' THEN 'https://raw.githubusercontent.com/acme/' || repo || '/v1.0/' || {_ENC.format('p')} ELSE '' END AS raw_url FROM e"""),
    "f1_file_selection": (selection_query, f"""WITH {_TREE.replace("rn > 100", "rn > 7").replace("rn <= 100", "rn <= 7")} SELECT repo, doc_id, path, coalesce(skip_reason, '') AS skip_reason, coalesce(artifact_type, '') AS artifact_type FROM sel"""),
    "g6_staged_skips": (skips_query, f"WITH {_CRAWL} SELECT repo, path, stage, reason FROM skipped"),
    "d5_crawl_summary": (summary_query, f"WITH {_CRAWL} SELECT repo, ns AS selected_file_count, nf AS fetched_file_count, nx AS skipped_path_count, nb AS total_fetched_bytes FROM facts"),
    "d5_fetched_type_counts": (lambda s, d: K.fetched_type_counts(crawl_tables(s, d)[1]), f"WITH {_CRAWL} SELECT repo, artifact_type, count(*) AS file_count FROM fetched GROUP BY 1, 2"),
    "d6_manifest_hash": (manifest_query, f"""WITH {_CRAWL}, rows AS (SELECT repo, sha256('{{"artifact_type":"' || artifact_type || '","content_hash":"' || CASE WHEN doc_id % 20 = 5 THEN 'ABC' ELSE sha256(plain) END || '","part":"fetched","path":"' || path
 || '","raw_url":"' || CASE WHEN doc_id % 30 = 7 THEN 'https://example.com/x' ELSE 'https://raw.githubusercontent.com/acme/' || repo || '/main/' || plain END || '","repo":"' || repo || '","size_bytes":' || size_bytes || '}}') AS h FROM fetched
 UNION ALL SELECT repo, sha256('{{"part":"skipped","path":' || to_json(path) || ',"reason":"' || reason || '","repo":"' || repo || '","stage":"' || stage || '"}}') FROM skipped
 UNION ALL SELECT repo, sha256('{{"artifact_type":"' || artifact_type || '","part":"selected","path":"' || path || '","priority":' || priority || ',"repo":"' || repo || '","size_bytes":' || coalesce(size_bytes::VARCHAR, 'null') || '}}') AS h FROM selected)
SELECT repo, sha256('{K.MANIFEST_VERSION}:' || repo || ':' || sha256(concat_ws(':', count(*)::VARCHAR, {_MAN_SQL}))) AS manifest_hash FROM rows GROUP BY repo"""),
    "d7_crawl_quality_issues": (quality_query, f"WITH {_CRAWL} SELECT * FROM issues"),
    "d7_crawl_quality_reports": (quality_report_query, f"""WITH {_CRAWL}, c AS (SELECT repo, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM issues GROUP BY 1)
SELECT r.repo, CASE WHEN coalesce(e, 0) > 0 THEN 'fail' WHEN coalesce(w, 0) > 0 THEN 'warn' ELSE 'pass' END AS status, coalesce(e, 0) AS error_count, coalesce(w, 0) AS warning_count FROM repos r LEFT JOIN c USING (repo)"""),
    "e1_sections": (section_query, f"{_SECTIONS} SELECT artifact_id, start_line, end_line, chunk_type, heading_path FROM sections"),
    "e4_chunks": (chunk_query, f"{CHUNKS_SQL} SELECT artifact_id, chunk_index, start_line, end_line, chunk_type, heading_path, content_hash, chunk_id FROM chunks"),
}
