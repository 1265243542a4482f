"""Repository crawl: URL and path checks, file selection, fetch admission, manifest, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docvet.functions.ids import canonical_hash, multiset_digest
from docvet.functions.numbers import rate
from docvet.functions.text import compute_once, strip
from docvet.sources.files import suffix

# Name sets of the file selection.
IGNORED_PARTS = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", "node_modules", "dist", "build", "coverage",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", "raw_artifacts", "parsed_artifacts", "evidence_spans",
)
SECRET_NAMES = (".env", ".env.local", ".env.production", ".npmrc", ".pypirc")
LOCKFILE_NAMES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock")
DOC_EXTENSIONS = (".md", ".markdown", ".txt")
SCHEMA_EXTENSIONS = (".json", ".yaml", ".yml")
SCHEMA_NAMES = (
    "ai-plugin.json", "mcp.json", "mcp.yaml", "mcp.yml", "mcp-server.json", "mcp-server.yaml", "mcp-server.yml",
    "openapi.json", "openapi.yaml", "openapi.yml", "schema.json", "schema.yaml", "schema.yml", "swagger.json",
    "tool.json", "tool.yaml", "tool.yml", "tools.json", "tools.yaml", "tools.yml",
)
MANIFEST_NAMES = ("cargo.toml", "go.mod", "package.json", "pyproject.toml", "requirements-dev.txt", "requirements.txt")
DOC_FOLDERS = ("docs", "doc", "documentation", "examples", "example")
FILE_PRIORITY = {"readme": 0, "tool_schema": 10, "package_manifest": 20, "documentation": 30, "documentation_metadata": 40}
TEXT_CONTENT_TYPES = ("application/json", "application/toml", "application/xml", "application/yaml", "application/x-yaml")
ALLOWED_REPO_HOSTS = ("github.com", "www.github.com")
RAW_HOST = "raw.githubusercontent.com"
OWNER_PATTERN = "^[a-z0-9](?:[a-z0-9-]{0,37}[a-z0-9])?$"
REPO_PATTERN = "^[a-z0-9._-]{1,100}$"
REF_PATTERN = "^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
MAX_FILE_BYTES = 1_000_000
MAX_SELECTED_FILES = 100
MANIFEST_VERSION = "github-text-crawl-manifest/v0.1"

# Scheme, authority, path, query and fragment of a URL (RFC 3986, appendix B).
URL_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def canonicalize_repo_urls(urls: DataFrame, raw_url: str = "raw_url") -> DataFrame:
    """Add canonical_url, owner, repo_name, or the first ``error`` that applies."""
    text = strip(F.col(raw_url))
    parts = compute_once(
        urls,
        u_text=text,
        u_scheme=F.lower(F.regexp_extract(text, URL_PARTS, 1)),
        u_authority=F.regexp_extract(text, URL_PARTS, 2),
        u_query=F.regexp_extract(text, URL_PARTS, 4),
        u_fragment=F.regexp_extract(text, URL_PARTS, 5),
        u_segments=F.filter(F.split(F.regexp_extract(text, URL_PARTS, 3), "/"), lambda s: s != ""),
    )
    host_port = F.regexp_extract("u_authority", "([^@]*)$", 1)
    user_info = F.regexp_extract("u_authority", "^(.*)@", 1)
    owner_raw, repo_raw = F.get("u_segments", F.lit(0)), F.get("u_segments", F.lit(1))
    repo_lower = F.lower(strip(repo_raw))
    split_up = compute_once(
        parts,
        u_host=F.lower(F.regexp_extract(host_port, "^([^:]*)", 1)),
        u_port=F.regexp_extract(host_port, ":(.*)$", 1),
        u_user=F.regexp_replace(user_info, "^:$", ""),
        u_owner_raw=owner_raw, u_repo_raw=repo_raw,
        u_owner=F.lower(strip(owner_raw)),
        u_repo_name=repo_lower,
        u_repo=F.regexp_replace(repo_lower, r"\.git$", ""),
    )
    c = F.col
    unsafe = r"[%\\]"
    bad_port = (c("u_port") != "") & (~c("u_port").rlike("^[0-9]+$") | (c("u_port").try_cast("bigint") > 65535))
    error = (
        F.when(c("u_text") == "", "GitHub repository URL is required.")
        .when(~c("u_scheme").isin("http", "https"), "GitHub repository URL must use http or https.")
        .when(~c("u_host").isin(*ALLOWED_REPO_HOSTS), "GitHub repository URL must use github.com.")
        .when(c("u_user") != "", "GitHub repository URL must not include credentials.")
        .when(bad_port, "GitHub repository URL has an invalid port.")
        .when(c("u_port") != "", "GitHub repository URL must not include a port.")
        .when((c("u_query") != "") | (c("u_fragment") != ""), "GitHub repository URL must not include query strings or fragments.")
        .when(F.size("u_segments") != 2, "GitHub repository URL must point to a repository root.")
        .when(c("u_owner_raw").rlike(unsafe), "GitHub repository owner contains unsafe characters.")
        .when(c("u_owner").isin("", ".", ".."), "GitHub repository owner is invalid.")
        .when(~c("u_owner").rlike(OWNER_PATTERN), "GitHub repository owner is invalid.")
        .when(c("u_repo_raw").rlike(unsafe), "GitHub repository repository name contains unsafe characters.")
        .when(c("u_repo_name").isin("", ".", ".."), "GitHub repository repository name is invalid.")
        .when(c("u_repo").isin("", ".", "..") | ~c("u_repo").rlike(REPO_PATTERN), "GitHub repository name is invalid.")
    )
    keep = urls.columns
    checked = split_up.withColumn("error", error)
    ok = c("error").isNull()
    return checked.select(
        *keep, "error",
        F.when(ok, F.concat(F.lit("https://github.com/"), "u_owner", F.lit("/"), "u_repo")).alias("canonical_url"),
        F.when(ok, c("u_owner")).alias("owner"), F.when(ok, c("u_repo")).alias("repo_name"),
    )


def normalize_tree_path(path: Column) -> Column:
    """Trimmed relative path, or null where the path is unsafe."""
    text = strip(path)
    unsafe = (
        (text == "") | text.startswith("/") | text.contains("\\") | text.contains("\x00")
        | F.arrays_overlap(F.split(text, "/"), _literals(("", ".", "..")))
    )
    return F.when(~unsafe, text)


def classify_file(path: Column) -> Column:
    """readme, tool_schema, package_manifest, documentation, documentation_metadata or null."""
    lowered = F.split(F.lower(path), "/")
    name = F.element_at(lowered, -1)
    extension = suffix(path)
    folders = F.slice(lowered, F.lit(1), F.size(lowered) - 1)
    in_docs = F.arrays_overlap(folders, _literals(DOC_FOLDERS))
    return (
        F.when(name.startswith("readme") & extension.isin(*DOC_EXTENSIONS), "readme")
        .when(name.isin(*SCHEMA_NAMES) | name.endswith(".schema.json"), "tool_schema")
        .when(name.isin(*MANIFEST_NAMES), "package_manifest")
        .when(extension.isin(*DOC_EXTENSIONS) & in_docs, "documentation")
        .when(extension.isin(*SCHEMA_EXTENSIONS) & in_docs, "documentation_metadata")
    )


def classify_tree(tree: DataFrame, max_file_size_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Normalised path, artifact type with priority, or the reason the item is skipped."""
    normal = compute_once(tree, tree_path=normalize_tree_path(F.col("path")), kind=classify_file(strip(F.col("path"))))
    lowered = F.split(F.lower("tree_path"), "/")
    name = F.element_at(lowered, -1)
    ignored = (
        F.arrays_overlap(lowered, _literals(IGNORED_PARTS))
        | name.isin(*SECRET_NAMES, *LOCKFILE_NAMES) | name.startswith(".env.")
    )
    reason = (
        F.when(F.col("tree_path").isNull(), "unsafe_path")
        .when(F.col("type") != "blob", "not_a_file")
        .when(ignored, "ignored_path")
        .when(F.col("size") > max_file_size_bytes, "file_too_large")
        .when(F.col("kind").isNull(), "unsupported_file")
    )
    priority = F.lit(None).cast("int")
    for kind, rank in FILE_PRIORITY.items():
        priority = F.when(F.col("kind") == kind, rank).otherwise(priority)
    others = [c for c in tree.columns if c not in ("path", "size")]
    return normal.select(
        *others, F.coalesce("tree_path", "path").alias("path"), F.col("size").alias("size_bytes"),
        reason.alias("skip_reason"),
        F.when(reason.isNull(), F.col("kind")).alias("artifact_type"),
        F.when(reason.isNull(), priority).alias("priority"),
    )


def select_relevant_files(
    tree: DataFrame, max_file_size_bytes: int = MAX_FILE_BYTES, max_selected_files: int = MAX_SELECTED_FILES
) -> DataFrame:
    """Every tree item with ``skip_reason`` null (selected) or set, at most k selected per repo.

    Only the k-th best key of each repo is looked for: the rank filter trims every map task to k
    rows per repo before the shuffle, and the cut-off row then joins back to decide the rest.
    """
    if max_selected_files < 1:
        raise ValueError("max_selected_files must be at least 1.")
    classified = classify_tree(tree, max_file_size_bytes)
    key = F.struct("priority", F.lower("path").alias("lower_path"), F.col("path").alias("full_path"))
    best_first = Window.partitionBy("repo").orderBy("priority", F.lower("path"), "path")
    top = (
        classified.where(F.col("skip_reason").isNull())
        .select("repo", "priority", "path", F.row_number().over(best_first).alias("rank"))
        .where(F.col("rank") <= max_selected_files)
    )
    cutoff = top.groupBy("repo").agg(F.max(key).alias("cutoff"))
    limited = classified.join(cutoff, "repo", "left")
    over = F.col("skip_reason").isNull() & (key > F.col("cutoff"))
    return limited.select(
        *[c for c in classified.columns if c not in ("skip_reason", "artifact_type", "priority")],
        F.when(over, "selection_limit").otherwise(F.col("skip_reason")).alias("skip_reason"),
        F.when(~over, F.col("artifact_type")).alias("artifact_type"),
        F.when(~over, F.col("priority")).alias("priority"),
    )


def encode_segment(segment: Column) -> Column:
    """Percent-encoding of one path segment (space is %20, '*' and '~' as in RFC 3986)."""
    encoded = F.url_encode(segment)
    return F.replace(F.replace(F.replace(encoded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def raw_file_urls(files: DataFrame) -> DataFrame:
    """Raw URL of (owner, repo_name, ref, path), or the error that forbids it."""
    path, ref = strip(F.col("path")), strip(F.col("ref"))
    bad_ref = ~ref.rlike(REF_PATTERN)
    bad_path = normalize_tree_path(F.col("path")).isNull() | path.contains("%")
    error = F.when(bad_ref, "GitHub ref must be a simple branch, tag, or commit identifier.").when(
        bad_path, "GitHub file path is unsafe."
    )
    encoded = F.array_join(F.transform(F.split(path, "/"), encode_segment), "/")
    url = F.concat(
        F.lit(f"https://{RAW_HOST}/"), encode_segment(F.col("owner")), F.lit("/"), encode_segment(F.col("repo_name")),
        F.lit("/"), encode_segment(ref), F.lit("/"), encoded,
    )
    return files.select("*", error.alias("url_error"), F.when(error.isNull(), url).alias("raw_url"))


def admit_responses(responses: DataFrame, max_file_size_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Add ``skip_reason`` or the decoded text, size and hash of each fetched response.

    ``responses(..., status INT, headers MAP<STRING,STRING>, content BINARY)``, header names lower-case.
    """
    content = F.col("content")
    size = F.octet_length(content)
    declared = F.trim(F.col("headers")["content-length"])
    content_type = F.col("headers")["content-type"]
    media = F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1)))
    is_text = media.startswith("text/") | media.isin(*TEXT_CONTENT_TYPES)
    reason = (
        F.when(F.col("status") != 200, F.format_string("GitHub raw file fetch returned HTTP %d.", F.col("status")))
        .when(declared.isNotNull() & declared.try_cast("bigint").isNull(), "GitHub raw file response has an invalid Content-Length.")
        .when(declared.try_cast("bigint") > max_file_size_bytes, "GitHub raw file exceeds the maximum allowed size.")
        .when(size > max_file_size_bytes, "Fetched GitHub file exceeds the maximum allowed size.")
        .when((content_type != "") & ~is_text, "Fetched GitHub file is not a supported text content type.")
        .when(F.contains(content, F.lit(b"\x00")), "Fetched GitHub file contains binary data.")
        .when(~F.is_valid_utf8(content.cast("string")), "Fetched GitHub file is not valid UTF-8 text.")
    )
    checked = compute_once(responses, skip_reason=reason)
    ok = F.col("skip_reason").isNull()
    text = F.regexp_replace(content.cast("string"), "^\ufeff", "")
    return checked.select(
        *[c for c in responses.columns if c not in ("content", "headers")],
        "skip_reason", size.alias("size_bytes"), content_type.alias("content_type"),
        F.when(ok, F.sha2(content, 256)).alias("content_hash"), F.when(ok, text).alias("text"),
    )


def tag_skips(discovery: DataFrame, fetch: DataFrame) -> DataFrame:
    """Discovery and fetch skips in one table, told apart by ``stage``."""
    return discovery.select("repo", "path", F.lit("discovery").alias("stage"), "reason").unionByName(
        fetch.select("repo", "path", F.lit("fetch").alias("stage"), "reason")
    )


def _manifest_rows(selected: DataFrame, fetched: DataFrame, skipped: DataFrame) -> DataFrame:
    """All rows of a crawl in one table: which part, size, stage and the hash of the row."""
    def part(df: DataFrame, name: str) -> DataFrame:
        tagged = df.withColumn("part", F.lit(name))
        size = F.col("size_bytes").cast("bigint") if name == "fetched" else F.lit(0).cast("bigint")
        stage = F.col("stage") if name == "skipped" else F.lit(None).cast("string")
        return tagged.select("repo", "part", size.alias("bytes"), stage.alias("stage"), canonical_hash(*tagged.columns).alias("row_hash"))

    return part(selected, "selected").unionByName(part(fetched, "fetched")).unionByName(part(skipped, "skipped"))


_SUMMARY = ("selected_file_count", "fetched_file_count", "skipped_path_count", "total_fetched_bytes")


def _summary_columns() -> list[Column]:
    return [
        F.count_if(F.col("part") == "selected").alias("selected_file_count"),
        F.count_if(F.col("part") == "fetched").alias("fetched_file_count"),
        F.count_if(F.col("part") == "skipped").alias("skipped_path_count"),
        F.sum("bytes").alias("total_fetched_bytes"),
    ]


def crawl_summary(selected: DataFrame, fetched: DataFrame, skipped: DataFrame) -> DataFrame:
    """Counts per repo from one folded aggregate over all rows of the crawl."""
    return _manifest_rows(selected, fetched, skipped).groupBy("repo").agg(*_summary_columns())


def fetched_type_counts(fetched: DataFrame) -> DataFrame:
    return fetched.groupBy("repo", "artifact_type").agg(F.count("*").alias("file_count"))


def _manifest_hash() -> Column:
    return F.sha2(F.concat_ws(":", F.lit(MANIFEST_VERSION), "repo", "row_digest"), 256)


def manifest_hashes(selected: DataFrame, fetched: DataFrame, skipped: DataFrame) -> DataFrame:
    """Digest of all manifest rows of a repo; the row order does not matter."""
    rows = _manifest_rows(selected, fetched, skipped)
    return rows.groupBy("repo").agg(multiset_digest(F.col("row_hash")).alias("row_digest")).select(
        "repo", _manifest_hash().alias("manifest_hash")
    )


def recorded_manifests(selected: DataFrame, fetched: DataFrame, skipped: DataFrame) -> DataFrame:
    """Summary and hash of every crawl in one pass, with the type counts as a map."""
    rows = _manifest_rows(selected, fetched, skipped).groupBy("repo").agg(
        *_summary_columns(), multiset_digest(F.col("row_hash")).alias("row_digest")
    )
    # One entry per artifact type of a repo: bounded by the known file kinds.
    types = fetched_type_counts(fetched).groupBy("repo").agg(
        F.map_from_entries(F.collect_list(F.struct("artifact_type", "file_count"))).alias("fetched_artifact_type_counts")
    )
    return rows.join(types, "repo", "left").select(
        "repo", *_SUMMARY, _manifest_hash().alias("manifest_hash"),
        F.coalesce("fetched_artifact_type_counts", F.create_map().cast("map<string,bigint>")).alias("fetched_artifact_type_counts"),
    )


def _issue(df: DataFrame, code: str, severity: str, message, path: str | None = None) -> DataFrame:
    text = message if isinstance(message, Column) else F.lit(message)
    where = F.col(path) if path else F.lit(None).cast("string")
    return df.select("repo", F.lit(code).alias("code"), F.lit(severity).alias("severity"), text.alias("message"), where.alias("path"))


def _path_issue(code: str, message: str, copies: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), copies.alias("copies"))


def crawl_quality_issues(
    manifests: DataFrame,
    selected: DataFrame,
    fetched: DataFrame,
    skipped: DataFrame,
    min_fetched_files: int = 1,
    max_fetch_skip_ratio: float = 0.5,
    require_readme: bool = True,
) -> DataFrame:
    """All issues of all crawls.

    ``manifests(repo, owner, repo_name, ref, manifest_hash, selected_file_count, fetched_file_count,
    skipped_path_count, total_fetched_bytes, fetched_artifact_type_counts MAP<STRING,BIGINT>)`` are
    the recorded values; they are checked against the child tables.
    """
    c = F.col
    actual = recorded_manifests(selected, fetched, skipped)
    actual = actual.select("repo", *[F.col(n).alias(f"true_{n}") for n in actual.columns if n != "repo"])
    per_path = (
        selected.select("repo", "path", F.lit(1).alias("s"), F.lit(0).alias("f"), (F.col("artifact_type") == "readme").alias("readme"))
        .unionByName(fetched.select("repo", "path", F.lit(0).alias("s"), F.lit(1).alias("f"), F.lit(False).alias("readme")))
        .groupBy("repo", "path")
        .agg(F.sum("s").alias("selected_n"), F.sum("f").alias("fetched_n"), F.bool_or("readme").alias("readme"))
    )
    readmes = per_path.where("readme").groupBy("repo").agg(
        F.count("*").alias("readme_selected"), F.count_if(F.col("fetched_n") > 0).alias("readme_fetched")
    )
    fetch_skips = skipped.where(c("stage") == "fetch").groupBy("repo").agg(F.count("*").alias("fetch_skips"))
    facts = manifests.join(actual, "repo", "left").join(fetch_skips, "repo", "left").join(readmes, "repo", "left").fillna(
        0, [*[f"true_{n}" for n in _SUMMARY], "fetch_skips", "readme_selected", "readme_fetched"]
    )

    def entries(counts: str) -> Column:
        listed = F.array_sort(F.map_entries(F.coalesce(counts, F.create_map().cast("map<string,bigint>"))))
        return F.to_json(F.transform(listed, lambda e: F.struct(e["key"].alias("key"), e["value"].cast("bigint").alias("value"))))

    same_types = entries("fetched_artifact_type_counts") == entries("true_fetched_artifact_type_counts")
    skip_ratio = rate(c("fetch_skips"), c("true_fetched_file_count") + c("fetch_skips"))

    def mismatch(field: str, expected: str) -> Column:
        return F.lit(f"Manifest summary field {field} does not match {expected}.")

    checks = [
        (~c("manifest_hash").eqNullSafe(c("true_manifest_hash")), "manifest_hash_mismatch", "error", F.lit("Manifest hash does not match manifest contents.")),
        (c("selected_file_count") != c("true_selected_file_count"), "summary_mismatch", "error", mismatch("selected_file_count", "selected file list length")),
        (c("fetched_file_count") != c("true_fetched_file_count"), "summary_mismatch", "error", mismatch("fetched_file_count", "fetched file list length")),
        (c("skipped_path_count") != c("true_skipped_path_count"), "summary_mismatch", "error", mismatch("skipped_path_count", "skipped path list length")),
        (c("total_fetched_bytes") != c("true_total_fetched_bytes"), "summary_mismatch", "error", mismatch("total_fetched_bytes", "sum of fetched file sizes")),
        (~same_types, "summary_mismatch", "error", mismatch("fetched_artifact_type_counts", "fetched file artifact type counts")),
        (c("true_fetched_file_count") < min_fetched_files, "insufficient_fetched_files", "error", F.lit("Crawl fetched fewer files than the minimum quality threshold.")),
        (skip_ratio > max_fetch_skip_ratio, "high_fetch_skip_ratio", "warning", F.lit("More fetched candidates failed than the crawl quality threshold allows.")),
    ]
    if require_readme:
        none_selected = c("readme_selected") == 0
        checks += [
            (none_selected, "readme_not_selected", "warning", F.lit("Crawl did not select a README artifact.")),
            (~none_selected & (c("readme_fetched") == 0), "readme_not_fetched", "warning", F.lit("Crawl selected a README artifact but did not fetch it.")),
        ]
    found = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message")))
        for test, code, severity, message in checks
    ]))
    repo_issues = facts.select("repo", F.inline(found)).withColumn("path", F.lit(None).cast("string"))

    # A stray path is reported once per fetched row, a duplicate once per path.
    path_tests = F.array_compact(F.array(
        F.when(c("selected_n") > 1, _path_issue("duplicate_selected_path", "Crawl manifest contains duplicate paths.", F.lit(1))),
        F.when(c("fetched_n") > 1, _path_issue("duplicate_fetched_path", "Crawl manifest contains duplicate paths.", F.lit(1))),
        F.when(c("selected_n") == 0, _path_issue("fetched_file_not_selected", "Fetched file was not present in selected file list.", c("fetched_n"))),
    ))
    path_issues = per_path.select("repo", "path", F.inline(path_tests)).select(
        "repo", "code", F.lit("error").alias("severity"), "message", "path", F.explode(F.sequence(F.lit(1), c("copies").cast("int"))).alias("copy")
    ).drop("copy")
    bad_hash = _issue(fetched.where(~c("content_hash").rlike("^[0-9a-f]{64}$")), "invalid_content_hash", "error",
                      "Fetched file content hash is not a SHA-256 hex digest.", "path")
    named = fetched.join(manifests.select("repo", "owner", "repo_name", "ref"), "repo")
    decoded = F.transform(
        F.filter(F.split(F.regexp_extract("raw_url", URL_PARTS, 3), "/"), lambda s: s != ""),
        lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s),
    )
    expected = F.concat(F.array("owner", "repo_name", "ref"), F.split("path", "/"))
    url_ok = (
        (F.lower(F.regexp_extract("raw_url", URL_PARTS, 1)) == "https")
        & (F.lower(F.regexp_extract("raw_url", URL_PARTS, 2)) == RAW_HOST) & (decoded == expected)
    )
    bad_url = _issue(named.where(~url_ok), "raw_url_mismatch", "error",
                     "Fetched file raw URL does not match the manifest source, ref, and path.", "path")
    out = repo_issues
    for part in [path_issues, bad_hash, bad_url]:
        out = out.unionByName(part)
    return out


def crawl_quality_reports(manifests: DataFrame, issues: DataFrame) -> DataFrame:
    """pass / warn / fail with counts for every crawl, including clean ones."""
    counts = issues.groupBy("repo").agg(
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
    )
    joined = manifests.select("repo").join(counts, "repo", "left").fillna(0, ["error_count", "warning_count"])
    status = F.when(F.col("error_count") > 0, "fail").when(F.col("warning_count") > 0, "warn").otherwise("pass")
    return joined.select("repo", status.alias("status"), "error_count", "warning_count")
