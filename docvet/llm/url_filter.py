"""URL filter: host and path rules first, else a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks of eight 32-bit words. A URL's 64-bit hash picks its block with the upper half and one bit
in each word with the lower half, so that a probe touches one block. Blocks are broadcast to the pages while their bytes
stay within `broadcast_bytes`; beyond that the same join runs shuffled. Possible hits go to an exact hash join with the
list, which removes the false positives. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docvet.llm.common import stored

#: Odd multipliers below 2^31, one for each word of a block; products with 31 bits of a hash stay within a bigint.
SALTS = (1640531527, 1253254569, 1957894387, 1103515245, 1779033703, 1013904223, 1597334677, 1359893119)
#: Query parameters that don't change what a URL shows.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without default port, path without last slash, the other query parameters in order; null without a host."""
    host = F.regexp_replace(host_of(url), r":(80|443)?$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def by_rule(host: Column, path: Column, rules: Sequence[Rule], give: str) -> Column:
    """The `text` or `verdict` of the longest fitting rule, null if none fits; of two equally long ones a block comes first."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):  # the last one set is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, give))).otherwise(out)
    return out


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the block."""
    low = key.bitwiseAND(F.lit(0x7FFFFFFF))
    return [F.call_function("shiftleft", F.lit(1), F.shiftright(low * F.lit(s), 26).bitwiseAND(F.lit(31)).cast("int")) for s in SALTS]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 32), F.lit(blocks))


def build_bloom(listed: DataFrame, column: str, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """(block, w0..w7) of the distinct values of `column`, and the number of blocks."""
    blocks = max(1, -(-listed.count() * bits_per_key // 256))
    key = F.xxhash64(column)
    words = [F.expr(f"bit_or(w{k})").alias(f"w{k}") for k in range(len(SALTS))]
    rows = listed.select(_block(key, blocks).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(_bits(key))])
    return stored(rows.groupBy("block").agg(*words)), blocks


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), url_col: str = "url", listed_col: str = "url",
    keep: Sequence[str] = ("page_id",), bits_per_key: int = 16, broadcast_bytes: int = 32 << 20, max_rules: int = 500,
) -> DataFrame:
    """One row per row of `pages`: the `keep` columns, host, path, rule, canonical_url, maybe_listed, listed, verdict.

    `rules` are a policy of at most `max_rules` entries; the list may be of any length, repeat itself and hold nulls.
    A null or odd URL has an empty host and path, no canonical URL, and is allowed. Repeated pages are judged one by one.
    An empty list lists nothing. Columns of `pages` that aren't kept are not read, whatever their names.
    """
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; put single URLs into the list instead")
    spark = pages.sparkSession
    names = stored(listed.select(canonical(F.col(listed_col)).alias("canonical_url")).where("canonical_url IS NOT NULL").distinct())
    bloom, blocks = build_bloom(names, "canonical_url", bits_per_key)
    if blocks * 48 <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    url = F.col(url_col)
    key = F.xxhash64("canonical_url")
    parts = pages.select(
        *[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)], host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical_url")
    )
    set_all = F.lit(True)
    for k, bit in enumerate(_bits(key)):
        set_all = set_all & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    probed = (
        parts.withColumn("block", F.when(F.col("canonical_url").isNotNull(), _block(key, blocks)).otherwise(F.lit(-1)))
        .join(bloom, "block", "left").withColumn("maybe_listed", F.coalesce(F.col("w0").isNotNull() & set_all, F.lit(False)))
        .drop("block", *[f"w{k}" for k in range(len(SALTS))])
    )
    possible = probed.where("maybe_listed")
    exact = names.hint("shuffle_hash")
    judged = (
        probed.where("NOT maybe_listed").withColumn("listed", F.lit(False))
        .unionByName(possible.join(exact, "canonical_url", "left_semi").withColumn("listed", F.lit(True)))
        .unionByName(possible.join(exact, "canonical_url", "left_anti").withColumn("listed", F.lit(False)))
    )
    host, path = F.col("host"), F.col("path")
    return judged.select(
        *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)], "host", "path", by_rule(host, path, rules, "text").alias("rule"),
        "canonical_url", "maybe_listed", "listed",
        F.coalesce(by_rule(host, path, rules, "verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )
