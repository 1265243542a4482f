"""Structured Streaming jobs that reuse the batch operators on live logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.operators.actions import decide, label_actions

WATERMARK = "10 minutes"
#: Relative error of a quantile; a bucket holds the values between two powers of the base.
QUANTILE_ERROR = 0.01
_BASE = (1 + QUANTILE_ERROR) / (1 - QUANTILE_ERROR)
#: Bucket of values that are not positive, which count as 0.
_ZERO = -(1 << 31)


def request_rollup(requests: DataFrame, window: str = "1 hour", with_p95: bool = False) -> DataFrame:
    """Count, error rate and latency per tumbling window and service.

    The same function serves batch and streams. State is a few numbers per (window, service); late rows beyond the
    watermark are dropped. With ``with_p95`` the rows come from latency sketches: two aggregations, so on a stream in append mode.
    """
    if with_p95:
        return merged_rollup(latency_sketches(requests, window), window)
    grouped = _watermarked(requests).groupBy(F.window("ts", window).alias("w"), "service").agg(
        F.count("*").alias("request_count"), F.count_if(F.col("status") == "error").alias("error_count"),
        F.sum("latency_ms").alias("latency_sum"),
    )
    return grouped.select(F.col("w.start").alias("window_start"), "service", "request_count", "error_count", *_rates())


def _watermarked(requests: DataFrame) -> DataFrame:
    return requests.withWatermark("ts", WATERMARK) if requests.isStreaming else requests


def _rates() -> list:
    return [(F.col("error_count") / F.col("request_count")).alias("error_rate"), (F.col("latency_sum") / F.col("request_count")).alias("mean_latency_ms")]


def latency_sketches(requests: DataFrame, window: str = "1 hour") -> DataFrame:
    """(window, service, bucket, requests, errors, latency_sum): a mergeable sketch of each window's latencies, a row for each bucket.

    Buckets grow by a fixed factor, so that a window has a few hundred however many requests it has, and sketches of
    any windows, services or batches merge by adding up their rows. Null latencies have the null bucket.
    """
    value = F.col("latency_ms")
    bucket = F.when(value > 0, F.ceil(F.log(value) / math.log(_BASE)).cast("int")).when(value.isNotNull(), F.lit(_ZERO))
    return _watermarked(requests).groupBy(F.window("ts", window), "service", bucket.alias("bucket")).agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("latency_ms").alias("latency_sum"),
    )


def quantile(buckets: Column, q: float) -> Column:
    """The value at rank ceil(q n) of sorted (bucket, n) pairs, within QUANTILE_ERROR of it; null without pairs."""
    total = F.aggregate(buckets, F.lit(0).cast("bigint"), lambda acc, b: acc + b["n"])
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("bucket"))

    def step(acc: Column, b: Column) -> Column:
        here = acc["bucket"].isNull() & (acc["seen"] + b["n"] >= F.ceil(total * F.lit(q)))
        return F.struct((acc["seen"] + b["n"]).alias("seen"), F.when(here, b["bucket"]).otherwise(acc["bucket"]).alias("bucket"))

    found = F.aggregate(buckets, start, step, lambda acc: acc["bucket"])
    return F.when(found == _ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(_BASE), found) * (2 / (_BASE + 1)))


def merged_rollup(sketches: DataFrame, window: str = "1 hour") -> DataFrame:
    """The rollup with p95 over windows as long as the sketches' or longer, from their rows alone."""
    rows = sketches
    if not sketches.isStreaming:
        rows = sketches.groupBy(F.window(F.col("window.start"), window), "service", "bucket").agg(*[F.sum(c).alias(c) for c in ("requests", "errors", "latency_sum")])
    grouped = rows.groupBy("window", "service").agg(
        F.sum("requests").alias("request_count"), F.sum("errors").alias("error_count"), F.sum("latency_sum").alias("latency_sum"),
        # bounded by the number of buckets
        F.array_sort(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", F.col("requests").alias("n"))))).alias("buckets"),
    )
    return grouped.select(F.col("window.start").alias("window_start"), "service", "request_count", "error_count", *_rates(), quantile(F.col("buckets"), 0.95).alias("p95_latency_ms"))


def tool_call_firewall(actions: DataFrame, mode: str = "guarded") -> DataFrame:
    """Label and decide each action; stateless, so it runs in append mode on a live stream."""
    return decide(label_actions(actions), mode)


def first_findings(findings: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Each finding id once within the horizon, however often it is scanned again.

    ``findings(finding_id, found_at, ...)``. State is bounded by the horizon.
    """
    if findings.isStreaming:
        return findings.withWatermark("found_at", horizon).dropDuplicatesWithinWatermark(["finding_id"])
    return findings.dropDuplicates(["finding_id"])
