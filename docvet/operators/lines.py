"""Line tables and evidence spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.functions.ids import stable_id
from docvet.functions.text import compute_once, preview, split_lines


#: First lines of a pack of span requests.
REQUEST_LINES = 256


def explode_lines(artifacts: DataFrame, text: str = "raw_text") -> DataFrame:
    """One row per line with its 1-based number; the text column itself is not repeated."""
    keep = [c for c in artifacts.columns if c != text]
    return artifacts.select(*keep, F.posexplode(split_lines(F.col(text))).alias("line_pos", "line")).select(
        *keep, (F.col("line_pos") + 1).alias("line_no"), "line"
    )


def span_columns(artifact_id: Column, text: Column, start: Column, end: Column, span_type: Column, preview_chars: int = 160) -> dict[str, Column]:
    content_hash = F.sha2(text, 256)
    return {
        "span_id": stable_id("span", artifact_id, span_type, start, end, content_hash),
        "artifact_id": artifact_id,
        "start_line": start,
        "end_line": end,
        "preview": preview(text, preview_chars),
        "span_type": span_type,
        "content_hash": content_hash,
    }


def resolve_span_requests(artifacts: DataFrame, requests: DataFrame, preview_chars: int = 160) -> DataFrame:
    """Evidence spans for requested line ranges.

    ``requests(artifact_id, start_line, end_line, span_type)`` are packed by artifact and REQUEST_LINES of their first lines, so that an
    artifact with very many requests has many packs, and each pack joins the artifact: over a table bucketed by artifact only numbers
    move, and text is cut where it lies. Lines are found once a pack. Ranges past the last line are clipped, impossible
    ranges come back with an ``error`` and no span.
    """
    pack = F.floor(F.col("start_line") / REQUEST_LINES)
    packs = requests.groupBy("artifact_id", pack.alias("pack")).agg(F.collect_list(F.struct("start_line", "end_line", "span_type")).alias("requests"))
    joined = packs.join(artifacts.select("artifact_id", "raw_text"), "artifact_id")
    lines = compute_once(joined, line_array=split_lines(F.col("raw_text")))

    def cut(request: Column) -> Column:
        start, end = request["start_line"], request["end_line"]
        error = F.when(
            end < start, "Evidence span end_line must be greater than or equal to start_line."
        ).when(start > F.size("line_array"), "Evidence span start_line is outside the artifact text.")
        text = F.array_join(F.slice("line_array", F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")
        return F.struct(
            start.alias("start_line"), end.alias("end_line"), request["span_type"].alias("span_type"), error.alias("error"), F.when(error.isNull(), text).alias("span_text")
        )

    texts = lines.select("artifact_id", F.inline(F.transform("requests", cut)))
    spans = span_columns(F.col("artifact_id"), F.col("span_text"), F.col("start_line"), F.col("end_line"), F.col("span_type"), preview_chars)
    return texts.select(*[c.alias(n) for n, c in spans.items()], "error")
