"""Heading-aware chunks with size-bounded splits, computed inside each artifact row.

No shuffle: sections, paths, split points and texts all come from the line array of the row, and
only finished chunks are exploded. The two scans over a row that no array function can do in linear
time, enclosing headings and greedy splits, are Arrow functions that see numbers only, never text.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docvet.functions.ids import canonical_hash, stable_id
from docvet.functions.text import compute_once, is_blank, split_lines, strip
from docvet.operators.markdown import HEADING

# Chunk limits and the word pattern.
MAX_CHUNK_CHARS = 1_200
MAX_CHUNK_LINES = 80
WORD = r"(?U)(\w+(?:[-']\w+)*)"

_PLACES = T.ArrayType(T.ArrayType(T.IntegerType()))


def _heading_marks() -> Column:
    """Heading lines with level and text; code fences are not looked at here."""
    marks = F.transform(
        "lines",
        lambda line, i: F.when(
            line.startswith("#") & line.rlike(HEADING),
            F.struct(
                (i + 1).cast("int").alias("line_no"),
                F.length(F.regexp_extract(line, HEADING, 1)).alias("level"),
                strip(F.regexp_extract(line, HEADING, 2)).alias("text"),
            ),
        ),
    )
    return F.filter(marks, lambda m: m.isNotNull())


@F.pandas_udf(_PLACES)
def _enclosing(levels: pd.Series) -> pd.Series:
    """Places of the headings that enclose each heading, outermost first, itself last: at most one of each level."""

    def chains(row) -> list[list[int]] | None:
        if row is None:
            return None
        open_, out = [], []
        for place, level in enumerate(row.tolist()):
            open_ = [k for k in open_ if row[k] < level] + [place]
            out.append(open_)
        return out

    return levels.map(chains, na_action=None)


def _heading_paths() -> Column:
    return F.transform("chains", lambda chain: F.transform(chain, lambda k: F.get("marks", k)["text"]))


def _bound(start: Column, end: Column, kind: str, mark: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"),
        F.lit(kind).alias("chunk_type"), mark.cast("int").alias("mark"),
    )


def _heading_bounds() -> Column:
    bounds = F.transform(
        "marks",
        lambda m, i: _bound(m["line_no"], F.coalesce(F.get("marks", i + 1)["line_no"] - 1, F.size("lines")), "markdown_section", i),
    )
    first = F.get("marks", F.lit(0))["line_no"]
    preamble = F.slice("lines", F.lit(1), F.greatest(first - 1, F.lit(0)))
    has_preamble = F.exists(preamble, lambda line: ~is_blank(line))
    none = F.array().cast("array<struct<start:int,end:int,chunk_type:string,mark:int>>")
    return F.concat(
        F.when(has_preamble, F.array(_bound(F.lit(1), first - 1, "text_window", F.lit(None)))).otherwise(none), bounds
    )


def _paragraph_bounds() -> Column:
    def edges(step: int) -> Column:
        return F.filter(
            F.transform("filled", lambda here, i: F.when(here & ~F.coalesce(F.get("filled", i + step), F.lit(False)), i + 1)),
            lambda p: p.isNotNull(),
        )

    return F.transform(
        F.arrays_zip(edges(-1).alias("s"), edges(1).alias("e")),
        lambda p: _bound(p["s"], p["e"], "paragraph", F.lit(None)),
    )


def _section(bound: Column) -> Column:
    return F.struct(
        bound["start"].alias("start"), bound["end"].alias("end"), bound["chunk_type"].alias("chunk_type"),
        F.coalesce(F.get("paths", bound["mark"]), F.array().cast("array<string>")).alias("heading_path"),
    )


def sections(artifacts: DataFrame, text: str = "raw_text", **more: Column) -> DataFrame:
    """Add ``lines`` and ``sections`` (heading sections, else paragraphs) to each artifact.

    ``more`` columns may read ``lines`` and ``bounds`` (start, end of each section); Arrow functions among them share the task's one
    worker for the headings.
    """
    lined = compute_once(artifacts, lines=split_lines(F.col(text))).drop(text)
    marked = compute_once(lined, marks=_heading_marks(), filled=F.transform("lines", lambda x: ~is_blank(x)))
    bounded = compute_once(marked, bounds=F.when(F.size("marks") > 0, _heading_bounds()).otherwise(_paragraph_bounds()))
    chained = compute_once(bounded, chains=_enclosing(F.transform("marks", lambda m: m["level"])), **more)
    pathed = compute_once(chained, paths=_heading_paths())
    return compute_once(pathed, sections=F.transform("bounds", _section)).drop("marks", "filled", "bounds", "chains", "paths")


def _split_points(max_chars: int, max_lines: int):
    """(line lengths, first lines, last lines of the sections) -> first lines of each section's chunks.

    A chunk takes lines while it has fewer than ``max_lines`` and stays within ``max_chars`` with its line breaks, and at
    least one. Running sums of the lengths give the next break of any line by one search.
    """

    @F.pandas_udf(_PLACES)
    def points(lengths: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
        def of(row, starts, ends) -> list[list[int]] | None:
            if row is None or starts is None:
                return None
            sums = list(accumulate((n + 1 for n in row.tolist()), initial=0))
            out = []
            for first, last in zip(starts.tolist(), ends.tolist()):
                at, breaks = first - 1, []
                while at < last:
                    breaks.append(at + 1)
                    over = bisect_right(sums, sums[at] + max_chars + 1, at + 1) - 1
                    at = min(max(over, at + 1), at + max_lines)
                out.append(breaks or [first])
            return out

        return pd.Series([of(*x) for x in zip(lengths, firsts, lasts)])

    return points


def chunk_artifacts(
    artifacts: DataFrame, max_chunk_chars: int = MAX_CHUNK_CHARS, max_chunk_lines: int = MAX_CHUNK_LINES
) -> DataFrame:
    """Chunks of ``artifacts(artifact_id, path, raw_text)``."""
    if max_chunk_chars < 1 or max_chunk_lines < 1:
        raise ValueError("chunk limits must be at least 1.")
    starts = _split_points(max_chunk_chars, max_chunk_lines)(
        F.transform("lines", lambda line: F.length(line)), F.transform("bounds", lambda b: b["start"]), F.transform("bounds", lambda b: b["end"])
    )
    points = compute_once(
        sections(artifacts.select("artifact_id", "path", "raw_text"), starts=starts),
        split_sections=F.transform("sections", lambda s, i: F.struct(s.alias("s"), F.get("starts", i).alias("starts"))),
    )

    def ranges(item: Column) -> Column:
        return F.transform(
            item["starts"],
            lambda start, i: F.struct(
                start.alias("start_line"),
                F.coalesce(F.get(item["starts"], i + 1) - 1, item["s"]["end"]).alias("end_line"),
                item["s"]["chunk_type"].alias("chunk_type"), item["s"]["heading_path"].alias("heading_path"),
                strip(F.array_join(
                    F.slice("lines", start, F.coalesce(F.get(item["starts"], i + 1), item["s"]["end"] + 1) - start), "\n"
                )).alias("text"),
            ),
        )

    rows = points.select(
        "artifact_id", "path", F.posexplode(F.flatten(F.transform("split_sections", ranges))).alias("chunk_index", "c")
    ).select("artifact_id", "path", "chunk_index", "c.*")
    hashed = compute_once(rows, content_hash=F.sha2("text", 256))
    chunk_id = stable_id("chunk", *[F.col(c) for c in ("artifact_id", "chunk_index", "start_line", "end_line", "content_hash")])
    return hashed.select(
        chunk_id.alias("chunk_id"), "artifact_id", "path", "chunk_index", "start_line", "end_line",
        "chunk_type", "heading_path", "text", "content_hash",
    )


METADATA_FIELDS = (
    "chunk_id", "artifact_id", "path", "chunk_index", "start_line", "end_line", "line_count", "chunk_type",
    "heading_path", "heading_depth", "has_heading_context", "char_count", "word_count", "content_hash",
)


def with_metadata(chunks: DataFrame) -> DataFrame:
    """Counts of each chunk, and the hash of its keys and counts, beside the columns it has."""
    counted = chunks.select(
        "*",
        (F.col("end_line") - F.col("start_line") + 1).alias("line_count"),
        F.size("heading_path").alias("heading_depth"),
        (F.size("heading_path") > 0).alias("has_heading_context"),
        F.length("text").alias("char_count"),
        F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(1))).alias("word_count"),
    )
    return counted.withColumn("metadata_hash", canonical_hash(*METADATA_FIELDS))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Counts and hash per chunk; the text itself is left out."""
    return with_metadata(chunks).select(*METADATA_FIELDS, "metadata_hash")
