"""Markdown elements as child tables, computed inside each artifact row.

Admission bounds an artifact to 1 MB, so its lines stay together as one array. Each line gets a
one-letter class; code regions are then found with one regular expression over the class string,
which is linear in the number of lines and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.functions.text import compute_once, is_blank, split_lines, strip

# The element patterns.
HEADING = r"(?U)^(#{1,6})\s+(.+?)\s*$"
FENCE = r"(?U)^(```|~~~)\s*([A-Za-z0-9_+.-]*)\s*$"
LINK = r"(?U)\[([^\]\n]+)\]\(([^)\s]+)\)"
ENV_VAR = r"(?U)(?:\$\{?|\bprocess\.env\.|\benv:)?\b([A-Z][A-Z0-9_]{2,})\b"
ENV_VAR_ENDINGS = "(?:KEY|TOKEN|SECRET|PASSWORD|URL|HOST)$"

# Line classes: ` and ~ fence lines, h heading, b blank, t text; inside code: o open, c code, x close.
_BLOCK_OR_REST = "`[^`]*(?:`|$)|~[^~]*(?:~|$)|[^`~]+"


def _line_class(line: Column) -> Column:
    """Plain prefix tests come first: most lines never reach a regular expression."""
    return (
        F.when(line.startswith("#") & line.rlike(HEADING), "h")
        .when(line.startswith("```") & line.rlike(FENCE), "`")
        .when(line.startswith("~~~") & line.rlike(FENCE), "~")
        .when(is_blank(line), "b").otherwise("t")
    )


def _links_in(line: Column, group: int) -> Column:
    return F.when(line.contains("]("), F.regexp_extract_all(line, F.lit(LINK), F.lit(group))).otherwise(_no_strings())


def _env_vars_in(line: Column) -> Column:
    names = F.filter(
        F.regexp_extract_all(line, F.lit(ENV_VAR), F.lit(1)), lambda n: n.contains("_") | n.rlike(ENV_VAR_ENDINGS)
    )
    return F.when(line.rlike("[A-Z][A-Z0-9_]{2}"), F.array_distinct(names)).otherwise(_no_strings())


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _mask_code(piece: Column) -> Column:
    """Rewrite one code region of the class string as o, c.., x (no x when it never closes)."""
    first = F.substring(piece, 1, 1)
    size = F.length(piece)
    closed = (size > 1) & (F.substring(piece, -1, 1) == first)
    inner = F.when(closed, size - 2).otherwise(size - 1)
    masked = F.concat(F.lit("o"), F.repeat(F.lit("c"), inner), F.when(closed, "x").otherwise(""))
    return F.when(first.isin("`", "~"), masked).otherwise(piece)


def with_line_classes(artifacts: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``lines`` and ``classes`` (one letter per line)."""
    lined = compute_once(artifacts, lines=split_lines(F.col(text)))
    raw = F.array_join(F.transform("lines", _line_class), "")
    pieces = F.regexp_extract_all(raw, F.lit(f"({_BLOCK_OR_REST})"), F.lit(1))
    masked = F.array_join(F.transform(pieces, _mask_code), "")
    return compute_once(lined, classes=F.filter(F.split(masked, ""), lambda c: c != ""))


def _numbered(classed: DataFrame, wanted: str) -> Column:
    return F.filter(
        F.transform("classes", lambda c, i: F.struct((i + 1).alias("line_no"), c.alias("cls"), F.get("lines", i).alias("line"))),
        lambda s: s["cls"].rlike(f"[{wanted}]"),
    )


def headings(classed: DataFrame, *keys: str) -> DataFrame:
    rows = classed.select(*keys, F.explode(_numbered(classed, "h")).alias("h"))
    line = F.col("h.line")
    return rows.select(
        *keys, F.length(F.regexp_extract(line, HEADING, 1)).alias("level"),
        strip(F.regexp_extract(line, HEADING, 2)).alias("text"),
        F.col("h.line_no").alias("start_line"), F.col("h.line_no").alias("end_line"),
    )


def _edges(test_here, test_neighbour, step: int) -> Column:
    """1-based positions whose class passes while the neighbour's does not (or is missing)."""
    return F.filter(
        F.transform(
            "classes",
            lambda c, i: F.when(
                test_here(c) & ~F.coalesce(test_neighbour(F.get("classes", i + step)), F.lit(False)), i + 1
            ),
        ),
        lambda p: p.isNotNull(),
    )


def code_blocks(classed: DataFrame, *keys: str) -> DataFrame:
    opens = F.filter(F.transform("classes", lambda c, i: F.when(c == "o", i + 1)), lambda p: p.isNotNull())
    closes = F.filter(F.transform("classes", lambda c, i: F.when(c == "x", i + 1)), lambda p: p.isNotNull())
    # Only the last block can stay open, so the n-th close belongs to the n-th open.
    blocks = compute_once(classed.select(*keys, "lines", "classes"), opens=opens, closes=closes)
    block = F.transform(
        "opens",
        lambda start, i: F.struct(
            start.alias("start_line"),
            F.coalesce(F.get("closes", i), F.size("lines")).alias("end_line"),
            F.get("closes", i).isNotNull().alias("closed"),
        ),
    )
    texts = F.transform(
        block,
        lambda b: F.struct(
            b["start_line"].alias("start_line"), b["end_line"].alias("end_line"),
            F.nullif(F.regexp_extract(F.get("lines", b["start_line"] - 1), FENCE, 2), F.lit("")).alias("language"),
            F.array_join(
                F.slice("lines", b["start_line"] + 1, b["end_line"] - b["start_line"] - b["closed"].cast("int")), "\n"
            ).alias("text"),
        ),
    )
    return blocks.select(*keys, F.inline(texts))


def paragraphs(classed: DataFrame, *keys: str) -> DataFrame:
    def text(c: Column) -> Column:
        return c == "t"

    bounds = compute_once(
        classed.select(*keys, "lines", "classes"), starts=_edges(text, text, -1), ends=_edges(text, text, 1)
    )
    rows = F.transform(
        F.arrays_zip("starts", "ends"),
        lambda p: F.struct(
            p["starts"].alias("start_line"), p["ends"].alias("end_line"),
            F.array_join(F.transform(F.slice("lines", p["starts"], p["ends"] - p["starts"] + 1), strip), " ").alias("text"),
        ),
    )
    return bounds.select(*keys, F.inline(rows))


def _inline_lines(classed: DataFrame, *keys: str) -> DataFrame:
    """Lines that may carry links and variables: everything but blank lines outside code."""
    return classed.select(*keys, F.explode(_numbered(classed, "htocx")).alias("l")).select(*keys, "l.line_no", "l.line")


def links(classed: DataFrame, *keys: str) -> DataFrame:
    rows = _inline_lines(classed, *keys).where(F.col("line").contains("]("))
    found = F.arrays_zip(_links_in(F.col("line"), 1).alias("label"), _links_in(F.col("line"), 2).alias("url"))
    return rows.select(
        *keys, F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.posexplode(found).alias("pos", "f")
    ).select(*keys, "f.label", "f.url", "start_line", "end_line", "pos")


def env_vars(classed: DataFrame, *keys: str) -> DataFrame:
    return _inline_lines(classed, *keys).select(
        *keys, F.explode(_env_vars_in(F.col("line"))).alias("name"),
        F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"),
    )


def element_counts(classed: DataFrame, *keys: str) -> DataFrame:
    """Number of headings, paragraphs, code blocks, links and variables of each artifact.

    Counted inside the row: no child table has to be joined back.
    """
    def text(c: Column) -> Column:
        return c == "t"

    inline = F.transform(
        F.filter(F.arrays_zip("classes", "lines"), lambda p: p["classes"] != "b"), lambda p: p["lines"]
    )
    link_count = F.aggregate(inline, F.lit(0), lambda n, line: n + F.size(_links_in(line, 1)))
    env_count = F.aggregate(inline, F.lit(0), lambda n, line: n + F.size(_env_vars_in(line)))
    return classed.select(
        *keys,
        F.size(F.filter("classes", lambda c: c == "h")).alias("heading_count"),
        F.size(_edges(text, text, -1)).alias("paragraph_count"),
        F.size(F.filter("classes", lambda c: c == "o")).alias("code_block_count"),
        link_count.alias("link_count"), env_count.alias("env_var_count"),
    )
