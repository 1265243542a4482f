"""Text expressions shared by the operators. All are built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line separators and whitespace characters of Python strings.
LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
RARE_BREAK = "[\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = f"[{WHITESPACE_CHARS}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so later stages cannot inline and re-evaluate them."""
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(packed))


def split_lines(text: Column) -> Column:
    """Array of lines; a trailing separator adds no empty last line, '' has no lines."""
    # Newline-only text, the usual case, takes the literal split.
    pieces = F.when(text.rlike(RARE_BREAK), F.split(text, LINE_BREAK, -1)).otherwise(F.split(text, "\n", -1))
    return let(
        pieces,
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def collapse_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, WHITESPACE_RUN, " "))


def preview(text: Column, max_chars: int = 160) -> Column:
    """Whitespace-collapsed text, clipped to ``max_chars`` and cut back to a whole word."""
    if max_chars < 1:
        raise ValueError("preview length must be at least 1.")

    def cut_to_word(clipped: Column) -> Column:
        from_end = F.instr(F.reverse(clipped), " ")
        last_space = F.length(clipped) - from_end
        return F.when(
            (from_end > 0) & (last_space > 0), F.substring(clipped, F.lit(1), last_space)
        ).otherwise(clipped)

    return let(
        collapse_whitespace(text),
        lambda flat: F.when(F.length(flat) <= max_chars, flat).otherwise(
            let(F.rtrim(F.substring(flat, 1, max_chars)), cut_to_word)
        ),
    )


def snippet(text: Column, terms: Column, max_chars: int = 240) -> Column:
    """Window of ``max_chars`` around the first matched term, with dots on cut sides."""

    def window(flat: Column) -> Column:
        length = F.length(flat)
        hits = F.filter(
            F.transform(terms, lambda t: F.instr(F.lower(flat), t) - 1), lambda p: p >= 0
        )
        anchor = F.coalesce(F.array_min(hits), F.lit(0))
        head = F.greatest(anchor - max_chars // 3, F.lit(0))
        end = F.least(head + max_chars, length)
        start = F.greatest(end - max_chars, F.lit(0))
        body = strip(F.substring(flat, start + 1, end - start))
        cut = F.concat(
            F.when(start > 0, "...").otherwise(""), body, F.when(end < length, "...").otherwise("")
        )
        return F.when(length <= max_chars, flat).otherwise(cut)

    return let(collapse_whitespace(text), window)


def prefix_snippet(text: Column, max_chars: int = 240) -> Column:
    return let(
        collapse_whitespace(text),
        lambda flat: F.when(F.length(flat) <= max_chars, flat).otherwise(
            F.concat(strip(F.substring(flat, 1, max_chars)), F.lit("..."))
        ),
    )


def plain_tokens(text: Column) -> Column:
    """Lower-case ASCII word tokens; underscore and hyphen separate words."""
    return F.regexp_extract_all(F.translate(F.lower(text), "_-", "  "), F.lit("([a-z0-9]+)"), F.lit(1))


def stem(token: Column) -> Column:
    size = F.length(token)
    plural_y = (size > 4) & token.endswith("ies")
    plural_s = (size > 3) & token.endswith("s") & ~token.rlike("(?:ss|us|is)$")
    return (
        F.when(plural_y, F.concat(F.substring(token, F.lit(1), size - 3), F.lit("y")))
        .when(plural_s, F.substring(token, F.lit(1), size - 1))
        .otherwise(token)
    )


def stemmed_tokens(text: Column) -> Column:
    return F.transform(plain_tokens(text), stem)


def contains_any(text: Column, markers: Sequence[str]) -> Column:
    """Case-insensitive containment of any marker; null text contains none."""
    listed = F.array(*[F.lit(m) for m in markers])
    return let(
        F.lower(F.coalesce(text, F.lit(""))), lambda lowered: F.exists(listed, lambda m: F.contains(lowered, m))
    )


def lowered_contains_any(lowered: Column, markers: Sequence[str]) -> Column:
    """The same test for text that is already a lower-case column: plain generated code."""
    found = F.lit(False)
    for marker in markers:
        found = found | lowered.contains(marker)
    return found


def json_value_text(value: Column) -> Column:
    """Flatten a JSON-encoded nested value to its words; plain strings stay as they are."""
    return F.when(value.rlike(r"^\s*[\[{]"), F.regexp_replace(value, r'[\[\]{}":,]+', " ")).otherwise(value)


def map_text(values: Column) -> Column:
    """Keys and values of a string map joined by spaces; null values are skipped."""
    words = F.transform(
        F.map_entries(values), lambda e: F.concat_ws(" ", e["key"], json_value_text(e["value"]))
    )
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def markdown_number(value: Column) -> Column:
    return F.format_string("%.2f", value)
