"""Rule scan: artifacts -> findings with cited one-line evidence spans.

Rules are literals in the plan, so each pattern compiles once per task and the scan is a narrow
stage: split, test, keep matching lines. Nothing is shuffled and no rule table is joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.functions.ids import stable_id
from docvet.functions.rules import DEFAULT_RULES, Rule
from docvet.functions.text import compute_once, lowered_contains_any
from docvet.operators.lines import explode_lines, span_columns

# Unicode case folding and word boundaries match the rule semantics but are slow; on ASCII text the
# plain flag finds the same matches.
FLAGS = "(?iU)"
ASCII_FLAGS = "(?i)"
_ANCHORS = ("^", "$", r"\A", r"\Z", r"\z", r"\G", "(?")


# Characters other than a-z and A-Z that a case-insensitive pattern takes for one of a-z.
_FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")


def _fold(text: Column) -> Column:
    """Lower case as patterns see it."""
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, *_FOLDED)))


def _holds_words(folded: Column, rule: Rule) -> Column:
    return reduce(and_, (lowered_contains_any(folded, group) for group in rule.words))


def _may_match(text: Column, folded: Column, rules: Sequence[Rule]) -> Column:
    """Cheap whole-text test that never misses a line match; rules with anchors are not tested, unless their words are known."""
    if not rules or any(mark in rule.pattern for rule in rules if not rule.words for mark in _ANCHORS):
        return F.lit(True)
    # One expression after another beats one big alternation, which loses the literal search.
    return reduce(or_, (_holds_words(folded, rule) if rule.words else _matches(text, rule.pattern) for rule in rules))


def _matches(text: Column, pattern: str) -> Column:
    is_ascii = F.octet_length(text) == F.length(text)
    return F.when(is_ascii, text.rlike(ASCII_FLAGS + pattern)).otherwise(text.rlike(FLAGS + pattern))


def _rule_value(rules: Sequence[Rule], field: str) -> Column:
    return F.element_at(F.array(*[F.lit(getattr(r, field)) for r in rules]), F.col("rule_rank") + 1)


def scan_rules(
    artifacts: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    text: str = "raw_text",
    preview_chars: int = 160,
) -> DataFrame:
    """At most one finding per (line, rule). Extra artifact columns are carried along."""
    keep = [c for c in artifacts.columns if c != text]
    folded = compute_once(artifacts, folded=_fold(F.col(text)))
    candidates = folded.where(_may_match(F.col(text), F.col("folded"), rules)).drop("folded")

    def test(rule: Rule) -> Column:
        matches = _matches(F.col("line"), rule.pattern)
        return _holds_words(F.col("folded"), rule) & matches if rule.words else matches

    tests = [F.when(test(r), F.lit(i)) for i, r in enumerate(rules)]
    hits = (
        compute_once(explode_lines(candidates, text), folded=_fold(F.col("line")))
        .select("*", F.explode(F.array_compact(F.array(*tests))).alias("rule_rank")).drop("folded")
    )
    fields = ("rule_id", "detector", "category", "severity", "confidence", "rationale", "recommendation")
    named = hits.select("*", *[_rule_value(rules, f).alias(f) for f in fields])
    span = span_columns(
        F.col("artifact_id"), F.col("line"), F.col("line_no"), F.col("line_no"), F.col("category"), preview_chars
    )
    span.pop("artifact_id")
    spans = compute_once(named, **span).drop("line", "line_no")
    finding_id = stable_id("finding", F.col("artifact_id"), F.col("rule_id"), F.col("span_id"))
    ordered = [c for c in keep if c != "artifact_id"]
    return spans.select(
        finding_id.alias("finding_id"), "artifact_id", *fields, "span_id", "start_line", "end_line",
        "preview", "span_type", "content_hash", "rule_rank", *ordered,
    )
