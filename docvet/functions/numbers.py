"""Number coercions and guarded rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def half_even_points(weight: Column, confidence: Column) -> Column:
    return F.bround(weight * clamp01(confidence), 0).cast("int")


def json_number(value: Column) -> Column:
    """Number held in a metadata value: booleans count 1/0, numeric text parses, else null."""
    text = F.lower(F.trim(value))
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(value.try_cast("double"))


def json_change_count(value: Column) -> Column:
    """How many changes a metadata value stands for: number, flag, list or object size, or text.

    Numbers are cut towards zero and never negative; those that are not finite, or beyond a bigint, count as text.
    """
    text = F.trim(value)
    number = value.try_cast("double")
    return (
        F.when(F.lower(text) == "true", 1)
        .when(F.lower(text) == "false", 0)
        .when(number.between(-(2.0**63), 2.0**63 - 1024), F.greatest(F.lit(0), number.try_cast("bigint")))
        .when(text.startswith("["), F.coalesce(F.json_array_length(text), F.lit(1)))
        .when(text.startswith("{"), F.coalesce(F.size(F.json_object_keys(text)), F.lit(1)))
        .when(text == "", 0)
        .when(text.isNull(), 0)
        .otherwise(1)
        .cast("bigint")
    )
