"""Tool-schema extraction from JSON and YAML text with the VARIANT type."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docvet.functions.text import compute_once

# Where parameter schemas live and which keys are not parameters.
SCHEMA_KEYS = ("parameters", "input_schema", "inputSchema", "schema")
RESERVED_KEYS = ("type", "required", "description", "title", "examples", "example")
URL = r"""(?U)(https?://[^\s"'<>),\]]+)"""
# Quoted strings of JSON text; keys are the ones matched together with their colon.
JSON_STRING = r'("(?:[^"\\]|\\.)*+"(?:\s*:)?)'


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())]))
def yaml_to_json(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """YAML text -> JSON text, Arrow batches; Spark has no YAML reader."""
    import json

    import yaml

    def convert(text: str) -> tuple[str | None, str | None]:
        try:
            return json.dumps(yaml.safe_load(text or ""), default=str, allow_nan=False), None
        except Exception as problem:  # noqa: BLE001  a bad date, key or number is a bad schema, not a failed job
            return None, f"Invalid YAML schema: {problem}"

    for batch in texts:
        yield pd.DataFrame([convert(t) for t in batch], columns=["json", "error"])


def _object(value: Column) -> Column:
    """The value as a map, null if it is not an object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _has_identity(entries: Column) -> Column:
    return (F.map_contains_key(entries, "name") | F.map_contains_key(entries, "tool_name")) & F.map_contains_key(entries, "description")


def urls_in(value: Column) -> Column:
    """Sorted distinct URLs of all string values (not keys) below a variant."""
    strings = F.filter(
        F.regexp_extract_all(F.to_json(value), F.lit(JSON_STRING), F.lit(1)), lambda s: s.endswith('"')
    )

    def read(literal: Column) -> Column:
        """The string that a literal stands for, with all its escapes read."""
        return F.coalesce(F.try_variant_get(F.try_parse_json(literal), "$", "string"), F.lit(""))

    found = F.flatten(F.transform(strings, lambda s: F.regexp_extract_all(read(s), F.lit(URL), F.lit(1))))
    return F.array_sort(F.array_distinct(F.transform(found, lambda u: F.rtrim(u, F.lit(".,;:")))))


def parse_schema_texts(schemas: DataFrame, *keys: str) -> DataFrame:
    """Parse ``schema_text`` by ``schema_format``: variant ``doc``, ``urls`` and ``parse_error``.

    Only YAML rows pass through Python; JSON rows stay in the JVM.
    """
    is_yaml = F.col("schema_format") == "yaml"
    json_rows = schemas.where(~is_yaml).select(
        *keys, F.col("schema_text").alias("json"), F.lit("Invalid JSON schema").alias("on_error"), "schema_format"
    )
    yaml_rows = schemas.where(is_yaml).withColumn("y", yaml_to_json("schema_text")).select(
        *keys, F.col("y.json").alias("json"), F.col("y.error").alias("on_error"), "schema_format"
    )
    both = compute_once(json_rows.unionByName(yaml_rows), doc=F.try_parse_json("json"))
    failed = F.col("doc").isNull()
    return both.select(
        *keys, "schema_format", "doc",
        F.when(failed, F.array().cast("array<string>")).otherwise(urls_in(F.col("doc"))).alias("urls"),
        F.when(failed, F.col("on_error")).alias("parse_error"),
    )


def tool_candidates(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per candidate tool object, in document order."""
    top = compute_once(parsed.where(F.col("doc").isNotNull()), obj=_object(F.col("doc")), arr=_array(F.col("doc")))
    objects_only = lambda values: F.filter(values, lambda v: _object(v).isNotNull())
    none = F.array().cast("array<variant>")
    member = lambda key: F.try_variant_get("doc", f"$.{key}", "variant")
    function = member("function")
    listed = [F.coalesce(objects_only(_array(member(k))), none) for k in ("tools", "functions")]
    tool = F.when(_object(member("tool")).isNotNull(), F.array(member("tool"))).otherwise(none)
    itself = F.when(_has_identity(F.col("obj")), F.array("doc")).otherwise(none)
    candidates = (
        F.when(F.col("arr").isNotNull(), objects_only(F.col("arr")))
        .when(F.col("obj").isNull(), none)
        .when(F.coalesce(_has_identity(_object(function)), F.lit(False)), F.array(function))
        .otherwise(F.concat(*listed, tool, itself))
    )
    return top.select(*keys, F.posexplode(candidates).alias("tool_pos", "tool"))


def _string_at(value: Column, key: str) -> Column:
    """Text of a member; objects and arrays come back as JSON text."""
    raw = F.try_variant_get(value, f"$.{key}", "string")
    return F.coalesce(raw, F.to_json(F.try_variant_get(value, f"$.{key}", "variant")))


def _parameter_schema(value: Column) -> Column:
    found = [F.try_variant_get(value, f"$.{k}", "map<string,variant>") for k in SCHEMA_KEYS]
    return F.coalesce(*found)


def _required(schema: Column, tool: Column) -> Column:
    own = F.try_variant_get(F.try_element_at(schema, F.lit("required")), "$", "array<string>")
    outer = F.try_variant_get(tool, "$.required", "array<string>")
    chosen = F.when(schema.isNotNull() & (F.size(schema) > 0), own).otherwise(outer)
    return F.coalesce(chosen, F.array().cast("array<string>"))


def tools(candidates: DataFrame, *keys: str) -> DataFrame:
    """Name, description, required fields, examples and URLs of every tool."""
    tool = F.col("tool")
    named = F.coalesce(
        F.nullif(_string_at(tool, "name"), F.lit("")), F.nullif(_string_at(tool, "tool_name"), F.lit("")), F.lit("unknown_tool")
    )
    example_list = F.try_variant_get(tool, "$.examples", "array<variant>")
    has = lambda key: F.map_contains_key(_object(tool), key)
    examples = (
        F.when(example_list.isNotNull(), F.transform(example_list, lambda e: F.to_json(e)))
        .when(has("examples"), F.array(F.to_json(F.try_variant_get(tool, "$.examples", "variant"))))
        .when(has("example"), F.array(F.to_json(F.try_variant_get(tool, "$.example", "variant"))))
        .otherwise(F.array().cast("array<string>"))
    )
    return candidates.select(
        *keys, "tool_pos", named.alias("name"), _string_at(tool, "description").alias("description"),
        _required(_parameter_schema(tool), tool).alias("required_fields"),
        examples.alias("examples"), urls_in(tool).alias("urls"),
    )


def tool_parameters(candidates: DataFrame, *keys: str) -> DataFrame:
    """One row per parameter: members of ``properties`` if present, else the schema's own members."""
    tool = F.col("tool")
    split = compute_once(candidates, schema=_parameter_schema(tool))
    properties = F.try_variant_get(F.try_element_at("schema", F.lit("properties")), "$", "map<string,variant>")
    own = F.map_filter("schema", lambda k, v: ~k.isin(*RESERVED_KEYS))
    entries = compute_once(
        split, in_properties=properties.isNotNull(), required=_required(F.col("schema"), tool),
        members=F.coalesce(properties, own),
    )
    rows = entries.select(*keys, "tool_pos", "in_properties", "required", F.explode("members").alias("name", "value"))
    is_object = _object(F.col("value")).isNotNull()
    raw = F.to_json("value")
    wrapped = F.when(F.col("in_properties"), F.lit("{}")).otherwise(F.concat(F.lit('{"value":'), raw, F.lit("}")))
    return rows.select(
        *keys, "tool_pos", "name",
        F.when(is_object, _string_at(F.col("value"), "description")).alias("description"),
        F.array_contains("required", F.col("name")).alias("required"),
        F.when(is_object, raw).otherwise(wrapped).alias("raw_schema"),
    )


def artifact_type(extension: Column) -> Column:
    """markdown, json, yaml, the bare extension, or text."""
    return (
        F.when(extension.isin(".md", ".markdown"), "markdown").when(extension == ".json", "json")
        .when(extension.isin(".yaml", ".yml"), "yaml")
        .otherwise(F.coalesce(F.nullif(F.ltrim(extension, F.lit(".")), F.lit("")), F.lit("text")))
    )
