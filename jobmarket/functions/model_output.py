"""Untrusted model responses: JSON found in prose, coerced into typed columns, never failing a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_object(raw: Column) -> Column:
    """A VARIANT object from a response that may be fenced or wrapped in prose; null if there is none."""
    text = F.trim(raw)
    bare = F.when(F.startswith(text, F.lit("```")), F.trim(F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n?\s*```[^\n]*$", ""))).otherwise(text)
    whole, inner = F.try_parse_json(bare), F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")))
    found = F.coalesce(whole, inner)
    return F.when(F.startswith(F.schema_of_variant(found), F.lit("OBJECT")), found)


def score(v: Column) -> Column:
    """A score 0 to 100 from a VARIANT: a number is truncated, a text gives its first integer, the rest is 0."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    value = (
        F.when(v.isNull() | (kind == "BOOLEAN"), F.lit(0.0))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("double"))
        .otherwise(F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), r"(-?\d+)", 1).try_cast("double"), F.lit(0.0)))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(value, F.lit(0.0)))).cast("int")


def string_list(v: Column) -> Column:
    """A list of texts from a VARIANT: a text is one item, nested values and nulls are skipped, scalars become text."""
    kind = F.schema_of_variant(v)
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    scalar = F.filter(items, lambda x: x.isNotNull() & ~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|VOID)"))
    text = lambda x: F.trim(F.when(F.schema_of_variant(x) == "BOOLEAN", F.initcap(F.try_variant_get(x, "$", "string"))).otherwise(F.try_variant_get(x, "$", "string")))
    listed = F.filter(F.transform(scalar, text), lambda t: t != "")
    single = F.trim(F.try_variant_get(v, "$", "string"))
    empty = F.array().cast("array<string>")
    return F.when(v.isNull(), empty).when(kind == "STRING", F.when(single == "", empty).otherwise(F.array(single))).when(F.startswith(kind, F.lit("ARRAY")), listed).otherwise(empty)


def fit_label(c: Column, points: Column) -> Column:
    """A label of any case, else the band of the score."""
    low = F.lower(F.trim(c))
    return F.coalesce(*[F.when(low == x.lower(), F.lit(x)) for x in ("High", "Medium", "Low")], label_for(points))


def label_for(points: Column) -> Column:
    return F.when(points >= 75, "High").when(points >= 45, "Medium").otherwise("Low")


def analysis(raw: Column) -> Column:
    """A typed analysis from a model response; a response without an object gets the defaults."""
    v = json_object(raw)
    at = lambda key: F.try_variant_get(v, f"$.{key}", "variant")
    points = score(at("score"))
    return F.struct(
        points.alias("score"),
        fit_label(F.try_variant_get(v, "$.fit_label", "string"), points).alias("fit_label"),
        F.trim(F.coalesce(F.try_variant_get(v, "$.explanation", "string"), F.lit(""))).alias("explanation"),
        string_list(at("matched_points")).alias("matched_points"),
        string_list(at("missing_points")).alias("missing_points"),
        F.trim(F.coalesce(F.try_variant_get(v, "$.notes", "string"), F.lit(""))).alias("notes"),
    )
