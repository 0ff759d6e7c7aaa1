"""Structured documents: JSON as variants, with typed reads, and YAML by way of JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _loads(text: str | None, yaml_first: bool = False, json_only: bool = False) -> str | None:
    """Canonical JSON of a JSON or YAML text; of repeated keys the last counts."""
    if text is None:
        return None
    text = text.removeprefix("﻿")
    if not yaml_first:
        try:
            return json.dumps(json.loads(text), ensure_ascii=False)
        except (ValueError, RecursionError):
            if json_only:
                return None
    try:
        import yaml
    except ImportError:
        return None
    try:
        return json.dumps(yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)), ensure_ascii=False, default=str)
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return None


@F.pandas_udf(StringType())
def structured(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """JSON text of documents that are JSON, or YAML; null if neither. The flag says that YAML is expected."""
    for body, is_yaml in batches:
        yield pd.Series([_loads(b, bool(y)) for b, y in zip(body, is_yaml, strict=True)], dtype="object")


@F.pandas_udf(StringType())
def lenient_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON text again, with repeated keys resolved; null if it isn't JSON."""
    for body in batches:
        yield pd.Series([_loads(b, json_only=True) for b in body], dtype="object")


def variant(body: Column) -> Column:
    """A JSON text as a variant; null if it can't be read."""
    return F.try_parse_json(F.regexp_replace(body, "^\\uFEFF", ""))


def kind(doc: Column, path: str = "$") -> Column:
    """Type name at a path: OBJECT..., ARRAY..., STRING, BIGINT, ...; null if absent."""
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))


def text(doc: Column, path: str) -> Column:
    """A string at a path; null for other types, which a plain read would convert."""
    return F.when(kind(doc, path) == "STRING", F.try_variant_get(doc, path, "string"))


def flag(doc: Column, path: str) -> Column:
    return F.when(kind(doc, path) == "BOOLEAN", F.try_variant_get(doc, path, "boolean"))


def number(doc: Column, path: str) -> Column:
    return F.when(kind(doc, path).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(doc, path, "double"))


def exists(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant").isNotNull()


def is_array(doc: Column, path: str) -> Column:
    return F.coalesce(kind(doc, path).startswith("ARRAY"), F.lit(False))


def is_object(doc: Column, path: str = "$") -> Column:
    return F.coalesce(kind(doc, path).startswith("OBJECT"), F.lit(False))


def items(doc: Column, path: str) -> Column:
    """Elements of an array at a path as variants; empty otherwise."""
    return F.when(is_array(doc, path), F.try_variant_get(doc, path, "array<variant>")).otherwise(F.array().cast("array<variant>"))


def values(doc: Column, path: str) -> Column:
    """Values of an object at a path in order of its keys; empty otherwise."""
    return F.when(is_object(doc, path), F.map_values(F.try_variant_get(doc, path, "map<string,variant>"))).otherwise(F.array().cast("array<variant>"))


def strings(array: Column) -> Column:
    """The strings among variants."""
    return F.filter(F.transform(array, lambda v: text(v, "$")), lambda s: s.isNotNull())
