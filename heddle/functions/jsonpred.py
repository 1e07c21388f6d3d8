"""Tests on JSON documents, compiled from plan-time literals to variant expressions.

A NULL document gives NULL; a document that simply does not match gives false, so negation is exact.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _guard(doc: Column, test: Column) -> Column:
    return F.when(doc.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(test, F.lit(False)))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _canonical(v: Column) -> Column:
    return F.to_json(v)


def _equal_scalar(v: Column, value: Any) -> Column:
    if value is None:
        return F.schema_of_variant(v) == "VOID"
    if isinstance(value, bool):
        return (F.schema_of_variant(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    if isinstance(value, str):
        return (F.schema_of_variant(v) == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(value))
    number = ~F.schema_of_variant(v).isin("BOOLEAN", "STRING", "VOID") & ~F.schema_of_variant(v).rlike("^(ARRAY|OBJECT)")
    return number & (F.try_variant_get(v, "$", "double") == F.lit(float(value)))


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _some_contains(v: Column, value: Any) -> Column:
    return F.exists(_elements(v), lambda e: F.coalesce(_contains(e, value), F.lit(False)))


def _contains(v: Column, value: Any) -> Column:
    if isinstance(value, dict):

        def member(key: str, inner: Any) -> Column:
            return F.coalesce(_once(F.try_variant_get(v, _path(key), "variant"), lambda found: _contains(found, inner)), F.lit(False))

        tests = [member(k, x) for k, x in value.items()]
        return reduce(and_, tests, F.schema_of_variant(v).startswith("OBJECT"))
    if isinstance(value, list):
        is_list = F.schema_of_variant(v).startswith("ARRAY")
        return reduce(and_, [F.coalesce(_some_contains(v, x), F.lit(False)) for x in value], is_list)
    inside = F.exists(_elements(v), lambda e: F.coalesce(_equal_scalar(e, value), F.lit(False)))
    return F.coalesce(_equal_scalar(v, value), F.lit(False)) | (F.schema_of_variant(v).startswith("ARRAY") & F.coalesce(inside, F.lit(False)))


def contains(doc: Column, value: Any) -> Column:
    """Whether a document contains a candidate: objects by key, lists by element, scalars by value."""
    return _guard(doc, _once(F.try_parse_json(doc), lambda v: _contains(v, value)))


def has_key(doc: Column, key: str) -> Column:
    """Whether an object has a key. Dots lead to nested keys; a quoted part may hold dots of its own."""
    v = F.try_parse_json(doc)
    parts = [a or b for a, b in re.findall(r'"([^"]*)"|([^."]+)', key)] or [key]
    for part in parts[:-1]:
        v = F.try_variant_get(v, _path(part), "variant")
    return _guard(doc, F.array_contains(F.json_object_keys(_canonical(v)), parts[-1]))


def same(doc: Column, value: Any) -> Column:
    """Structural equality of a document and a literal."""
    return F.when(doc.isNull(), F.lit(None).cast("boolean")).otherwise(
        F.coalesce(_canonical(F.try_parse_json(doc)) == _canonical(F.parse_json(F.lit(json.dumps(value)))), F.lit(False))
    )
