"""The boolean filter language: a mapping of fields to comparisons, compiled to one Column."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from heddle.functions import jsonpred
from heddle.functions.scalars import InputError, literal, parse
from heddle.plans.catalog import Column

COMPARE = {
    "_eq": lambda c, x: c == x,
    "_neq": lambda c, x: c != x,
    "_gt": lambda c, x: c > x,
    "_gte": lambda c, x: c >= x,
    "_lt": lambda c, x: c < x,
    "_lte": lambda c, x: c <= x,
}
TEXT = {
    "_like": lambda c, p: c.like(p),
    "_nlike": lambda c, p: ~c.like(p),
    "_regex": lambda c, p: c.rlike(p),
    "_nregex": lambda c, p: ~c.rlike(p),
}


def operators(kind: str) -> tuple[str, ...]:
    """The comparisons a scalar offers."""
    base = ("_eq", "_neq", "_is_null")
    if kind == "JSON":
        return (*base, "_contains", "_has_key")
    if kind == "Boolean":
        return base
    ordered = (*base, "_gt", "_gte", "_lt", "_lte", "_in", "_nin")
    return (*ordered, *TEXT) if kind == "String" else ordered


def compare(column: Column, operator: str, value: Any) -> SparkColumn:
    c = F.col(f"`{column.name}`")
    if operator not in operators(column.kind):
        raise InputError(f"{column.field} has no operator {operator}")
    if operator == "_is_null":
        if not isinstance(value, bool):
            raise InputError("_is_null takes true or false")
        return c.isNull() if value else c.isNotNull()
    if operator in ("_in", "_nin"):
        if not isinstance(value, list):
            raise InputError(f"{operator} takes a list")
        if not value:
            return F.lit(operator == "_nin")
        if column.kind in ("Vector",):
            found = reduce(or_, [c == literal(column, v) for v in value])
        else:
            found = c.isin(*[F.lit(parse(column, v)).cast(column.dtype) for v in value])
        return found if operator == "_in" else ~found
    if value is None:
        raise InputError(f"{operator} cannot be compared with null; use _is_null")
    if operator == "_contains":
        return jsonpred.contains(c, value)
    if operator == "_has_key":
        if not isinstance(value, str):
            raise InputError("_has_key takes a string")
        return jsonpred.has_key(c, value)
    if column.kind == "JSON":
        found = jsonpred.same(c, value)
        return found if operator == "_eq" else ~found
    if operator in TEXT:
        return TEXT[operator](c, parse(column, value))
    return COMPARE[operator](c, literal(column, value))


def where(fields: dict[str, Column], tree: dict[str, Any] | None) -> SparkColumn | None:
    """The condition of a filter tree over the fields a role may read; None if nothing is restricted."""
    if not tree:
        return None
    tests: list[SparkColumn] = []
    for name in sorted(tree):
        value = tree[name]
        if value is None:
            continue
        if name in ("_and", "_or"):
            # an empty list restricts nothing; an empty tree inside is true
            parts = [found if (found := where(fields, t)) is not None else F.lit(True) for t in value]
            if parts:
                tests.append(reduce(and_ if name == "_and" else or_, parts))
        elif name == "_not":
            found = where(fields, value)
            tests.append(F.lit(False) if found is None else ~found)
        elif name not in fields:
            raise InputError(f"unknown filter column {name!r}")
        else:
            tests += [compare(fields[name], op, value[op]) for op in sorted(value)]
    return reduce(and_, tests) if tests else None
