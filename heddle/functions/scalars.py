"""Values at the boundary: input coercion to Spark types, output as JSON-ready values."""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from heddle.plans.catalog import Column

#: Accepted date-time layouts, in the order they are tried.
LAYOUTS = ("%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d")


class InputError(ValueError):
    """A value that its scalar does not accept."""


def _int(value: Any, low: int, high: int, kind: str) -> int:
    if isinstance(value, bool):
        raise InputError(f"{kind} cannot represent {value!r}")
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if isinstance(value, str) and kind == "BigInt" and re.fullmatch(r"[+-]?[0-9]+", value):
        value = int(value)
    if not isinstance(value, int) or not low <= value <= high:
        raise InputError(f"{kind} cannot represent {value!r}")
    return value


def parse_datetime(value: str) -> dt.datetime:
    for layout in LAYOUTS:
        try:
            found = dt.datetime.strptime(value.replace("Z", "+00:00") if value.endswith("Z") else value, layout)
        except ValueError:
            continue
        return found.astimezone(dt.timezone.utc).replace(tzinfo=None) if found.tzinfo else found
    raise InputError(f"DateTime cannot represent {value!r}")


def vector(value: Any) -> list[float]:
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            raise InputError(f"Vector cannot represent {value!r}") from None
    if not isinstance(value, list) or any(isinstance(x, bool) or not isinstance(x, int | float) for x in value):
        raise InputError("a Vector is a list of numbers")
    return [float(x) for x in value]


def parse(column: Column, value: Any) -> Any:
    """A client's value for a column as Python value; None stays None."""
    if value is None:
        return None
    kind = column.kind
    if kind == "Boolean":
        if not isinstance(value, bool):
            raise InputError(f"Boolean cannot represent {value!r}")
        return value if column.dtype.typeName() == "boolean" else int(value)
    if kind == "Int":
        return _int(value, -(2**31), 2**31 - 1, kind)
    if kind == "BigInt":
        unsigned = column.dtype.typeName().startswith("decimal")
        return _int(value, 0 if unsigned else -(2**63), 2**64 - 1 if unsigned else 2**63 - 1, kind)
    if kind == "Float":
        if isinstance(value, bool) or not isinstance(value, int | float):
            raise InputError(f"Float cannot represent {value!r}")
        return float(value)
    if kind == "Decimal":
        try:
            found = Decimal(str(value)) if not isinstance(value, bool) else None
        except InvalidOperation:
            found = None
        if found is None or not found.is_finite():
            raise InputError(f"Decimal cannot represent {value!r}")
        return found
    if kind == "Date":
        try:
            return dt.datetime.strptime(value, "%Y-%m-%d").date()
        except (TypeError, ValueError):
            raise InputError(f"Date cannot represent {value!r}") from None
    if kind == "DateTime":
        if not isinstance(value, str):
            raise InputError(f"DateTime cannot represent {value!r}")
        return parse_datetime(value)
    if kind == "Bytes":
        try:
            return base64.b64decode(value, validate=True)
        except (TypeError, ValueError):
            raise InputError(f"Bytes cannot represent {value!r}") from None
    if kind == "JSON":
        return json.dumps(value)
    if kind == "Vector":
        found = vector(value)
        if column.dimension and len(found) != column.dimension:
            raise InputError(f"{column.name} has {column.dimension} dimensions, not {len(found)}")
        return found
    if not isinstance(value, str):
        raise InputError(f"String cannot represent {value!r}")
    return value


def literal(column: Column, value: Any) -> SparkColumn:
    """A client's value as a literal of the column's type."""
    found = parse(column, value)
    if isinstance(found, list):
        return F.array(*(F.lit(x) for x in found)).cast(column.dtype)
    return F.lit(found).cast(column.dtype)


def shown(kind: str, value: Any) -> Any:
    """A collected value as the response shows it."""
    if value is None:
        return None
    if kind == "Boolean":
        return bool(value)
    if kind == "BigInt":
        return int(value)
    if kind == "Decimal":
        return format(value, "f") if isinstance(value, Decimal) else str(value)
    if kind == "DateTime":
        return value.strftime("%Y-%m-%dT%H:%M:%SZ")
    if kind == "Date":
        return value.isoformat()
    if kind == "Bytes":
        return base64.b64encode(bytes(value)).decode()
    if kind == "JSON":
        try:
            return json.loads(value)
        except ValueError:
            return value
    if kind == "Vector":
        return "[" + ",".join(format(float(x), "g") for x in value) + "]"
    return value
