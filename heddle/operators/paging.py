"""Keyset pages: opaque cursors, the seek predicate and the page itself."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
from decimal import Decimal
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.scalars import InputError
from heddle.plans.catalog import Column


#: Cursor layout: this byte, the digest of what the cursor walks over, then the key's values as JSON pairs (type, text).
LAYOUT = b"\x01"
DIGEST = 12
#: Key types by name: how a value becomes text and comes back exactly. The first class that fits is taken.
_CODECS = {
    "bool": (bool, lambda v: str(int(v)), lambda t: t == "1"),
    "int": (int, str, int),
    "decimal": (Decimal, str, Decimal),
    "double": (float, float.hex, float.fromhex),
    "timestamp": (dt.datetime, dt.datetime.isoformat, dt.datetime.fromisoformat),
    "date": (dt.date, dt.date.isoformat, dt.date.fromisoformat),
    "binary": ((bytes, bytearray), lambda v: bytes(v).hex(), bytes.fromhex),
    "string": (object, str, str),
}


def shape(table: str, where: dict[str, Any] | None) -> bytes:
    """A digest of the walk: the table and the filter, whatever the order of the filter's keys."""
    return hashlib.blake2b(json.dumps([table, where], sort_keys=True).encode(), digest_size=DIGEST).digest()


def encode_cursor(key: list[Any], walk: bytes) -> str:
    pairs = []
    for value in key:
        name = next(n for n, (kind, _, _) in _CODECS.items() if isinstance(value, kind))
        pairs.append((name, _CODECS[name][1](value)))
    return base64.urlsafe_b64encode(LAYOUT + walk + json.dumps(pairs).encode()).decode()


def decode_cursor(cursor: str, walk: bytes, arity: int) -> list[Any]:
    """The key behind a cursor of the same walk; a walk's digest is compared before anything is parsed."""
    try:
        raw = base64.b64decode(cursor, altchars=b"-_", validate=True)
    except ValueError:
        raw = b""
    head = len(LAYOUT) + DIGEST
    if not raw.startswith(LAYOUT) or len(raw) < head:
        raise InputError("not a cursor")
    if raw[len(LAYOUT) : head] != walk:
        raise InputError("the cursor belongs to another table or filter")
    try:
        key = [_CODECS[name][2](text) for name, text in json.loads(raw[head:])]
    except (ArithmeticError, LookupError, TypeError, ValueError):
        key = []
    if len(key) != arity:
        raise InputError("not a cursor")
    return key


def seek(key: list[Column], after: list[Any]) -> SparkColumn:
    """Rows behind a key, as a tree of plain comparisons: that form reaches the file scan, a struct comparison doesn't."""
    steps = []
    for i, column in enumerate(key):
        value = F.lit(after[i]).cast(column.dtype)
        same = [F.col(f"`{c.name}`") == F.lit(v).cast(c.dtype) for c, v in zip(key[:i], after[:i], strict=True)]
        steps.append(reduce(and_, [*same, F.col(f"`{column.name}`") > value]))
    return reduce(or_, steps)


def page_size(first: int | None, default: int, most: int, name: str = "first") -> int:
    if first is None:
        return default
    if isinstance(first, bool) or not isinstance(first, int) or first < 0:
        raise InputError(f"{name} must be >= 0")
    return min(first, most)


def page(rows: DataFrame, key: list[Column], first: int, after: list[Any] | None) -> DataFrame:
    """One row more than asked for, in key order; the extra row only tells that there is a next page."""
    if after is not None:
        rows = rows.where(seek(key, after))
    return rows.orderBy(*(F.col(f"`{c.name}`") for c in key)).limit(first + 1)


def page_info(keys: list[list[Any]], first: int, walk: bytes) -> tuple[int, dict[str, Any]]:
    """How many of the collected rows belong to the page, and its has_next_page and end_cursor."""
    n = min(len(keys), first)
    more = first > 0 and len(keys) > first
    return n, {"has_next_page": more, "end_cursor": encode_cursor(keys[n - 1], walk) if n else None}
