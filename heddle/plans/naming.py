"""Public field names of tables and columns."""

from __future__ import annotations

import re
from collections.abc import Iterable


def field_name(name: str) -> str:
    out = re.sub(r"[^_a-zA-Z0-9]", "_", name) or "_"
    if out[0].isdigit():
        out = "_" + out
    return re.sub(r"^__+", "_", out)


def check_collisions(tables: dict[str, Iterable[str]]) -> None:
    """Raise if two tables, two columns of a table or two generated names would share a public name.

    tables: table -> its columns.
    """
    owners: dict[str, str] = {}
    for table in tables:
        name = field_name(table)
        if name in owners:
            raise ValueError(f"tables {owners[name]!r} and {table!r} both map to the public name {name!r}")
        owners[name] = table
    roots = {"_role": "the built-in field _role"}
    writes: dict[str, str] = {}
    fixed = ("Query", "Mutation", "order_by", "mutation_response", "page_info", "vector_metric")
    scalars = ("Int", "Float", "String", "Boolean", "ID", "BigInt", "Decimal", "Date", "DateTime", "JSON", "Bytes", "Vector")
    types = {t: f"the built-in type {t}" for t in (*fixed, *scalars, *(f"{s}_comparison_exp" for s in scalars))}

    def claim(space: dict[str, str], name: str, owner: str) -> None:
        if name in space:
            raise ValueError(f"{name!r} of {owner} collides with {space[name]}")
        space[name] = owner

    for table, columns in tables.items():
        seen: dict[str, str] = {}
        for column in columns:
            name = field_name(column)
            if name in seen:
                raise ValueError(f"columns {seen[name]!r} and {column!r} of table {table!r} both map to the public name {name!r}")
            seen[name] = column
        t, owner = field_name(table), f"table {table!r}"
        for name in (f"{t}_by_pk", f"{t}_connection", f"{t}_aggregate", *(f"{t}_nearest_by_{c}" for c in seen)):
            claim(roots, name, owner)
        for verb in ("insert", "update", "delete"):
            claim(writes, f"{verb}_{t}", owner)
            claim(writes, f"{verb}_{t}_{'one' if verb == 'insert' else 'by_pk'}", owner)
        for suffix in ("", "_bool_exp", "_order_by", "_connection", "_aggregate", "_sum", "_avg", "_min", "_max", "_insert_input", "_set_input", "_neighbor"):
            claim(types, t + suffix, owner)
