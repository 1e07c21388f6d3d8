"""Roles: which columns and rows of which tables each operation may touch."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from heddle.plans.catalog import Catalog, Column, Table

OPERATIONS = ("select", "insert", "update", "delete")


class AccessError(Exception):
    """A claim or a permission is missing."""


@dataclass(frozen=True)
class Identity:
    role: str
    claims: dict[str, Any] = field(default_factory=dict)


def claim(claims: dict[str, Any], path: str) -> Any:
    """The value at a dotted path. Keys may hold dots: of all ways to cut the path, longer first keys come first."""
    parts = path.split(".")
    ways = [(claims, 0)]  # objects reached, each with the number of parts used; the next to try is last
    while ways:
        here, used = ways.pop()
        if used == len(parts):
            return here
        if isinstance(here, dict):
            ends = range(used + 1, len(parts) + 1)
            ways += [(here[key], end) for end in ends if (key := ".".join(parts[used:end])) in here]
    raise AccessError(f"claim {path!r} is missing")


def scalar(value: Any, path: str) -> Any:
    """A claim as a bindable value. Whole floats become integers, so that comparisons reach the file scan."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, bool | int | float | str) or value is None:
        return value
    raise AccessError(f"claim {path!r} is not a scalar")


@dataclass(frozen=True)
class Filter:
    """SQL text pieces and the claim paths between them."""

    pieces: tuple[str, ...]
    paths: tuple[str, ...]

    def bind(self, claims: dict[str, Any]) -> tuple[str, list[Any]]:
        """SQL with markers, and the values; a list becomes several markers, an empty one NULL (matches nothing)."""
        sql, args = self.pieces[0], []
        for path, piece in zip(self.paths, self.pieces[1:], strict=True):
            value = claim(claims, path)
            values = value if isinstance(value, list) else [value]
            args += [scalar(v, path) for v in values]
            sql += (", ".join("?" * len(values)) or "NULL") + piece
        return sql, args


_TOKENS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`|:jwt\.([A-Za-z0-9_.]+)")


def compile_filter(text: str) -> Filter:
    """Split a row filter at its claims; quoted text is left alone."""
    if not text.strip():
        raise ValueError("a filter must not be blank")
    pieces, paths, end = [""], [], 0
    for m in _TOKENS.finditer(text):
        if m[1]:
            pieces[-1] += text[end : m.start()]
            paths.append(m[1])
            pieces.append("")
            end = m.end()
    pieces[-1] += text[end:]
    return Filter(tuple(pieces), tuple(paths))


@dataclass(frozen=True)
class Preset:
    column: Column
    path: str | None
    literal: str | None

    def value(self, claims: dict[str, Any]) -> Any:
        return scalar(claim(claims, self.path), self.path) if self.path else self.literal


@dataclass(frozen=True)
class Operation:
    columns: tuple[str, ...]
    filter: Filter | None = None
    presets: tuple[Preset, ...] = ()


Access = dict[str, dict[str, Operation]]  # table -> operation -> what it may touch


def _operation(role: str, table: Table, name: str, rule: Any, explicit: bool) -> Operation | None:
    if rule is None or rule is False:
        return None
    rule = {"allow": True} if rule is True else rule
    if not rule.get("allow"):
        return None
    where = f"role {role!r}, table {table.name!r}, {name}"
    wanted = rule.get("columns") or list(table.columns)
    presets = rule.get("presets") or {}
    if explicit and (unknown := [c for c in [*wanted, *presets] if c not in table.columns]):
        raise ValueError(f"{where}: column {unknown[0]!r} does not exist")
    columns = tuple(c for c in table.columns if c in wanted)
    if not columns:
        return None
    forced = []
    for c, v in sorted((c, v) for c, v in presets.items() if c in table.columns):
        path = v.removeprefix(":jwt.") if isinstance(v, str) and v.startswith(":jwt.") else None
        if path is not None and not re.fullmatch(r"[A-Za-z0-9_.]+", path):
            raise ValueError(f"{where}: preset {v!r} has an invalid claim path")
        forced.append(Preset(table.columns[c], path, None if path else v))
    text = rule.get("filter")
    return Operation(columns, compile_filter(text) if text else None, tuple(forced))


def resolve(role: str, rules: dict[str, Any], catalog: Catalog) -> Access:
    """One role's access. A table's own entry replaces the ``*`` entry as a whole; an entry of null leaves ``*``."""
    tables = rules.get("tables") or {}
    if unknown := [t for t in tables if t != "*" and t not in catalog.tables]:
        raise ValueError(f"role {role!r} grants permissions on table {unknown[0]!r}, which is not exposed")
    out: Access = {}
    for table in catalog.tables.values():
        own = tables.get(table.name)
        entry = tables.get("*") if own is None else own
        found = {op: o for op in OPERATIONS if (o := _operation(role, table, op, (entry or {}).get(op), own is not None))}
        if found:
            out[table.name] = found
    return out


def readable(access: Access, table: str) -> tuple[str, ...]:
    return access[table]["select"].columns if "select" in access.get(table, {}) else ()


def pk_readable(access: Access, table: Table) -> bool:
    return bool(table.primary_key) and set(table.primary_key) <= set(readable(access, table.name))


def roles_used(spec: dict[str, Any]) -> Iterator[str]:
    yield from spec
