"""What users add: mutation hooks, root fields of their own and a role resolver."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

EVENTS = ("before_insert", "after_insert", "before_update", "after_update", "before_delete", "after_delete")


@dataclass
class MutationEvent:
    """What a hook sees. Changing it does not change what is written; raising aborts the write."""

    table: str
    operation: str
    identity: Any
    values: list[dict[str, Any]] = field(default_factory=list)
    where: dict[str, Any] | None = None
    affected: int | None = None
    reader: Any = None


@dataclass(frozen=True)
class CustomField:
    """A root field. resolve(context, **args) returns a value, a Row or a DataFrame.

    type: what introspection shows; ``types`` describes object types that it names (type -> field -> type).
    Arguments are those of ``resolve``, typed by its annotations.
    """

    name: str
    operation: str
    resolve: Callable[..., Any]
    roles: tuple[str, ...] = ()
    type: str = "JSON"
    types: dict[str, dict[str, str]] = field(default_factory=dict)

    @property
    def args(self) -> dict[str, str]:
        """Argument -> its type; those without a default are required."""
        _, *given = inspect.signature(self.resolve).parameters.values()
        kinds = {"int": "Int", "str": "String", "float": "Float", "bool": "Boolean"}
        named = (p for p in given if p.kind not in (p.VAR_KEYWORD, p.VAR_POSITIONAL))
        return {p.name: kinds.get(getattr(p.annotation, "__name__", p.annotation), "JSON") + "!" * (p.default is p.empty) for p in named}


@dataclass
class Registry:
    hooks: dict[str, Callable[[MutationEvent], None]] = field(default_factory=dict)
    fields: list[CustomField] = field(default_factory=list)
    role_resolver: Callable[[dict[str, Any]], str] | None = None

    def mutation_hook(self, name: str, hook: Callable[[MutationEvent], None]) -> None:
        if name in self.hooks:
            raise ValueError(f"hook {name!r} is registered twice")
        self.hooks[name] = hook

    def custom_field(self, made: CustomField) -> None:
        self.fields.append(made)

    def resolver(self, resolve: Callable[[dict[str, Any]], str]) -> None:
        if self.role_resolver:
            raise ValueError("a role resolver is registered already")
        self.role_resolver = resolve

    def copy(self) -> Registry:
        return Registry(dict(self.hooks), list(self.fields), self.role_resolver)

    def reset(self) -> None:
        self.hooks.clear()
        self.fields.clear()
        self.role_resolver = None

    def check(self, wiring: dict[str, dict[str, list[str]]], roles: set[str], tables: set[str], generated: set[str] = frozenset()) -> None:
        """Raise for hooks, events, tables or roles that don't exist, and for root fields that collide."""
        for table, events in wiring.items():
            if table != "*" and table not in tables:
                raise ValueError(f"hooks name table {table!r}, which is not exposed")
            for event, names in (events or {}).items():
                if event not in EVENTS:
                    raise ValueError(f"unknown hook event {event!r}")
                if unknown := [n for n in names if n not in self.hooks]:
                    raise ValueError(f"hook {unknown[0]!r} is not registered")
        seen: set[tuple[str, str]] = set()
        for f in self.fields:
            if f.operation not in ("query", "mutation"):
                raise ValueError(f"field {f.name!r}: operation must be query or mutation")
            if unknown := [r for r in f.roles if r not in roles]:
                raise ValueError(f"field {f.name!r} names role {unknown[0]!r}, which is not defined")
            if (f.operation, f.name) in seen or f.name in generated:
                raise ValueError(f"field {f.name!r} collides with another root field")
            seen.add((f.operation, f.name))

    def chain(self, wiring: dict[str, dict[str, list[str]]], table: str, event: str) -> list[Callable[[MutationEvent], None]]:
        """Hooks of all tables first, then the table's own."""
        return [self.hooks[n] for t in ("*", table) for n in (wiring.get(t) or {}).get(event, [])]


#: The registry that a process uses unless it makes its own.
default = Registry()
