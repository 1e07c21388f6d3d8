"""Tables, columns and keys: schemas come from the data, keys from a declaration."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, count
from typing import Any

import yaml
from pyspark.sql import types as T

from heddle.plans.naming import check_collisions, field_name

_KINDS = (
    (T.BooleanType, "Boolean"), (T.ByteType, "Int"), (T.ShortType, "Int"), (T.IntegerType, "Int"), (T.LongType, "BigInt"),
    (T.FloatType, "Float"), (T.DoubleType, "Float"), (T.DecimalType, "Decimal"), (T.DateType, "Date"), (T.TimestampNTZType, "DateTime"),
    (T.TimestampType, "DateTime"), (T.BinaryType, "Bytes"), (T.ArrayType, "Vector"), (T.StringType, "String"),
)
NUMERIC = (T.NumericType,)


def kind_of(dtype: T.DataType) -> str:
    for cls, kind in _KINDS:
        if isinstance(dtype, cls):
            return "BigInt" if isinstance(dtype, T.DecimalType) and dtype.scale == 0 and dtype.precision == 20 else kind
    raise TypeError(f"no scalar for {dtype.simpleString()}")


@dataclass(frozen=True)
class Column:
    name: str
    dtype: T.DataType
    kind: str
    nullable: bool = True
    has_default: bool = False
    auto_increment: bool = False
    generated: bool = False
    default: Any = None
    dimension: int | None = None

    @property
    def field(self) -> str:
        return field_name(self.name)

    @property
    def numeric(self) -> bool:
        return isinstance(self.dtype, NUMERIC)


@dataclass(frozen=True)
class ForeignKey:
    name: str
    table: str
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]


@dataclass(frozen=True)
class Relation:
    """One direction of a foreign key: ``local`` columns of a table equal ``remote`` columns of the target."""

    name: str
    key: ForeignKey
    target: str
    local: tuple[str, ...]
    remote: tuple[str, ...]
    many: bool


@dataclass
class Table:
    name: str
    columns: dict[str, Column]
    primary_key: tuple[str, ...] = ()
    foreign_keys: list[ForeignKey] = field(default_factory=list)

    @property
    def field(self) -> str:
        return field_name(self.name)

    @cached_property
    def by_field(self) -> dict[str, Column]:
        return {c.field: c for c in self.columns.values()}


class Catalog:
    """Exposed tables in name order, with their foreign keys in both directions."""

    def __init__(self, tables: list[Table]):
        if not tables:
            raise ValueError("the catalog has no tables")
        self.tables = {t.name: t for t in sorted(tables, key=lambda t: t.name)}
        check_collisions({t.name: list(t.columns) for t in self.tables.values()})
        self.foreign_keys = sorted(
            (k for t in self.tables.values() for k in t.foreign_keys if k.ref_table in self.tables), key=lambda k: (k.table, k.name)
        )

    def __getitem__(self, name: str) -> Table:
        return self.tables[name]

    @cached_property
    def _relations(self) -> dict[str, dict[str, Relation]]:
        out: dict[str, dict[str, Relation]] = {t: {} for t in self.tables}

        def free(table: Table, base: str, key: ForeignKey) -> str:
            """The base name, or with the key's columns, or numbered, whichever is not taken yet."""
            taken = out[table.name].keys() | table.by_field.keys()
            longer = f"{base}_by_{'_'.join(field_name(c) for c in key.columns)}"
            return next(n for n in chain([base, longer], (f"{longer}_{i}" for i in count(1))) if n not in taken)

        for key in self.foreign_keys:
            child, parent = self[key.table], self[key.ref_table]
            one = key.columns[0].removesuffix("_id") if len(key.columns) == 1 and key.columns[0].endswith("_id") and key.columns[0] != "_id" else parent.name
            name = free(child, field_name(one), key)
            out[child.name][name] = Relation(name, key, parent.name, key.columns, key.ref_columns, False)
            name = free(parent, child.field, key)
            out[parent.name][name] = Relation(name, key, child.name, key.ref_columns, key.columns, True)
        return out

    def relations(self, table: str) -> dict[str, Relation]:
        return self._relations[table]


def exposed(names: list[str], include: list[str] = (), exclude: list[str] = ()) -> list[str]:
    """Exclude wins over include; an empty include list means all."""
    hit = lambda n, patterns: any(fnmatch.fnmatchcase(n, p) for p in patterns)
    return [n for n in names if not hit(n, exclude) and (not include or hit(n, include))]


def load(declaration: str | dict, schemas: dict[str, T.StructType], include: list[str] = (), exclude: list[str] = ()) -> Catalog:
    """A catalog of the declared tables that have a schema.

    declaration: YAML text or its mapping, ``tables: {name: {primary_key, foreign_keys, columns}}``.
    """
    spec = yaml.safe_load(declaration) if isinstance(declaration, str) else declaration
    tables = []
    for name in exposed(sorted(schemas), include, exclude):
        own = spec.get("tables", {}).get(name) or {}
        extra = own.get("columns", {})
        columns = {}
        for f in schemas[name].fields:
            c = extra.get(f.name, {})
            columns[f.name] = Column(
                f.name, f.dataType, c.get("kind") or kind_of(f.dataType), c.get("nullable", f.nullable),
                bool({"default", "auto_increment", "generated"} & c.keys()), c.get("auto_increment", False), c.get("generated", False), c.get("default"), c.get("dimension"),
            )
        key = [k for k in columns if k in (own.get("primary_key") or [])]
        keys = [
            ForeignKey(k.get("name", f"{name}_{'_'.join(k['columns'])}"), name, tuple(k["columns"]), k["references"], tuple(k["ref_columns"]))
            for k in own.get("foreign_keys", [])
        ]
        for k in keys:
            if len(k.columns) != len(k.ref_columns) or not set(k.columns) <= columns.keys():
                raise ValueError(f"foreign key {k.name!r} of table {name!r} names columns that don't fit")
        if missing := set(own.get("primary_key") or []) - columns.keys():
            raise ValueError(f"primary key of table {name!r} names unknown columns {sorted(missing)}")
        tables.append(Table(name, columns, tuple(key), keys))
    return Catalog(tables)
