"""Inserts, updates and deletes on a snapshot store, with hooks around each write.

A write stages new files, runs the after-hooks and only then swaps the table's manifest, so an error anywhere
leaves the table as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.scalars import InputError, parse
from heddle.operators import predicates
from heddle.plans.catalog import Column, Table
from heddle.plans.policy import AccessError, Operation
from heddle.plans.reader import Reader
from heddle.plans.registry import MutationEvent, Registry
from heddle.sources.snapshots import SnapshotStore


def writable(table: Table, rule: Operation) -> dict[str, Column]:
    """Fields a client may set: granted, neither generated nor forced by a preset."""
    forced = {p.column.name for p in rule.presets}
    return {table.columns[c].field: table.columns[c] for c in rule.columns if c not in forced and not table.columns[c].generated}


def required(table: Table, rule: Operation) -> list[str]:
    """Fields an insert must name."""
    return [f for f, c in writable(table, rule).items() if not c.nullable and not c.has_default]


@dataclass
class Writer:
    reader: Reader
    store: SnapshotStore
    registry: Registry = field(default_factory=Registry)
    hooks: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    def rule(self, table: str, operation: str) -> tuple[Table, Operation]:
        rule = self.reader.access.get(table, {}).get(operation)
        if not rule or (operation == "insert" and not writable(self.reader.catalog[table], rule)):
            raise AccessError(f"role {self.reader.identity.role!r} may not {operation} {table!r}")
        return self.reader.catalog[table], rule

    def _values(self, table: Table, rule: Operation, given: dict[str, Any], what: str) -> dict[str, Any]:
        """Column -> value; presets win over what the client gives."""
        allowed = writable(table, rule)
        if unknown := [f for f in given if f not in allowed]:
            raise InputError(f"{what}: {unknown[0]!r} cannot be written")
        out = {allowed[f].name: parse(allowed[f], v) for f, v in given.items()}
        for p in rule.presets:
            v = p.value(self.reader.identity.claims)
            out[p.column.name] = parse(p.column, _fit(p.column, v))
        if not out:
            raise InputError(f"{what}: no column to write")
        if missing := [c for c, v in out.items() if v is None and not table.columns[c].nullable]:
            raise InputError(f"{what}: {missing[0]!r} must not be null")
        return out

    def _event(self, table: str, operation: str, **more: Any) -> MutationEvent:
        return MutationEvent(table, operation, self.reader.identity, reader=self.reader, **more)

    def _run(self, when: str, event: MutationEvent) -> None:
        for hook in self.registry.chain(self.hooks, event.table, f"{when}_{event.operation}"):
            hook(event)

    # insert --------------------------------------------------------------------------------------------

    def insert(self, name: str, objects: list[dict[str, Any]]) -> tuple[int, list[dict[str, Any]]]:
        """Rows added, and the values written (with generated keys). The insert rule's filter is not applied."""
        table, rule = self.rule(name, "insert")
        if not objects:
            raise InputError("objects must not be empty")
        rows = []
        for o in objects:
            if missing := [f for f in required(table, rule) if o.get(f) is None]:
                raise InputError(f"insert into {name}: {missing[0]!r} is required")
            rows.append(self._values(table, rule, o, f"insert into {name}"))
        with self.store.lock(name):
            event = self._event(name, "insert", values=[dict(r) for r in rows])
            self._run("before", event)
            current = self.store(name)
            for c in table.columns.values():
                if c.auto_increment and any(r.get(c.name) is None for r in rows):
                    top = current.agg(F.max(f"`{c.name}`")).first()[0] or 0
                    for r in rows:
                        if r.get(c.name) is None:
                            top += 1
                            r[c.name] = top
                        else:
                            top = max(top, r[c.name])
                elif c.default is not None:
                    for r in rows:
                        r.setdefault(c.name, parse(c, c.default))
            schema = T.StructType([f for f in current.schema.fields])
            made = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
            added = self.store.spark.createDataFrame(made, schema)
            self._check_keys(table, current, added)
            self._check_references(table, added)
            files = self.store.files(name) + self.store.files_of(added, name)
            event.affected = len(rows)
            self._run("after", event)
            self.store.commit(name, schema, files)
        return len(rows), rows

    def _check_keys(self, table: Table, current: DataFrame, added: DataFrame) -> None:
        key = [f"`{c}`" for c in table.primary_key]
        if not key:
            return
        if added.groupBy(*key).count().where("count > 1").limit(1).count():
            raise InputError(f"{table.name}: a key is inserted twice")
        # the new rows come from one request, so they are few
        names = list(table.primary_key)
        if current.select(*key).join(F.broadcast(added.select(*key)), names, "left_semi").limit(1).count():
            raise InputError(f"{table.name}: a key exists already")

    def _check_references(self, table: Table, changed: DataFrame) -> None:
        for k in table.foreign_keys:
            if k.ref_table not in self.reader.catalog.tables:
                continue
            some = changed.select(*(F.col(f"`{c}`").alias(r) for c, r in zip(k.columns, k.ref_columns, strict=True))).dropna()
            if some.join(self.reader.tables(k.ref_table), list(k.ref_columns), "left_anti").limit(1).count():
                raise InputError(f"{table.name}: {', '.join(k.columns)} names no row of {k.ref_table}")

    def insert_one(self, name: str, obj: dict[str, Any]) -> dict[str, Any] | None:
        """The key, by field, of the new row, if it is known."""
        _, rows = self.insert(name, [obj])
        key = {self.reader.catalog[name].columns[c].field: rows[0].get(c) for c in self.reader.catalog[name].primary_key}
        return key if key and all(v is not None for v in key.values()) else None

    # update and delete -----------------------------------------------------------------------------------

    def _matching(self, name: str, rule: Operation, where: dict[str, Any] | None, key: dict[str, Any] | None) -> DataFrame:
        """All rows of the table with ``__hit`` and ``__file``: hit are those the rule's filter and the request choose."""
        table = self.reader.catalog[name]
        rows = self.store(name).select("*", F.col("_metadata.file_path").alias("__file")) if self.store.files(name) else None
        if rows is None:
            return self.store(name).withColumns({"__file": F.lit(""), "__hit": F.lit(False)})
        test: SparkColumn = F.lit(True)
        found = predicates.where(self.reader.fields(name) if where else {}, where)
        if found is not None:
            test = test & found
        for f, v in (key or {}).items():
            c = table.by_field[f]
            test = test & (F.col(f"`{c.name}`") == F.lit(parse(c, v)).cast(c.dtype))
        if rule.filter is None:
            return rows.withColumn("__hit", F.coalesce(test, F.lit(False)))
        rows = self.reader.marked(rows, rule.filter, "__in")
        return rows.withColumn("__hit", F.coalesce(test & F.col("__in"), F.lit(False))).drop("__in")

    def _rewrite(self, name: str, operation: str, rule: Operation, event: MutationEvent, where, key, changes: dict[str, SparkColumn] | None) -> int:
        schema = self.store.schema(name)
        table = self.reader.catalog[name]
        with self.store.lock(name):
            self._run("before", event)
            rows = self._matching(name, rule, where, key)
            touched = {r["__file"]: r["n"] for r in rows.where("__hit").groupBy("__file").agg(F.count("*").alias("n")).collect()}  # a row for each file
            files = self.store.files(name)
            if touched:
                mine = rows.where(F.col("__file").isin(list(touched)))
                if changes is None:
                    kept = mine.where(~F.col("__hit"))
                else:
                    kept = mine.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(f"`{c}`")) for c, v in changes.items()})
                kept = kept.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields))
                gone = {_path(t) for t in touched}
                rest = [f for f in files if _path(f) not in gone]
                made = self.store.files_of(kept, name)
                if changes and set(changes) & set(table.primary_key):
                    after = self.store.of_files(name, rest + made)
                    if after.groupBy(*(f"`{c}`" for c in table.primary_key)).count().where("count > 1").limit(1).count():
                        raise InputError(f"{name}: a key exists already")
                if changes and any(set(changes) & set(k.columns) for k in table.foreign_keys):
                    self._check_references(table, self.store.of_files(name, made))
                files = rest + made
            event.affected = sum(touched.values())
            self._run("after", event)
            if touched:
                self.store.commit(name, schema, files)
        return event.affected

    def update(self, name: str, where: dict[str, Any] | None, values: dict[str, Any], key: dict[str, Any] | None = None) -> int:
        """Rows matched. Only the update rule's own filter applies besides the request's."""
        table, rule = self.rule(name, "update")
        found = self._values(table, rule, values, f"update of {name}")
        changes = {c: _literal(table.columns[c], v) for c, v in found.items()}
        event = self._event(name, "update", values=[dict(found)], where=where if key is None else key)
        return self._rewrite(name, "update", rule, event, where, key, changes)

    def delete(self, name: str, where: dict[str, Any] | None, key: dict[str, Any] | None = None) -> int:
        _, rule = self.rule(name, "delete")
        return self._rewrite(name, "delete", rule, self._event(name, "delete", where=where if key is None else key), where, key, None)


def _path(uri: str) -> str:
    return uri.split(":", 1)[-1].lstrip("/")


def _fit(column: Column, value: Any) -> Any:
    """Presets and claims are text or numbers; they take the column's kind."""
    if column.kind == "String" and value is not None:
        return str(value)
    if column.kind == "Int" and isinstance(value, str) and value.lstrip("-").isdigit():
        return int(value)
    if column.kind == "Boolean" and value in (0, 1, "0", "1", "true", "false"):
        return value in (1, "1", "true")
    if column.kind == "Float" and isinstance(value, str):
        return float(value)
    return value


def _literal(column: Column, value: Any) -> SparkColumn:
    if isinstance(value, list):
        return F.array(*(F.lit(x) for x in value)).cast(column.dtype)
    return F.lit(value).cast(column.dtype)


def scratch_store(spark, reader: Reader, names: list[str], folder: str) -> SnapshotStore:
    """A store with copies of tables, for queries that show a table after a write."""
    store = SnapshotStore(spark, f"{folder.rstrip('/')}/store-{uuid.uuid4().hex}")
    for n in names:
        store.create(n, reader.tables(n))
    return store
