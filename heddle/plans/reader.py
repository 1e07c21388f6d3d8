"""What one identity may read: every plan starts from its rows, filtered before any other predicate."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from heddle.functions.scalars import InputError, literal
from heddle.functions.scalars import vector as parse_vector
from heddle.operators import aggregates, paging, predicates, relations, vectors
from heddle.plans.catalog import Catalog, Column, Relation, Table
from heddle.plans.policy import Access, AccessError, Filter, Identity, pk_readable, readable


@dataclass
class Leaf:
    """A selected column, or with ``constant`` a fixed value such as the type's name."""

    name: str
    column: Column | None
    constant: str | None = None


@dataclass
class Branch:
    """A selected relation with the arguments of a to-many field."""

    name: str
    relation: Relation
    selection: list[Leaf | Branch]
    args: dict[str, Any] = field(default_factory=dict)


@dataclass
class Reader:
    spark: SparkSession
    catalog: Catalog
    access: Access
    identity: Identity
    tables: Callable[[str], DataFrame]
    default_page: int = 25
    most_page: int = 200

    def table(self, name: str) -> Table:
        if not readable(self.access, name):
            raise AccessError(f"role {self.identity.role!r} may not read {name!r}")
        return self.catalog[name]

    def fields(self, name: str) -> dict[str, Column]:
        """Readable columns by public name."""
        table = self.table(name)
        return {table.columns[c].field: table.columns[c] for c in readable(self.access, name)}

    def restricted(self, df: DataFrame, rule: Filter | None) -> DataFrame:
        """Rows that a row filter of the policy lets through; claims are bound, never spliced into the text."""
        if rule is None:
            return df
        return self._with_filter(df, rule, "SELECT * FROM {secured} WHERE (%s)")

    def marked(self, df: DataFrame, rule: Filter, name: str) -> DataFrame:
        """All rows, with whether a row filter lets them through as a column: evaluated in place, without a join to itself."""
        return self._with_filter(df, rule, f"SELECT *, coalesce((%s), false) AS {name} FROM {{secured}}")

    def _with_filter(self, df: DataFrame, rule: Filter, query: str) -> DataFrame:
        """Claims are bound as parameters. Tables that the filter's subqueries name are bound as common table expressions,
        so whatever form a FROM has, names are those of this statement alone and never of the session."""
        sql, args = rule.bind(self.identity.claims)
        named = {t: f"t{i}" for i, t in enumerate(self.catalog.tables) if re.search(rf"(?i)(?<![\w$]){re.escape(t)}(?![\w$])", sql)}
        if not re.search(r"(?i)\bselect\b", sql):
            named = {}
        bound = ", ".join(f"`{t}` AS (SELECT * FROM {{{key}}})" for t, key in named.items())
        text = (f"WITH {bound} " if named else "") + query % sql.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(text, args=args or None, secured=df, **{key: self.tables(t) for t, key in named.items()})

    def rows(self, name: str, where: dict[str, Any] | None = None) -> DataFrame:
        """Rows the identity may read, with all columns: those it may not read serve as join keys only."""
        fields = self.fields(name)
        df = self.restricted(self.tables(name), self.access[name]["select"].filter)
        test = predicates.where(fields, where)
        return df if test is None else df.where(test)

    def select(self, name: str, where: dict[str, Any] | None = None) -> DataFrame:
        """Readable rows and columns."""
        return self.rows(name, where).select(*(F.col(f"`{c}`") for c in readable(self.access, name)))

    def relation(self, table: str, name: str) -> Relation:
        """A relation the role may follow: its own key columns readable, the other side selectable."""
        found = self.catalog.relations(table).get(name)
        if not found or not set(found.local) <= set(readable(self.access, table)) or not readable(self.access, found.target):
            raise InputError(f"{table} has no relation {name!r}")
        return found

    def everything(self, table: str) -> list[Leaf]:
        return [Leaf(f, c) for f, c in self.fields(table).items()]

    # shaping -----------------------------------------------------------------------------------------

    def order(self, table: str, order_by: Any, fallback: tuple[str, ...] = ()) -> list[SparkColumn]:
        """Client keys in list order, then the key, then the join columns: the order is total where the table has a key."""
        fields, out, used = self.fields(table), [], set()
        for entry in [order_by] if isinstance(order_by, dict) else order_by or []:
            for f in sorted(entry, key=list(fields).index) if set(entry) <= fields.keys() else entry:
                if f not in fields or entry[f] not in ("asc", "desc"):
                    raise InputError(f"cannot order by {f!r}: {entry[f]!r}")
                c = F.col(f"`{fields[f].name}`")
                out.append(c.asc_nulls_first() if entry[f] == "asc" else c.desc_nulls_last())
                used.add(fields[f].name)
        own = self.catalog[table]
        rest = own.primary_key or (*fallback, *(c for c, x in own.columns.items() if x.kind not in ("Vector", "JSON")))
        return out + [F.col(f"`{c}`").asc_nulls_first() for c in dict.fromkeys(rest) if c not in used]

    def held(self, df: DataFrame, selection: list[Leaf | Branch], *more: str) -> tuple[DataFrame, list[Row] | None]:
        """A page, and its rows if relations hang on it: it is then read once, for all of them, and its keys are known to their plans.

        A page has a bounded number of rows. Of its columns those stay that the selection or ``more`` needs.
        """
        branches = [x for x in selection if isinstance(x, Branch)]
        if not branches:
            return df, None
        needed = [x.column.name for x in selection if isinstance(x, Leaf) and x.column] + [c for b in branches for c in b.relation.local] + list(more)
        df = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys(needed)))
        rows = df.collect()
        return self.spark.createDataFrame(rows, df.schema, verifySchema=False), rows

    def node(self, df: DataFrame, table: str, selection: list[Leaf | Branch], page: list[Row] | None, name: str = "__node") -> DataFrame:
        """Add a struct of the selection. page: the rows of df, if they are known."""
        parts = []
        for i, item in enumerate(selection):
            if isinstance(item, Leaf):
                value = F.lit(item.constant) if item.column is None else F.col(f"`{item.column.name}`")
                parts.append(value.alias(f"f{i}"))
            else:
                held = f"__r{i}"
                df = self.expand(df, item, held, page)
                parts.append(F.col(held).alias(f"f{i}"))
        df = df.withColumn(name, F.struct(*parts) if parts else F.struct(F.lit(1).alias("f0")))
        return df.drop(*(f"__r{i}" for i, x in enumerate(selection) if isinstance(x, Branch)))

    def expand(self, df: DataFrame, branch: Branch, name: str, page: list[Row] | None) -> DataFrame:
        relation, target = branch.relation, self.catalog[branch.relation.target]
        rows = self.rows(target.name, branch.args.get("where"))
        if page is not None:
            rows = relations.only_related(rows, page, relation)
        if not relation.many:
            nodes = self.node(rows, target.name, branch.selection, None)
            return relations.to_one(df, nodes, relation, F.col("__node"), name, set(target.primary_key) == set(relation.remote))
        limit = paging.page_size(branch.args.get("limit"), self.default_page, self.most_page, "limit")
        offset = branch.args.get("offset") or 0
        if offset < 0:
            raise InputError("offset must be >= 0")
        order = self.order(target.name, branch.args.get("order_by"), relation.remote)
        shaped = lambda numbered: self.node(numbered, target.name, branch.selection, None)
        node_type = self.node(self.tables(target.name).limit(0), target.name, branch.selection, None).schema["__node"].dataType.simpleString()
        return relations.to_many(df, rows, relation, shaped, node_type, name, order, limit, offset)

    # operators ---------------------------------------------------------------------------------------

    def key(self, table: str) -> list[Column]:
        own = self.table(table)
        if not pk_readable(self.access, own):
            raise InputError(f"{table} has no key that role {self.identity.role!r} may read")
        return [own.columns[c] for c in own.primary_key]

    def by_pk(self, table: str, values: dict[str, Any]) -> DataFrame:
        """The row of a key, by public field names."""
        df = self.rows(table)
        for column in self.key(table):
            if values.get(column.field) is None:
                raise InputError(f"{table} needs its key column {column.field!r}")
            df = df.where(F.col(f"`{column.name}`") == literal(column, values[column.field]))
        return df.limit(1)

    def page(self, table: str, where: dict[str, Any] | None = None, first: int | None = None, after: str | None = None) -> tuple[DataFrame, int]:
        """The rows of a page and one more, in key order, and the page's size."""
        key, size = self.key(table), paging.page_size(first, self.default_page, self.most_page)
        start = paging.decode_cursor(after, paging.shape(table, where), len(key)) if after else None
        return paging.page(self.rows(table, where), key, size, start), size

    def connection(self, table: str, selection: list[Leaf | Branch], where=None, first=None, after=None) -> tuple[DataFrame, int]:
        """Like page, with columns ``__node`` and the key."""
        df, size = self.page(table, where, first, after)
        key = [f"`{c.name}`" for c in self.key(table)]
        df = self.page_nodes(df, table, selection, *(c.name for c in self.key(table)))
        return df.select("__node", *(F.col(c).alias(f"__key{i}") for i, c in enumerate(key))).orderBy(*(f"__key{i}" for i in range(len(key)))), size

    def page_nodes(self, df: DataFrame, table: str, selection: list[Leaf | Branch], *more: str) -> DataFrame:
        """Nodes of a frame with a bounded number of rows."""
        df, rows = self.held(df, selection, *more)
        return self.node(df, table, selection, rows)

    def total_count(self, table: str, where: dict[str, Any] | None = None) -> DataFrame:
        return aggregates.aggregate(self.rows(table, where), [], True).withColumnRenamed("count", "total_count")

    def aggregate(self, table: str, requested: list[tuple[str, str]], where=None, count: bool = True) -> DataFrame:
        """requested: (function, field) pairs."""
        fields = self.fields(table)
        if unknown := [f for _, f in requested if f not in fields]:
            raise InputError(f"unknown column {unknown[0]!r}")
        return aggregates.aggregate(self.rows(table, where), [(fn, fields[f]) for fn, f in requested], count)

    def nearest(self, table: str, field_: str, to: Any, metric: str = "COSINE", first: int | None = None, where=None) -> DataFrame:
        fields = self.fields(table)
        if field_ not in fields or fields[field_].kind != "Vector":
            raise InputError(f"{table} has no vector column {field_!r}")
        column, target = fields[field_], parse_vector(to)
        if column.dimension and len(target) != column.dimension:
            raise InputError(f"{field_} has {column.dimension} dimensions, not {len(target)}")
        own = self.catalog[table]
        ties = list(own.primary_key) or [c for c, x in own.columns.items() if x.kind not in ("Vector", "JSON")]
        return vectors.nearest(self.rows(table, where), column, target, metric, paging.page_size(first, self.default_page, self.most_page), ties)
