"""Foreign-key expansion: parents get a struct (to-one) or an array of structs (to-many) of related rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from heddle.plans.catalog import Relation


def _keys(columns: tuple[str, ...], prefix: str) -> list[SparkColumn]:
    return [F.col(f"`{c}`").alias(f"{prefix}{i}") for i, c in enumerate(columns)]


def only_related(children: DataFrame, parents: list[Row], relation: Relation) -> DataFrame:
    """Children of a page of parents, whose keys are part of the plan and so reach the file scan. NULL keys have no children."""
    types = [children.schema[c].dataType for c in relation.remote]
    keys = sorted({key for row in parents if None not in (key := tuple(row[c] for c in relation.local))})
    if not keys:
        return children.where(F.lit(False))
    columns = [F.col(f"`{c}`") for c in relation.remote]
    within = [c.isin([F.lit(v).cast(t) for v in sorted({k[i] for k in keys})]) for i, (c, t) in enumerate(zip(columns, types, strict=True))]
    if len(columns) > 1:
        whole = [F.struct(*(F.lit(v).cast(t).alias(f"c{i}") for i, (v, t) in enumerate(zip(key, types, strict=True)))) for key in keys]
        within.append(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))).isin(whole))
    return children.where(reduce(and_, within))


def _attach(parents: DataFrame, side: DataFrame, relation: Relation) -> DataFrame:
    condition = reduce(and_, [F.col(f"`{c}`") == F.col(f"__k{i}") for i, c in enumerate(relation.local)])
    return parents.join(side, condition, "left").drop(*(f"__k{i}" for i in range(len(relation.local))))


def to_one(parents: DataFrame, targets: DataFrame, relation: Relation, node: SparkColumn, name: str, unique: bool) -> DataFrame:
    """``name``: the target's node, or null without a match. Where the target's key isn't declared unique, the least node is taken."""
    side = targets.select(*_keys(relation.remote, "__k"), node.alias(name))
    if not unique:
        side = side.groupBy(*(f"__k{i}" for i in range(len(relation.remote)))).agg(F.min(name).alias(name))
    return _attach(parents, side, relation)


def ranked(children: DataFrame, relation: Relation, order: list[SparkColumn], limit: int, offset: int) -> DataFrame:
    """The rows offset < n <= offset + limit of each parent, with their number ``__rn``."""
    window = Window.partitionBy(*(F.col(f"`{c}`") for c in relation.remote)).orderBy(*order)
    n = F.col("__rn")
    return children.withColumn("__rn", F.row_number().over(window)).where((n > offset) & (n <= offset + limit))


def to_many(
    parents: DataFrame, children: DataFrame, relation: Relation, node: Callable[[DataFrame], DataFrame], node_type: str,
    name: str, order: list[SparkColumn], limit: int, offset: int,
) -> DataFrame:
    """``name``: an array of the parent's children in order, empty if there are none.

    node: adds a column ``__node`` to the numbered children.
    """
    empty = F.array().cast(f"array<{node_type}>")
    if limit == 0:
        return parents.withColumn(name, empty)
    side = node(ranked(children, relation, order, limit, offset)).select(*_keys(relation.remote, "__k"), F.struct("__rn", "__node").alias("__item"))
    side = side.groupBy(*(f"__k{i}" for i in range(len(relation.remote)))).agg(F.array_sort(F.collect_list("__item"), _by_number).alias("__items"))
    side = side.withColumn(name, F.transform("__items", lambda x: x["__node"])).drop("__items")
    return _attach(parents, side, relation).withColumn(name, F.coalesce(F.col(name), empty))


def _by_number(a: SparkColumn, b: SparkColumn) -> SparkColumn:
    return (a["__rn"] - b["__rn"]).cast("int")
