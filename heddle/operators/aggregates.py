"""Whole-filter aggregates; only what a request selects is computed, in one pass."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.scalars import InputError
from heddle.plans.catalog import Column

FUNCTIONS = {"sum": F.sum, "avg": lambda c: F.avg(c).cast("double"), "min": F.min, "max": F.max}


def _input(function: str, column: Column) -> SparkColumn:
    c = F.col(f"`{column.name}`")
    if function == "sum" and column.dtype.typeName() in ("byte", "short", "integer", "long"):
        return c.cast("decimal(38,0)")  # exact beyond 64 bits
    return c


def aggregate(rows: DataFrame, requested: Iterable[tuple[str, Column]], count: bool = True) -> DataFrame:
    """One row: ``count`` and a column function_column for each requested pair, however often it is asked for."""
    wanted = list(dict.fromkeys(requested))
    exprs = [F.count(F.lit(1)).alias("count")] if count or not wanted else []
    for function, column in wanted:
        if function not in FUNCTIONS:
            raise InputError(f"unknown aggregate {function!r}")
        if function in ("sum", "avg") and not column.numeric:
            raise InputError(f"{function} takes numeric columns; {column.name} is {column.kind}")
        exprs.append(FUNCTIONS[function](_input(function, column)).alias(f"{function}_{column.name}"))
    return rows.agg(*exprs)
