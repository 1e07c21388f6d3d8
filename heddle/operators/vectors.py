"""Nearest neighbours by exact distance; the k best rows are merged from each partition's k best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.distances import METRICS
from heddle.functions.scalars import InputError
from heddle.plans.catalog import Column


def nearest(rows: DataFrame, column: Column, to: list[float], metric: str, k: int, tie_break: list[str]) -> DataFrame:
    """The k rows least distant from ``to``, with ``distance``; ties are broken by key.

    Rows whose vector is NULL, of another dimension, or without a distance (zero vectors under COSINE) are left out.
    """
    if metric not in METRICS:
        raise InputError(f"unknown metric {metric!r}")
    c = F.col(f"`{column.name}`")
    distance = F.when(F.size(c) == len(to), METRICS[metric](c, [float(x) for x in to]))
    near = rows.where(c.isNotNull()).withColumn("distance", distance).orderBy(F.col("distance").asc_nulls_last(), *(F.col(f"`{t}`") for t in tie_break))
    # rows without a distance come last, so they are dropped behind the limit: a test before it would compute every distance twice
    return near.limit(k).where(F.col("distance").isNotNull())
