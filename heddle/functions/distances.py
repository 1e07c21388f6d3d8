"""Vector distances as higher-order expressions; all arithmetic in doubles, no UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _array(target: list[float]) -> Column:
    return F.array(*(F.lit(float(y)) for y in target)).cast("array<double>")


def _double(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, target: list[float]) -> Column:
    return _sum(F.zip_with(a, _array(target), lambda x, y: _double(x) * y))


def cosine(a: Column, target: list[float]) -> Column:
    """NULL where either vector is zero. The target's norm is a constant of the plan."""
    norm = F.sqrt(_sum(F.transform(a, lambda x: _double(x) * _double(x))))
    return F.lit(1.0) - F.try_divide(dot(a, target), norm * F.lit(math.sqrt(sum(y * y for y in target))))


def l2(a: Column, target: list[float]) -> Column:
    return F.sqrt(_sum(F.zip_with(a, _array(target), lambda x, y: (_double(x) - y) * (_double(x) - y))))


def l1(a: Column, target: list[float]) -> Column:
    return _sum(F.zip_with(a, _array(target), lambda x, y: F.abs(_double(x) - y)))


def negative_inner_product(a: Column, target: list[float]) -> Column:
    return -dot(a, target)


METRICS = {"COSINE": cosine, "L2": l2, "L1": l1, "INNER_PRODUCT": negative_inner_product}
