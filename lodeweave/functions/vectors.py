"""Vector similarities over array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def usable(v: Column) -> Column:
    """Neither null nor with null or non-finite parts."""
    return F.coalesce(F.forall(_doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to 0..1; 0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inner_product(a, b) / n)))


def closeness(a: Column, b: Column) -> Column:
    """1 / (1 + Euclidean distance)."""
    d = F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.sqrt(d))


SIMILARITIES = {"cosine": cosine, "ip": inner_product, "l2": closeness}
