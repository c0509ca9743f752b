"""Vector arithmetic as Columns. Elements are widened to double before any product and
summed from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def cosine_distance(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / scale)


def squared_l2_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def inner_product_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b)


DISTANCES = {"cosine": cosine_distance, "l2": squared_l2_distance, "ip": inner_product_distance}


def is_finite_vector(v: Column) -> Column:
    """Not null, not empty, and free of NaN and infinities."""
    bad = F.exists(v, lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def l2_normalize(v: Column) -> Column:
    """Scaled to unit length as floats; null where the norm is zero or not a number."""
    length = norm(v)
    return F.when((length != 0) & ~F.isnan(length), F.transform(_double(v), lambda x: x / length).cast("array<float>"))


def hash_bucket(token: Column, buckets: int = 128) -> Column:
    """Bucket of an ASCII token under the 31-polynomial string hash.

    The bucket count divides 2**32, so reducing in every step gives the same remainder as
    reducing the wrapped 32-bit hash once.
    """
    return F.aggregate(
        F.split(token, ""), F.lit(0), lambda h, ch: (h * 31 + F.ascii(ch)) % F.lit(buckets)
    )
