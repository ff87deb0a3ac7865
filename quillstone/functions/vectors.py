"""Vector columns, evaluated in the JVM.

A usable vector is not empty, has finite numbers only and a positive length; ``unit`` scales it, and
gives null for anything else, so a later dot product is a cosine and a missing one counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def dot(u: Column, v: Column) -> Column:
    """Inner product of two vectors of one length."""
    return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def usable(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & F.forall(v, _finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: Column) -> Column:
    """The vector at length one; null if it is not usable."""
    scaled = F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: x / n))[0]
    return F.when(usable(v), scaled)


def cosine(u: Column, v: Column) -> Column:
    """Cosine of two plain vectors; 0 for unusable ones and different lengths."""
    return unit_cosine(unit(u), unit(v))


def unit_cosine(u: Column, v: Column) -> Column:
    """Cosine of two unit vectors (null for unusable ones)."""
    return F.coalesce(F.when(F.size(u) == F.size(v), dot(u, v)), F.lit(0.0))


def matrix_usable(m: Column) -> Column:
    """A list of vectors of one length, with finite numbers only."""
    first = F.size(F.get(m, F.lit(0)))
    return F.coalesce((F.size(m) > 0) & (first > 0) & F.forall(m, lambda v: (F.size(v) == first) & F.forall(v, _finite)), F.lit(False))


def mean_vector(m: Column) -> Column:
    """Mean of a list of vectors; null if the list is empty or ragged or has a non-number."""
    first = F.get(m, F.lit(0))
    total = F.aggregate(m, F.transform(first, lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(matrix_usable(m), F.transform(total, lambda x: x / F.size(m)))


def unit_matrix(m: Column) -> Column:
    """Every vector of the list at length one, a zero vector as it is; null if the list is not usable."""
    return F.when(matrix_usable(m), F.transform(m, lambda v: F.coalesce(unit(v), v)))


def best_pair(a: Column, b: Column) -> Column:
    """Largest inner product between two lists of unit vectors, never below 0."""
    same = F.size(F.get(a, F.lit(0))) == F.size(F.get(b, F.lit(0)))
    best = F.array_max(F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: dot(x, y)))))
    return F.coalesce(F.when(same, F.greatest(F.lit(0.0), best)), F.lit(0.0))
