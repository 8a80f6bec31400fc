"""Functions of array columns.

Everything is computed in double, element after element, whatever the arrays hold. Two
arrays of different lengths have dot product, distances and cosine 0 and no sum; a null
array gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | str


def _wide(v: Vector) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _paired(a: Vector, b: Vector, each) -> Column:
    """The sum of each(x, y), or 0 where the lengths differ."""
    a, b = _wide(a), _wide(b)
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(_fold(F.zip_with(a, b, each)))


def dims(v: Vector) -> Column:
    return F.size(F.col(v) if isinstance(v, str) else v)


def dot(a: Vector, b: Vector) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def norm(v: Vector) -> Column:
    return F.sqrt(_fold(F.transform(_wide(v), lambda x: x * x)))


def normalize(v: Vector) -> Column:
    """The unit vector; null for a zero vector."""
    n = norm(v)
    return F.when(n != 0, F.transform(_wide(v), lambda x: x / n))


def add(a: Vector, b: Vector) -> Column:
    a, b = _wide(a), _wide(b)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x + y))


def sub(a: Vector, b: Vector) -> Column:
    a, b = _wide(a), _wide(b)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x - y))


def scale(v: Vector, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(_wide(v), lambda x: x * by)


def equal_eps(a: Vector, b: Vector, eps: Column | float) -> Column:
    """Whether no two elements differ by more than eps; NaN differences don't count."""
    a, b = _wide(a), _wide(b)
    eps = eps if isinstance(eps, Column) else F.lit(float(eps))
    near = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: F.isnan(d) | (d <= eps))
    return F.when(F.size(a) != F.size(b), F.lit(False)).otherwise(near)


def equal(a: Vector, b: Vector) -> Column:
    return equal_eps(a, b, 1e-6)


def clone(v: Vector) -> Column:
    """Rows never change, so a copy is the column itself."""
    return F.col(v) if isinstance(v, str) else v


def cosine(a: Vector, b: Vector) -> Column:
    """Cosine similarity; 0 where the lengths differ or either norm is 0."""
    a, b = _wide(a), _wide(b)
    square = lambda v: _fold(F.transform(v, lambda x: x * x))
    length = F.sqrt(square(a) * square(b))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.when(length == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), length)))


def cosine_distance(a: Vector, b: Vector) -> Column:
    return F.lit(1.0) - cosine(a, b)


def euclidean(a: Vector, b: Vector) -> Column:
    return F.sqrt(_paired(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Vector, b: Vector) -> Column:
    return _paired(a, b, lambda x, y: F.abs(x - y))
