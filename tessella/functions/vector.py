"""Vector distances as built-in expressions; smaller is closer.

They are folds over zipped arrays, inside the JVM.  A null vector or vectors of
different length raise an error, as comparing them has no meaning; so does the
cosine distance of a zero vector.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double precision."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _checked(a: Column, b: Column, value: Column) -> Column:
    unlike = F.concat(F.lit("vector dimensions don't match (lhs="), F.size(a).cast("string"), F.lit(", rhs="), F.size(b).cast("string"), F.lit(")"))
    return F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("a vector distance needs two vectors, not NULL")).cast("double")).when(F.size(a) != F.size(b), F.raise_error(unlike).cast("double")).otherwise(value)


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))
    return _checked(a, b, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a) * dot(b, b))
    zero = F.raise_error(F.lit("cosine distance of a zero vector is undefined")).cast("double")
    return _checked(a, b, F.when(size == 0, zero).otherwise(1 - dot(a, b) / size))


def negated_dot(a: Column, b: Column) -> Column:
    return _checked(a, b, -dot(a, b))


METRICS = {"l2": l2, "cosine": cosine, "dot": negated_dot}
