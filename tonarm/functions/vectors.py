"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonarm.functions.stem import once


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """v / max(|v|, eps): a zero vector stays zero. The norm is computed once, not for each element."""
    return once(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def unit_dot(unit: Column, v: Column, eps: float = 1e-12) -> Column:
    """The inner product of a vector of length one and v scaled to length one, without scaling it."""
    return dot(unit, v) / F.greatest(norm(v), F.lit(eps))


def align(v: Column, size: int | Column) -> Column:
    """Cut to size, or filled up with zeros."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.slice(F.concat(v, F.array_repeat(F.lit(0).cast("float"), size)), F.lit(1), size)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))
