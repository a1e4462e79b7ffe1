"""Vector functions as Catalyst expressions, plus the JSON form of a vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(v: Column) -> Column:
    """Non-empty with finite, non-null values only; null gives false."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & fine, F.lit(False))


def is_usable(v: Column, model: Column, current: str, dims: int) -> Column:
    """A vector of the current model with the right length and at least one value that isn't zero."""
    return F.coalesce((model == current) & (F.size(v) == dims) & is_valid(v) & F.exists(v, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine in [-1, 1]; null where the lengths differ or a norm is zero. Norms may be given precomputed."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    ok = (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb))))


def to_json_text(v: Column) -> Column:
    """Compact JSON; an invalid vector raises."""
    return F.when(v.isNull(), F.lit(None).cast("string")).when(is_valid(v), F.to_json(v)).otherwise(F.raise_error(F.lit("invalid embedding")).cast("string"))


def from_json_text(s: Column) -> Column:
    """The vector a JSON text holds; anything invalid gives null, never an error."""
    v = F.from_json(s, "array<double>")
    return F.when(is_valid(v), v)


def preview(v: Column, n: int = 8) -> Column:
    return F.slice(v, 1, n)
