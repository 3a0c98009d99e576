"""Vector functions as Column expressions: everything stays in the JVM.

Distances are summed in double precision over FLOAT32 elements. They serve for ordering; scores are not part of a result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FLT_MAX = (2 - 2**-23) * 2.0**127


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; of two empty vectors 0."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance: its order is that of the distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm_squared(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def normalizable(a: Column) -> Column:
    """Whether a vector has a direction: not null, finite, not all zero, and its squared norm is a finite FLOAT32."""
    n = norm_squared(a)
    return F.coalesce((n > 0) & ~F.isnan(n) & (n <= F.lit(FLT_MAX)), F.lit(False))


def finite(a: Column) -> Column:
    return F.coalesce(F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def normalize(a: Column) -> Column:
    """The vector at length 1, as FLOAT32; null where it has no direction."""
    n = F.sqrt(norm_squared(a))
    return F.when(normalizable(a), F.transform(a, lambda x: (x.cast("double") / n).cast("float")))


def cosine_similarity(a: Column, query: Sequence[float]) -> Column:
    """Similarity with a fixed query of known direction; null where a has none."""
    length = math.sqrt(math.fsum(float(x) ** 2 for x in query))
    unit = vector_literal([x / length for x in query])
    return F.when(normalizable(a), dot(a, unit) / F.sqrt(norm_squared(a)))


def has_direction(query: Sequence[float]) -> bool:
    n = math.fsum(float(x) ** 2 for x in query)
    return math.isfinite(n) and 0 < n <= FLT_MAX
