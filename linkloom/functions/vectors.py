"""Vector functions on array columns; sums are made in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def doubles(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a vector is missing or has no length. Vectors of different size raise an error."""
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different size")).cast("double"))
    return F.coalesce(same, F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def linear_score(features: Sequence[Column], weights: Sequence[float]) -> Column:
    """Sum of weight times feature; features beyond the model count nothing."""
    out = F.lit(0.0)
    for x, w in zip(features, weights):
        out = out + x * F.lit(float(w))
    return out


def feature_products(names: Sequence[str]) -> list[tuple[str, Column]]:
    """COMBO_a_b for every pair of features, in order."""
    return [
        (f"COMBO_{a}_{b}", F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i + 1 :]
    ]


def top_two_confidence(first: Column, second: Column) -> Column:
    """Softmax share of the best of two scores; 1 without a second."""
    return F.coalesce(1 / (1 + F.exp(second - first)), F.lit(1.0))
