"""Vector expressions for pairs that are already joined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(_dot(vector, vector))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null for a zero vector or unequal lengths.

    Scores one joined pair per row. Searching goes through
    ``vitaeflow.operators.similarity``, which never forms the pairs.
    """
    return _dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
