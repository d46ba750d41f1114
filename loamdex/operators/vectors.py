"""Exact nearest vectors by cosine."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.functions.fixed import OVERFETCH
from loamdex.functions.globs import path_filter


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def with_norms(points: DataFrame, vector: str = "embedding") -> DataFrame:
    """Stores each vector's length once, so that a search multiplies only."""
    return points.withColumn("norm", norm(F.col(vector)))


def cosine(points: DataFrame, query: Sequence[float], vector: str = "embedding") -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(float(x) ** 2 for x in query) ** 0.5
    own = F.col("norm") if "norm" in points.columns else norm(F.col(vector))
    return F.when((own > 0) & F.lit(length > 0), dot(F.col(vector), q) / (own * F.lit(length))).otherwise(F.lit(0.0))


def nearest(
    points: DataFrame, query: Sequence[float], limit: int = 10, threshold: float = 0.0, key: str = "point_id", vector: str = "embedding",
    include: str | Iterable[str] | None = None, exclude: str | Iterable[str] | None = None, parity: bool = False,
) -> DataFrame:
    """The ``limit`` points closest to a vector, with their ``score``; ties go to the least key.

    A threshold of 0 is none. Null vectors are left out.
    """
    limit = 1 if limit < 0 else limit
    rows = points.where(F.col(vector).isNotNull()).withColumn("score", cosine(points, query, vector))
    order = (F.col("score").desc(), F.col(key))
    keep = path_filter(F.col("path"), include, exclude) if include or exclude else F.lit(True)
    if parity and (include or exclude):
        rows = rows.orderBy(*order).limit(limit * OVERFETCH)
    if threshold:
        rows = rows.where(F.col("score") >= threshold)
    return rows.where(keep).drop(vector, "norm").orderBy(*order).limit(limit)
