"""Symbol, text and vector hits of one query, section by section."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.operators import fulltext, symbols, vectors
from loamdex.operators.textindex import TextIndex

SECTIONS = ("Symbols", "Text", "Semantic")


class Layer(NamedTuple):
    """A layer's rows, or why there are none: ok, disabled, unavailable or failed."""

    state: str
    rows: DataFrame | None = None
    reason: str = ""


def _section(rows: DataFrame, name: str, order: list, start: str, end: str, label, score) -> DataFrame:
    return rows.select(
        F.lit(name).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("ord"), "path", F.col(start).cast("int").alias("start_line"), F.col(end).cast("int").alias("end_line"), label.alias("label"), score.cast("double").alias("score")
    )


def search(
    lines: DataFrame | TextIndex, symbol_rows: DataFrame, text: str, limit: int = 8, points: DataFrame | None = None, query_vector: Sequence[float] | None = None, threshold: float = 0.0,
    include: str | Iterable[str] | None = None, exclude: str | Iterable[str] | None = None,
) -> DataFrame:
    """Every layer's ``limit`` best, one after the other; nothing is merged or ranked anew.

    The order within a section is numbered over at most ``limit`` rows.
    """
    by_name = symbols.search(symbol_rows, text, limit, include=include, exclude=exclude)
    by_text = lines.search(text, limit, include, exclude) if isinstance(lines, TextIndex) else fulltext.search(lines, text, limit, include, exclude)
    out = _section(by_name, "Symbols", [F.length("name"), "path", "start_line", "name", "kind"], "start_line", "end_line", F.concat_ws(" ", "kind", "name"), F.lit(None))
    out = out.unionByName(_section(by_text, "Text", ["score", "path", "line"], "line", "line", F.col("content"), F.col("score")))
    if points is not None and query_vector is not None:
        near = vectors.nearest(points, query_vector, limit, threshold, include=include, exclude=exclude)
        out = out.unionByName(_section(near, "Semantic", [F.col("score").desc(), "point_id"], "start_line", "end_line", F.col("preview"), F.col("score")))
    return out


def fused(sections: DataFrame, limit: int = 10, k: int = 60) -> DataFrame:
    """An extension: the sections' hits ranked together by reciprocal rank, a row a path and line."""
    return (
        sections.groupBy("path", "start_line").agg(F.sum(1.0 / (k + F.col("ord"))).alias("fused"), F.concat_ws("+", F.array_sort(F.collect_set("section"))).alias("sections"))
        .orderBy(F.col("fused").desc(), "path", "start_line").limit(limit)
    )
