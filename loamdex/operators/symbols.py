"""Search over the symbol table and outlines of files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.functions.fixed import OVERFETCH
from loamdex.functions.globs import path_filter
from loamdex.functions.text import contains_like

HIT = ("path", "name", "kind", "start_line", "end_line")


def search(symbols: DataFrame, name: str, limit: int = 30, exact: bool = False, include: str | Iterable[str] | None = None, exclude: str | Iterable[str] | None = None, parity: bool = False) -> DataFrame:
    """Symbols of a name, or with the text in their name (shortest names first).

    The exact form is case-sensitive and reaches the scan; the other folds ASCII
    case, and ``%`` and ``_`` in it are wild.
    """
    limit = 1 if limit < 0 else limit
    keep = path_filter(F.col("path"), include, exclude)
    rows = symbols.select(*HIT)
    if exact:
        rows, order = rows.where(F.col("name") == name), ("path", "start_line", "end_line", "kind")
    else:
        rows, order = rows.where(contains_like(F.col("name"), name)), (F.length("name"), "path", "start_line", "name", "kind")
    if parity and (include or exclude):
        return rows.orderBy(*order).limit(limit * OVERFETCH).where(keep).orderBy(*order).limit(limit)
    return rows.where(keep).orderBy(*order).limit(limit)


def outline(symbols: DataFrame, path: str) -> DataFrame:
    """The symbols of a file in order of their start."""
    return symbols.where(F.col("path") == path).select(*HIT).orderBy("start_line", "end_line", "name", "kind")
