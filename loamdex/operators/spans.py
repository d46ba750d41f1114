"""Reading spans of lines from the index or, live, from the tree."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.functions.fixed import MAX_FILE_BYTES
from loamdex.sources.tree import decode


def bounds(start: int, end: int, context: int = 0) -> tuple[int, int]:
    start = max(1, start)
    end = max(start, end)
    return max(1, start - max(0, context)), end + max(0, context)


def lines_between(lines: DataFrame, path: str, start: int, end: int, context: int = 0) -> DataFrame:
    """The lines of a span with its context; the bounds are inclusive and reach the scan."""
    low, high = bounds(start, end, context)
    return lines.where((F.col("path") == path) & F.col("line").between(low, high)).select("path", "line", F.coalesce("content", F.lit("")).alias("content")).distinct().orderBy("line")


def span_text(lines: DataFrame, path: str, start: int, end: int, context: int = 0) -> DataFrame:
    """The span as one row: (path, body)."""
    rows = lines_between(lines, path, start, end, context)
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("body"))


def live_span(root: str, relative: str, start: int, end: int, context: int = 0) -> str | None:
    """The span from the file itself; None if it cannot be read as source text or lies outside of the root."""
    base = os.path.realpath(root)
    path = os.path.realpath(os.path.join(base, relative))
    if os.path.commonpath([base, path]) != base:
        return None
    try:
        if not os.path.isfile(path) or os.path.getsize(path) > MAX_FILE_BYTES:
            return None
        text = decode(Path(path).read_bytes())
    except OSError:
        return None
    if text is None:  # binary, or with a line too long to be source
        return None
    have = text.splitlines()
    low, high = bounds(start, end, context)
    return "\n".join(have[low - 1 : high])


def read_span(lines: DataFrame, root: str | None, path: str, start: int, end: int, context: int = 0) -> str:
    """A span as text under a header; the index stands in where the file cannot be read."""
    low, high = bounds(start, end, context)
    body = live_span(root, path, start, end, context) if root else None
    note = ""
    if body is None:
        rows = span_text(lines, path, start, end, context).take(1)
        body, note = (rows[0]["body"] if rows else ""), " (from index)"
    return f"{path}:{low}-{high}{note}\n{body}" if body else f"{path}:{low}-{high}{note}: no lines"
