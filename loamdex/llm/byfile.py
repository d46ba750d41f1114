"""Whole files, one at a time, from tables that hold their rows scattered.

Lines, versions and symbols of a file are brought together by one shuffle on
``path`` and one sort, and stream through a Python worker in Arrow batches. A
task holds one file at a time, never a service or a bucket.

The text of a file is its distinct lines in order of ``line``, joined by one
newline. A null content is a blank line. Rows without path or line belong to no
file and are left out; equal rows count once; two different contents under one
line number both stay, in order of content. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE, LINE, SYMBOL = 0, 1, 2


class Version(NamedTuple):
    """A row of ``files``."""

    mtime: float
    size: int
    lang: str | None


class Symbol(NamedTuple):
    name: str
    kind: str
    start: int
    end: int


class SourceFile(NamedTuple):
    path: str
    service: str | None
    versions: list[Version]
    numbers: list[int]
    lines: list[str]
    symbols: list[Symbol]

    @property
    def text(self) -> str:
        return "\n".join(self.lines)

    @property
    def current(self) -> Version | None:
        """The row with the greatest mtime; ties go to the greatest size, then language."""
        return max(self.versions, key=lambda v: (v.mtime, v.size, v.lang or ""), default=None)


def _rows(kind: int, df: DataFrame, **columns) -> DataFrame:
    empty = {"service": "string", "line": "int", "end": "bigint", "content": "string", "name": "string", "num": "double"}
    return df.where(F.col("path").isNotNull()).select(
        F.col("path").cast("string").alias("path"),
        F.lit(kind).cast("tinyint").alias("part"),
        *((columns[c] if c in columns else F.lit(None)).cast(t).alias(c) for c, t in empty.items()),
    )


def gathered(lines: DataFrame | None = None, files: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """The rows of the given tables, each file's together and in order."""
    parts = []
    if files is not None:
        parts.append(_rows(FILE, files, service=F.col("service_id"), num=F.col("mtime"), end=F.col("size"), content=F.col("lang")))
    if lines is not None:
        parts.append(_rows(LINE, lines.where(F.col("line").isNotNull()), service=F.col("service_id"), line=F.col("line"), content=F.col("content")))
    if symbols is not None:
        parts.append(_rows(SYMBOL, symbols.where(F.col("start_line").isNotNull()), line=F.col("start_line"), end=F.col("end_line"), content=F.col("kind"), name=F.col("name")))
    df = parts[0]
    for more in parts[1:]:
        df = df.unionByName(more)
    h = F.xxhash64("path")
    return df.repartition("path").sortWithinPartitions(h, "path", "part", "line", "content")


def source_files(batches: Iterable[pa.RecordBatch]) -> Iterator[SourceFile]:
    """The files of a partition of ``gathered``, one after the other."""
    path, held = None, []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        paths = batch.column(0)
        cuts = [0]
        if n > 1:
            cuts += [i + 1 for i in pc.indices_nonzero(pc.not_equal(paths[1:], paths[:-1])).to_pylist()]
        cuts.append(n)
        columns = [c.to_pylist() for c in batch.columns[1:]]
        for a, b in zip(cuts, cuts[1:]):
            p = paths[a].as_py()
            if p != path:
                if held:
                    yield _file(path, held)
                path, held = p, []
            held.append([c[a:b] for c in columns])
    if held:
        yield _file(path, held)


def _file(path: str, held: list[list[list]]) -> SourceFile:
    part, service, line, end, content, name, num = held[0] if len(held) == 1 else [sum((h[k] for h in held), []) for k in range(7)]
    a = part.count(FILE)
    b = len(part) - part.count(SYMBOL)
    versions = [Version(num[i] if num[i] is not None else float("-inf"), end[i] if end[i] is not None else -1, content[i]) for i in range(a)]
    numbers, text = line[a:b], content[a:b]
    if len(set(numbers)) < len(numbers):
        pairs = list(dict.fromkeys((n, c or "") for n, c in zip(numbers, text)))
        numbers, text = [n for n, _ in pairs], [c for _, c in pairs]
    elif None in text:
        text = [c or "" for c in text]
    symbols = []
    if b < len(part):
        symbols = list(dict.fromkeys(Symbol(name[i] or "", content[i] or "", line[i], end[i] if end[i] is not None else line[i]) for i in range(b, len(part))))
    owner = next((s for s in service if s is not None), None)
    return SourceFile(path, owner, versions, numbers, text, symbols)


def per_file(rows: DataFrame, work: Callable[[SourceFile], Iterable[tuple]], schema: str, fields: list[tuple[str, pa.DataType]], setup: Callable[[], None] | None = None) -> DataFrame:
    """Rows ``work`` gives for each file of ``gathered`` rows."""
    return each_partition(rows, lambda files: (row for f in files for row in work(f)), schema, fields, setup)


def each_partition(rows: DataFrame, work: Callable[[Iterator[SourceFile]], Iterable[tuple]], schema: str, fields: list[tuple[str, pa.DataType]], setup: Callable[[], None] | None = None) -> DataFrame:
    """Like ``per_file``, for work that shares something between the files of a partition."""
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup:
            setup()
        yield from packed(work(source_files(batches)), arrow)

    return rows.mapInArrow(run, schema)


def packed(rows: Iterable[tuple], schema: pa.Schema, rows_each: int = 4096, chars_each: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of bounded size."""
    out, chars = [], 0
    for row in rows:
        out.append(row)
        chars += sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
        if len(out) >= rows_each or chars >= chars_each:
            yield _batch(out, schema)
            out, chars = [], 0
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
