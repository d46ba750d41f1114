"""Source trees as a Spark data source: a row for each file, decoded on the executors.

``spark.read.format("source_tree").load(root)``, after ``register``. Folders are split
into their files and their subfolders, widest first, until there are ``parts`` (64)
partitions, so a tree below one large folder is read by many tasks, too. Folders are pruned while walking; unlike Spark's own file
sources it sees names with a leading underscore or dot, and keeps the exact mtime.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loamdex.functions import fixed
from loamdex.functions.globs import compiled

SCHEMA = "path string, mtime double, size bigint, lang string, text string"


def read_gitignore(root: str) -> list[str]:
    """The patterns of the root's .gitignore; comments, blanks and negations are left out."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
            return [s for s in map(str.strip, f) if s and s[0] not in "#!"]
    except OSError:
        return []


def name_suffix(name: str) -> str:
    return os.path.splitext(name)[1].lower()


class Walk:
    """What a walk keeps."""

    def __init__(self, patterns: list[str], doc_bytes: int = fixed.MAX_DOC_BYTES):
        import re

        both = [c for c in map(compiled, patterns) if c]
        self.files = [re.compile(e) for e, folders in both if not folders]
        self.folders = [re.compile(e) for e, _ in both]
        self.doc_bytes = doc_bytes

    def folder(self, name: str, path: str) -> bool:
        if name in fixed.IGNORED_FOLDERS or (name.startswith(".") and name not in fixed.KEPT_DOT_FOLDERS):
            return False
        return not any(e.match(path) for e in self.folders)

    def file(self, name: str, path: str, size: int) -> bool:
        low, end = name.lower(), name_suffix(name)
        if low in fixed.IGNORED_NAMES or any(m in low for m in fixed.MINIFIED_PARTS):
            return False
        if end not in fixed.TEXT_EXTENSIONS and low not in fixed.TEXT_NAMES:
            return False
        if any(p in path.lower() for p in fixed.IGNORED_PARTS) or any(e.match(path) for e in self.files):
            return False
        return size <= (self.doc_bytes if end in fixed.DOC_EXTENSIONS else fixed.MAX_FILE_BYTES)


def decode(data: bytes) -> str | None:
    """Text of a file; None if binary or with a line too long to be source."""
    if b"\x00" in data[: fixed.BINARY_PROBE_BYTES]:
        return None
    text = data.decode("utf-8", errors="replace")
    return None if any(len(x) > fixed.MAX_LINE_CHARS for x in text.splitlines()) else text


class _Part(InputPartition):
    """A folder relative to the root: all below it, or the files in it alone."""

    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"])
        patterns = [p for p in options.get("ignore", "").split("\n") if p.strip()]
        if options.get("usegitignore", "true").lower() in ("1", "true", "yes", "on"):
            patterns += read_gitignore(self.root)
        self.patterns, self.parts = patterns, int(options.get("parts", 64))

    def partitions(self):
        walk, split, waiting = Walk(self.patterns), [], [""]
        while waiting and len(split) + len(waiting) < self.parts:
            folder = waiting.pop(0)
            split.append(folder)
            try:
                with os.scandir(os.path.join(self.root, folder)) as entries:
                    names = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))
            except OSError:
                continue
            below = [f"{folder}/{n}" if folder else n for n in names]
            waiting += [b for b, n in zip(below, names) if walk.folder(n, b)]
        return [_Part(f, False) for f in split] + [_Part(f, True) for f in waiting]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        walk = Walk(self.patterns)
        schema = pa.schema([("path", pa.string()), ("mtime", pa.float64()), ("size", pa.int64()), ("lang", pa.string()), ("text", pa.string())])
        rows: list[tuple] = []
        held = 0
        for path in self._paths(partition, walk):
            full = os.path.join(self.root, path)
            try:
                st = os.stat(full)
                if not walk.file(os.path.basename(path), path, st.st_size):
                    continue
                with open(full, "rb") as f:
                    text = decode(f.read())
            except OSError:
                continue
            rows.append((path, st.st_mtime, st.st_size, fixed.LANGUAGE_OF.get(name_suffix(os.path.basename(path))), text))
            held += st.st_size
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def _paths(self, part: _Part, walk: Walk) -> Iterator[str]:
        for folder, names, files in os.walk(os.path.join(self.root, part.folder)):
            rel = os.path.relpath(folder, self.root).replace(os.sep, "/")
            below = "" if rel == "." else rel + "/"
            names[:] = sorted(n for n in names if walk.folder(n, below + n)) if part.deep else []
            yield from (below + f for f in sorted(files))


class SourceTree(DataSource):
    """The registered source."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in dict(self.options).items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
