"""Which scanned files are indexed: predicates over a relation of paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.functions import fixed
from loamdex.functions.globs import any_match, compiled
from loamdex.functions.text import file_name, lines_of, suffix


def language(path: Column) -> Column:
    """The language of a path's extension; null without one."""
    known = F.create_map(*[F.lit(x) for pair in fixed.LANGUAGE_OF.items() for x in pair])
    return F.element_at(known, F.when(suffix(path) == "", F.lit(None)).otherwise(suffix(path)))


def folders_kept(path: Column, patterns: Iterable[str] | None = None) -> Column:
    """No folder above the file is ignored by name, by a leading dot, or by a pattern."""
    above = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    bad = F.exists(above, lambda x: x.isin(*fixed.IGNORED_FOLDERS) | (x.startswith(".") & ~x.isin(*fixed.KEPT_DOT_FOLDERS)))
    folder_only = [e for e, folders in filter(None, map(compiled, patterns or ())) if folders]
    kept = ~bad
    for e in folder_only:
        parent = F.regexp_replace(path, r"/[^/]*$", "")
        kept = kept & ~(path.contains("/") & parent.rlike(e))
    return kept


def name_kept(path: Column) -> Column:
    name = F.lower(file_name(path))
    kept = ~name.isin(*fixed.IGNORED_NAMES)
    for part in fixed.MINIFIED_PARTS:
        kept = kept & ~name.contains(part)
    return kept


def extension_kept(path: Column) -> Column:
    return suffix(path).isin(*fixed.TEXT_EXTENSIONS) | F.lower(file_name(path)).isin(*fixed.TEXT_NAMES)


def parts_kept(path: Column, more: Iterable[str] = ()) -> Column:
    low = F.lower(path)
    kept = F.lit(True)
    for part in (*fixed.IGNORED_PARTS, *(p.lower() for p in more)):
        kept = kept & ~low.contains(part)
    return kept


def size_kept(path: Column, size: Column, doc_bytes: int = fixed.MAX_DOC_BYTES) -> Column:
    return size <= F.when(suffix(path).isin(*fixed.DOC_EXTENSIONS), F.lit(doc_bytes)).otherwise(F.lit(fixed.MAX_FILE_BYTES))


def no_long_line(text: Column) -> Column:
    return ~F.exists(lines_of(text), lambda x: F.length(x) > fixed.MAX_LINE_CHARS)


def long_lined(lines: DataFrame, most: int = fixed.MAX_LINE_CHARS) -> DataFrame:
    """The paths of files with a line of more than ``most`` characters."""
    return lines.groupBy("path").agg(F.max(F.length(F.coalesce("content", F.lit("")))).alias("_n")).where(F.col("_n") > most).select("path")


def decoded(content: Column) -> Column:
    """Bytes as text: null for binary content (a zero byte early on); bad UTF-8 is replaced, as the tree source does."""
    binary = F.locate("\x00", F.substring(content, 1, fixed.BINARY_PROBE_BYTES).cast("string")) > 0
    return F.when(binary, F.lit(None)).otherwise(F.make_valid_utf8(content.cast("string")))


def indexable(files: DataFrame, patterns: Iterable[str] | None = None) -> DataFrame:
    """The files of a scan that are indexed; ``path`` is relative to the root."""
    p = F.col("path")
    return files.where(folders_kept(p, patterns) & name_kept(p) & extension_kept(p) & parts_kept(p) & ~any_match(p, patterns) & size_kept(p, F.col("size")))


def relevant_event(path: Column) -> Column:
    """Whether a file-system event can concern the index (sizes and patterns are not asked)."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return ~F.exists(parts, lambda x: x.isin(*fixed.IGNORED_FOLDERS)) & extension_kept(F.regexp_replace(path, r"\\", "/"))
