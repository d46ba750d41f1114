"""Cutting oversized texts into pieces below a limit, at natural boundaries.

``split_text`` places balanced targets: the least number of pieces that can
hold the text gives equal-length targets, each of which snaps to the strongest
boundary near it; when a piece is over the limit, its overlap included, one more
piece is tried (beyond 512 pieces, one more in 256). Defined results:

* a text within the limit is one piece; a null or empty text has no piece;
* every piece has at most ``limit`` characters (code points) and the pieces,
  without their overlaps, join to the text again;
* a piece starts with the last ``overlap_lines`` lines of the piece before wherever
  those and one new line are within the limit; a piece that gets too long by them is
  cut again. Elsewhere it starts with as many of them as half of the limit holds,
  with none inside a line that is itself over half of the limit;
* ``start_line`` of the first piece is the row's; a line inside which a cut falls
  belongs to both pieces. Previews with more lines than their span end at
  ``end_line``; a null ``start_line`` counts as 1;
* equal rows count once. The limit is that of the language of the path's current
  row in the files table, of ``other`` where the language is null, unlisted or
  the path unknown; without such a row there is no limit.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.byfile import packed

OTHER = "other"
NEAR = 0.3
_SENTENCE = re.compile(r"[.!?;:。！？；]['\")\]]*\s+")
_SPACE = re.compile(r"\s+")


def boundaries(text: str) -> tuple[list[int], list[float]]:
    """Positions between lines where a piece may end, and how natural each is.

    A blank line above an unindented line is the strongest, then a blank line,
    an unindented line, a closed block, any line's end.
    """
    at, strength = [], []
    pos = text.find("\n")
    begin = 0
    while pos >= 0:
        end = pos + 1
        if end >= len(text):
            break
        line, after = text[begin:pos], text[end : end + 1]
        flush = not after.isspace() and after not in ")]}"
        if after == "\n" or (after == "\r" and text[end + 1 : end + 2] == "\n"):
            value = 1.0
        elif not line.strip():
            value = 5.0 if flush else 3.5
        elif flush:
            value = 3.0
        elif line.rstrip().endswith(("}", "]", ")", ";", ".")):
            value = 1.8
        else:
            value = 1.2
        at.append(end)
        strength.append(value)
        begin, pos = end, text.find("\n", end)
    return at, strength


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part what is written together."""
    c, before = text[at], text[at - 1]
    return unicodedata.combining(c) > 0 or c in "‍️" or before == "‍" or (before == "\r" and c == "\n") or "\U0001f3fb" <= c <= "\U0001f3ff" or "\U000e0020" <= c <= "\U000e007f"


def _snap(text: str, target: float, low: int, high: int, at: list[int], strength: list[float], radius: float) -> int:
    """The best place for a cut in [low, high] close to ``target``."""
    best, score = -1, -1.0
    for k in range(bisect_left(at, max(low, target - radius)), bisect_right(at, min(high, target + radius))):
        s = strength[k] - 2.5 * abs(at[k] - target) / radius
        if best < 0 or s > score:
            best, score = at[k], s
    if best >= 0:
        return best
    a, b = int(max(low, target - radius)), int(min(high, target + radius))
    for pattern in (_SENTENCE, _SPACE):
        found = [a + m.end() for m in pattern.finditer(text[a:b]) if low <= a + m.end() <= high]
        if found:
            return min(found, key=lambda p: abs(p - target))
    cut = min(max(int(target), low), high)
    while cut > low and _joined(text, cut):
        cut -= 1
    return cut


def _overlap_from(starts: list[int], cut: int, lines: int, most: int) -> int:
    """Where the repeated lines before ``cut`` begin."""
    k = bisect_left(starts, cut) - 1
    first = cut
    for i in range(k, max(-1, k - lines), -1):
        if cut - starts[i] > most:
            break
        first = starts[i]
    return first


def _with_overlaps(text: str, limit: int, lines: int, ends: list[int], at: list[int], strength: list[float]) -> list[tuple[int, int, int]]:
    """The pieces up to ``ends`` with their overlaps; pieces too long with all given lines are cut again."""
    starts = [0, *at]
    pieces, begin = [], 0
    for end in ends:
        while begin < end:
            k = bisect_right(at, begin)
            new = at[k] if k < len(at) else len(text)
            first, low = _overlap_from(starts, begin, lines, limit) if begin else 0, new
            if new - first > limit or (first == begin and lines) or _overlap_from(starts, begin, lines, len(text)) != first:
                first, low = _overlap_from(starts, begin, lines, limit // 2) if begin else 0, begin + 1
            to = end
            if end - first > limit:
                high = first + limit
                target = begin + (end - begin) / -(-(end - begin) // (high - begin))
                to = _snap(text, target, low, high, at, strength, max(1.0, NEAR * (high - begin), target - low))
            pieces.append((first, begin, to))
            begin = to
    return pieces


def split_text(text: str, limit: int, overlap_lines: int = 0) -> list[tuple[int, int, int]]:
    """(start with overlap, start without, end) of each piece."""
    n = len(text)
    if not n:
        return []
    if n <= limit:
        return [(0, 0, n)]
    limit, overlap_lines = max(1, limit), max(0, overlap_lines or 0)
    at, strength = boundaries(text)
    starts = [0, *at]
    count = -(-n // limit)
    while True:
        step = n / count
        cuts: list[int] = []
        begin = 0
        for j in range(1, count + 1):  # stops at the first piece over the limit
            end = _snap(text, j * step, begin + 1, n - (count - j), at, strength, max(1.0, NEAR * step)) if j < count else n
            if end - (_overlap_from(starts, begin, overlap_lines, limit // 2) if begin else 0) > limit:
                break
            cuts.append(end)
            begin = end
        if len(cuts) == count:
            cuts.pop()
            return _with_overlaps(text, limit, overlap_lines, [*cuts, n], at, strength)
        if count >= n:  # one character a piece: only overlaps can be in the way
            return _with_overlaps(text, limit, overlap_lines, [*range(limit, n, limit), n], at, strength)
        count = min(n, count + max(1, count // 256))


def pieces_of(preview: str, start_line: int | None, end_line: int | None, limit: int | None, overlap: int | None) -> Iterator[tuple]:
    """(piece, pieces, start_line, end_line, overlap_chars, text) of each piece."""
    start_line = 1 if start_line is None else start_line
    spans = split_text(preview, len(preview) if limit is None else limit, overlap or 0)
    newlines = [m.start() for m in re.finditer("\n", preview)]
    last = start_line + len(newlines) if end_line is None or end_line < start_line else end_line
    for k, (first, begin, end) in enumerate(spans):
        a = min(start_line + bisect_left(newlines, first), last)
        b = min(start_line + bisect_left(newlines, max(first, end - 1)), last)
        yield k, len(spans), a, b, begin - first, preview[first:end]


SCHEMA = "hit_id bigint, path string, piece int, pieces int, start_line int, end_line int, overlap_chars int, text string"
_ARROW = pa.schema([("hit_id", pa.int64()), ("path", pa.string()), ("piece", pa.int32()), ("pieces", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("overlap_chars", pa.int32()), ("text", pa.string())])


def split_hits(hits: DataFrame, files: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every preview of ``hits``.

    ``limits`` has one row a language (a few at any size of the corpus), so it is
    broadcast; the language of a path comes by a shuffle join.
    """
    lang = files.where(F.col("path").isNotNull()).groupBy("path").agg(F.max_by("lang", F.col("mtime")).alias("_lang"))
    by_lang = limits.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.min("max_chars").alias("max_chars"), F.first("overlap_lines").alias("overlap_lines"))
    listed = by_lang.select(F.col("lang").alias("_lang"), F.col("max_chars").alias("_max"), F.col("overlap_lines").alias("_over"))
    other = by_lang.where(F.col("lang") == OTHER).select(F.lit(OTHER).alias("_other"), F.col("max_chars").alias("_omax"), F.col("overlap_lines").alias("_oover"))
    rows = (
        hits.select("hit_id", "path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "preview")
        .where(F.col("preview").isNotNull())
        .distinct()
        .join(lang, "path", "left")
        .join(F.broadcast(listed), "_lang", "left")
        .withColumn("_other", F.lit(OTHER))
        .join(F.broadcast(other), "_other", "left")
        .select("hit_id", "path", "start_line", "end_line", "preview", F.coalesce("_max", "_omax").cast("int").alias("max_chars"), F.when(F.col("_max").isNotNull(), F.col("_over")).otherwise(F.col("_oover")).cast("int").alias("overlap_lines"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for batch in batches:
                for hit, path, start, end, preview, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                    for piece in pieces_of(preview, start, end, limit, overlap):
                        yield (hit, path, *piece)

        yield from packed(out(), _ARROW)

    return rows.mapInArrow(run, SCHEMA)


def found(pieces: DataFrame) -> DataFrame:
    """The hits that had to be cut."""
    return pieces.where(F.col("pieces") > 1).select("hit_id").distinct()
