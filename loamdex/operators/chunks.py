"""Windows of lines, for embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.functions.fixed import OVERLAP_LINES, PREVIEW_CHARS, WINDOW_LINES
from loamdex.functions.text import lines_of, url_uuid


def windows(files: DataFrame, text: str = "text", window: int = WINDOW_LINES, overlap: int = OVERLAP_LINES) -> DataFrame:
    """Overlapping windows of each text: (..., start_line, end_line, chunk); blank ones are left out.

    A text of n lines has one window up to ``window`` lines, else one more for each
    further ``window - overlap`` lines.
    """
    step = max(1, window - overlap)
    rest = [c for c in files.columns if c != text]
    have = files.select(*rest, lines_of(F.col(text)).alias("_lines")).where(F.size("_lines") > 0)
    n = F.size("_lines")
    last = (F.greatest(F.lit(0), F.ceil((n - window) / F.lit(float(step)))) * step).cast("int")
    rows = have.withColumn("_at", F.explode(F.sequence(F.lit(0), last, F.lit(step))))
    end = F.least(F.col("_at") + window, n)
    return (
        rows.select(*rest, (F.col("_at") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("_lines", F.col("_at") + 1, end - F.col("_at")), "\n").alias("chunk"))
        .where(F.col("chunk").rlike(r"(?U)\S"))
    )


def point_id(path, start, end):
    """The identity of a window's point."""
    return url_uuid(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def points(chunks: DataFrame) -> DataFrame:
    """Windows with their identity and preview."""
    return chunks.withColumn("point_id", point_id(F.col("path"), F.col("start_line"), F.col("end_line"))).withColumn("preview", F.substring("chunk", 1, PREVIEW_CHARS))
