"""Mixing sources to target weights by systematic sampling.

The mix is as large as the rarest source allows: its total is the least of
``max_repeats * tokens / share`` over the listed sources that have tokens, with
shares taken anew over those (a listed source without documents gets nothing, so
the others keep their proportions). Each document of a source then has the same
expected number of copies, at most ``max_repeats``. Expected copies are summed
up in order within the source, one random offset a source is added, and a copy
is emitted for each integer boundary a document's interval crosses; so every
document appears floor or ceil of its expectation.

Documents stand in order of size (in quarter octaves), then of a hash of their
id, so that each size is sampled at the same rate and the shares come out close.
They are not summed in one task: size and hash deal them to buckets of about
``BUCKET_ROWS`` documents, as many as a size of a source needs, buckets are
summed apart, and the sums of the buckets before
it shift each bucket. Ties of the hash are ordered by id.

Defined results: documents of unlisted or null sources, and texts without tokens,
are not used (they add no tokens and would leave shares unchanged). Equal rows of
``documents`` are separate documents only if their ids differ. Targets that are
null, zero or negative, or repeats below one, count as unlisted; repeated targets
count once, with the greatest share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.tables import materialize

#: Documents of a bucket, about.
BUCKET_ROWS = 20_000


def plan(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """A row for each listed source: target share, documents, tokens and expected copies of each document.

    The targets' rows are as many as there are sources; sums over documents
    are pre-aggregated, so the final steps see a row a source.
    """
    goal = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") >= 1) & F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = counts.where(F.col("tokens") > 0).groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("source_tokens"))
    rows = goal.join(have, "source", "left").fillna(0, ["documents", "source_tokens"])
    usable = F.col("source_tokens") > 0
    everything = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("share", F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(everything)).otherwise(F.lit(0.0)))
    room = F.when(usable, F.col("max_repeats") * F.col("source_tokens") / F.col("share"))
    rows = rows.withColumn("total", F.min(room).over(everything))
    if total_tokens is not None:
        rows = rows.withColumn("total", F.least("total", F.lit(float(total_tokens))))
    return rows.withColumn("copies", F.when(usable, F.least(F.col("share") * F.col("total") / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)))


def mix(counts: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: int | None = None, key: str = "doc_id", planned: DataFrame | None = None) -> DataFrame:
    """(source, key, tokens, copies_expected, copies) of each used document; ``planned`` is a ``plan`` already made."""
    goal = (plan(counts, targets, total_tokens) if planned is None else planned).where(F.col("copies") > 0).select("source", F.col("copies").alias("copies_expected"), "max_repeats")
    rows = counts.where((F.col("tokens") > 0) & F.col("source").isNotNull()).select("source", F.col(key), "tokens").dropDuplicates(["source", key])
    rows = rows.join(F.broadcast(goal), "source")  # a row a listed source
    rows = rows.withColumn("_mark", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_grade", F.floor(F.log2("tokens") * 4).cast("int"))
    # Listed sources by quarter octaves of size: a few hundred rows at any number of documents.
    grades = rows.groupBy("source", "_grade").agg(F.ceil(F.count("*") / F.lit(BUCKET_ROWS)).alias("_buckets"))
    rows = rows.join(F.broadcast(grades), ["source", "_grade"]).withColumn("_bucket", F.pmod(F.shiftright("_mark", 20), F.col("_buckets")))
    sizes = rows.groupBy("source", "_grade", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_grade", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("source", "_grade", "_bucket").orderBy("_mark", key)
    rank = F.row_number().over(inside) - 1
    placed = rows.withColumn("_rank", rank).join(shifts, ["source", "_grade", "_bucket"]).withColumn("_place", F.col("_rank") + F.col("_before"))
    # One offset in [0, 1) a source, from the seed and the source's name.
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    low = F.floor(F.col("_place") * F.col("copies_expected") + offset)
    high = F.floor((F.col("_place") + 1) * F.col("copies_expected") + offset)
    return (
        placed.withColumn("copies", F.least(high - low, F.col("max_repeats").cast("bigint")).cast("int"))
        .where(F.col("copies") > 0)
        .select("source", key, "tokens", "copies_expected", "copies")
    )


def report(counts: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: int | None = None, key: str = "doc_id") -> DataFrame:
    """Target and actual share, tokens and repeats of each listed source."""
    planned = materialize(plan(counts, targets, total_tokens), "p8-plan")
    used = mix(counts, targets, seed, total_tokens, key, planned).groupBy("source").agg(
        F.count("*").alias("documents_used"), F.sum("copies").alias("copies_used"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_repeats")
    )
    rows = planned.join(used, "source", "left").fillna(0, ["documents_used", "copies_used", "mixed_tokens", "most_repeats"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    return rows.select(
        "source", "target_share", F.col("share").alias("reachable_share"), F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(F.lit(0.0)).alias("actual_share"),
        "documents", "source_tokens", "documents_used", F.col("copies").alias("copies_expected"), "copies_used", "mixed_tokens", "most_repeats", "max_repeats",
    )
