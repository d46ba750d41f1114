"""Long spans that stand verbatim in two or more files.

Every window of ``SPAN`` characters has a minimiser, the least hash of the
character m-grams in it. Consecutive windows with one minimiser form a packed
string, and equal windows of two texts always fall under the same minimiser:

1. Minimisers. Each text gives (minimiser, start, length) rows; minimisers of one
   text only are dropped by a pre-aggregated count, so what stands nowhere else
   travels as a few bytes.
2. Packed strings. The other strings are cut from their texts. Equal strings
   count once from here on; who has them stays a table of its own.
3. Buckets. Different strings under one minimiser go to one bucket, where their
   windows are sorted and counted. A minimiser with more than ``BUCKET`` strings
   (a licence head before many different files) does not go to one task: its
   windows are counted by a shuffle on the window itself.

Exact copies of a whole text are one text until the result. Windows are
told apart by 128-bit digests. Defined results: characters are code points; texts
below ``SPAN`` share nothing; a span repeated only within one file is not shared;
a file with an exact copy is shared as a whole; no lines give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.byfile import packed
from loamdex.tables import materialize

SPAN = 400
GRAM = 128
BUCKET = 256
_CHARS = 400_000

_RUNS = "path string, first int, lines int, content string"
_RUNS_ARROW = pa.schema([("path", pa.string()), ("first", pa.int32()), ("lines", pa.int32()), ("content", pa.string())])


def packed_lines(lines: DataFrame) -> DataFrame:
    """Runs of consecutive lines of a file as one row each: they travel as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            path, number = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            content = pc.fill_null(batch.column(2), "").to_pylist()
            cuts = np.zeros(1, np.int64)
            if n > 1:
                new = np.asarray(pc.not_equal(path[1:], path[:-1])).astype(bool) | (number[1:] != number[:-1] + 1)
                cuts = np.concatenate([cuts, np.flatnonzero(new) + 1])
            ends = np.concatenate([cuts[1:], [n]])
            texts = ["\n".join(content[a:b]) for a, b in zip(cuts.tolist(), ends.tolist())]
            sizes = ends - cuts
            if any(t.count("\n") != k - 1 for t, k in zip(texts, sizes.tolist())):  # ends of lines within lines
                cuts, sizes, texts = np.arange(n), np.ones(n, np.int64), content
            yield pa.RecordBatch.from_arrays([path.take(pa.array(cuts)), pa.array(number[cuts].astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(texts, pa.string())], schema=_RUNS_ARROW)

    rows = lines.where(F.col("path").isNotNull() & F.col("line").isNotNull()).select(F.col("path").cast("string"), F.col("line").cast("int").alias("line"), F.col("content").cast("string").alias("content"))
    return rows.mapInArrow(run, _RUNS)


def _text(runs: list[tuple[int, int, str]]) -> str:
    """The text of a file's runs: distinct lines in order."""
    if len(runs) == 1:
        return runs[0][2]
    runs = sorted(set(runs))
    if all(a[0] + a[1] <= b[0] for a, b in zip(runs, runs[1:])):
        return "\n".join(r[2] for r in runs)
    lines = {(first + i, c) for first, n, text in runs for i, c in enumerate(text.split("\n") if n > 1 else [text])}
    return "\n".join(c for _, c in sorted(lines))


def texts(batches: Iterator[pa.RecordBatch], extra: int | None = None) -> Iterator[tuple]:
    """(path, text[, column ``extra`` of the last run]) of runs sorted by path."""
    path, held, last = None, [], None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        more = batch.column(extra).to_pylist() if extra is not None else columns[0]
        for p, first, n, c, x in zip(*columns, more):
            if p != path:
                if held:
                    yield path, _text(held), last
                path, held = p, []
            if n:
                held.append((first, n, c))
            last = x
    if held:
        yield path, _text(held), last


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` characters from each position on (the last ones run past the end)."""
    with np.errstate(over="ignore"):
        h = (codes.astype(np.uint64) + np.uint64(1)) * _M1
        h ^= h >> np.uint64(29)
        base, k = np.uint64(0x100000001B3), 1
        while k < GRAM:
            tail = np.zeros_like(h)
            tail[:-k] = h[k:] if k < len(h) else 0
            h = h * base + tail
            base = base * base
            k *= 2
        h ^= h >> np.uint64(31)
        h *= _M2
        h ^= h >> np.uint64(29)
    return h


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by least-so-far in blocks from both sides."""
    n = len(h)
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def packed_windows(batch: list[str], span: int = SPAN) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, minimisers, starts, lengths) of the packed strings of each text of at least ``span`` characters."""
    lengths = np.array([len(t) for t in batch], np.int64)
    codes = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < span:
        return
    width = span - GRAM + 1
    least = sliding_least(grams(codes), width)
    first = 0
    for k, n in enumerate(lengths):
        if n >= span:
            v = least[first : first + n - span + 1]
            at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            end = np.concatenate([at[1:], [len(v)]])
            if (end - at).max() > width:  # a minimiser that repeats: strings of bounded length
                pieces = [np.arange(a, b, width) for a, b in zip(at, end)]
                end = np.concatenate([np.append(p[1:], b) for p, b in zip(pieces, end)])
                at = np.concatenate(pieces)
            yield k, v[at].view(np.int64), at.astype(np.int32), (end - at + span - 1).astype(np.int32)
        first += n


def _pass_one(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    def flush(paths: list[str], held: list[str]) -> Iterator[pa.RecordBatch]:
        digests = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in held]
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(digests, pa.binary()), pa.array([len(t) for t in held], pa.int32()), pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.int32())], schema=one)
        parts = list(packed_windows(held, span))
        if parts:
            counts = np.array([len(p[1]) for p in parts])
            who = np.repeat(np.array([p[0] for p in parts]), counts)
            index = pa.array(who)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(who), pa.string()), pa.array(digests, pa.binary()).take(index), pa.array(np.concatenate([p[3] for p in parts])), pa.array(np.concatenate([p[1] for p in parts])), pa.array(np.concatenate([p[2] for p in parts]))], schema=one
            )

    one = pa.schema([("path", pa.string()), ("digest", pa.binary()), ("length", pa.int32()), ("minimiser", pa.int64()), ("start", pa.int32())])
    paths, held, chars = [], [], 0
    for path, text, _ in texts(batches):
        paths.append(path)
        held.append(text)
        chars += len(text)
        if chars >= _CHARS:
            yield from flush(paths, held)
            paths, held, chars = [], [], 0
    if held:
        yield from flush(paths, held)


def _windows(string: str, span: int) -> list[bytes]:
    data = memoryview(string.encode("utf-32-le", "surrogatepass"))
    digest = xxhash.xxh3_128_digest
    return [digest(data[4 * i : 4 * (i + span)]) for i in range(len(string) - span + 1)]


def _runs(numbers: list[int]) -> Iterator[tuple[int, int]]:
    a = b = numbers[0]
    for x in numbers[1:]:
        if x != b + 1:
            yield a, b
            a = x
        b = x
    yield a, b


def bucket_rows(group: list[tuple[bytes, str, str, str]], span: int) -> Iterator[tuple]:
    """(class, string, first, last) of the windows that strings of different texts share: all windows are sorted, equal ones stand together.

    ``group``: (id, string, least owner, greatest owner) of the different strings of a minimiser.
    """
    if len(group) < 2:
        return
    digests = [_windows(string, span) for _, string, _, _ in group]
    lengths = np.array([len(d) for d in digests])
    halves = np.frombuffer(b"".join(w for d in digests for w in d), "<u8").reshape(-1, 2)
    who = np.repeat(np.arange(len(group)), lengths)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    keys = halves[order]
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    who = who[order]
    several = np.flatnonzero(np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts))
    if not len(several):
        return
    place = (np.arange(len(order)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[order]
    ends = np.append(starts[1:], len(order))
    classes: dict[tuple[int, ...], dict[int, list[int]]] = {}
    for r in several.tolist():
        where = list(zip(who[starts[r] : ends[r]].tolist(), place[starts[r] : ends[r]].tolist()))
        members = tuple(sorted({k for k, _ in where}))
        if min(group[k][2] for k in members) != max(group[k][3] for k in members):
            offsets = classes.setdefault(members, {})
            for k, i in where:
                offsets.setdefault(k, []).append(i)
    for members, offsets in classes.items():
        name = xxhash.xxh3_128_digest(b"".join(sorted(group[k][0] for k in members)))
        for k in members:
            for a, b in _runs(sorted(set(offsets[k]))):
                yield name, group[k][0], a, b


_SHARED = "class binary, string binary, first int, last int"
_SHARED_ARROW = pa.schema([("class", pa.binary()), ("string", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])


class Shared:
    """The intermediate tables of one run: which text has which string, and which windows are shared."""

    def __init__(self, lines: DataFrame, span: int = SPAN):
        self.span = span
        runs = packed_lines(lines).repartition("path").sortWithinPartitions(F.xxhash64("path"), "path")
        one = materialize(runs.mapInArrow(lambda it: _pass_one(it, span), "path string, digest binary, length int, minimiser bigint, start int"), "p4-minimisers")
        self.files = one.where(F.col("minimiser").isNull()).select("path", "digest", F.col("length").alias("chars"))
        long = self.files.where(F.col("chars") >= span)
        self.copies = long.groupBy("digest").agg(F.min("path").alias("text"), F.count("*").alias("copies"))
        windows = one.where(F.col("minimiser").isNotNull()).drop("path")
        common = windows.groupBy("minimiser").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("minimiser")
        # Copies gave the same rows; each string of a text is wanted once.
        flagged = (
            windows.join(common, "minimiser").select("digest", "minimiser", "start", "length").distinct()
            .join(self.copies.select(F.col("text").alias("path"), "digest"), "digest")
            .groupBy("path").agg(F.collect_list(F.struct("minimiser", "start", "length")).alias("spans"))
        )

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for path, text, spans in texts(batches, 4):
                    for s in spans or ():
                        string = text[s["start"] : s["start"] + s["length"]]
                        yield path, s["minimiser"], s["start"], xxhash.xxh3_128_digest(string.encode("utf-8", "surrogatepass")), string

            yield from packed(rows(), pa.schema([("text", pa.string()), ("minimiser", pa.int64()), ("start", pa.int32()), ("string", pa.binary()), ("content", pa.string())]))

        # One shuffle by path brings the spans to their texts; a join might leave a file's runs in several tasks.
        none = F.lit(None).cast(flagged.schema["spans"].dataType)
        wanted = flagged.select("path", F.lit(None).cast("int").alias("first"), F.lit(0).alias("lines"), F.lit("").alias("content"), "spans")
        strings = packed_lines(lines).withColumn("spans", none).unionByName(wanted).repartition("path").sortWithinPartitions(F.xxhash64("path"), "path", F.col("first").asc_nulls_last())
        self.strings = materialize(strings.mapInArrow(cut, "text string, minimiser bigint, start int, string binary, content string"), "p4-strings")
        different = self.strings.groupBy("minimiser", "string", "content").agg(F.min("text").alias("low"), F.max("text").alias("high"))
        self.different = materialize(different, "p4-different")
        self.owners = self.strings.select("text", "start", "string")
        self.shared = materialize(self._whole().unionByName(self._buckets()).unionByName(self._hot()), "p4-shared")

    def _whole(self) -> DataFrame:
        """Strings that several texts have as they are."""
        return self.different.where("low <> high").select(F.col("string").alias("class"), "string", F.lit(0).alias("first"), (F.length("content") - self.span).cast("int").alias("last"))

    def _sized(self) -> tuple[DataFrame, DataFrame]:
        sizes = self.different.groupBy("minimiser").agg(F.count("*").alias("n")).where("n > 1")
        return sizes.where(F.col("n") <= BUCKET).select("minimiser"), sizes.where(F.col("n") > BUCKET).select("minimiser")

    def _buckets(self) -> DataFrame:
        span = self.span
        rows = self.different.join(self._sized()[0], "minimiser").select("minimiser", "string", "content", "low", "high").repartition("minimiser").sortWithinPartitions("minimiser", "content")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out() -> Iterator[tuple]:
                at, group = None, []
                for batch in batches:
                    for m, s, c, low, high in zip(*(x.to_pylist() for x in batch.columns)):
                        if m != at:
                            yield from bucket_rows(group, span)
                            at, group = m, []
                        group.append((s, c, low, high))
                yield from bucket_rows(group, span)

            yield from packed(out(), _SHARED_ARROW)

        return rows.mapInArrow(run, _SHARED)

    def _hot(self) -> DataFrame:
        """The same for minimisers with many strings, counted by window."""
        span = self.span
        rows = self.different.join(self._sized()[1], "minimiser").select("string", "content", "low", "high")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("window", pa.binary()), ("string", pa.binary()), ("at", pa.int32()), ("low", pa.string()), ("high", pa.string())])
            for batch in batches:
                for s, c, low, high in zip(*(x.to_pylist() for x in batch.columns)):
                    w = _windows(c, span)
                    yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array([s] * len(w), pa.binary()), pa.array(range(len(w)), pa.int32()), pa.array([low] * len(w)), pa.array([high] * len(w))], schema=schema)

        windows = rows.repartition("string").mapInArrow(run, "window binary, string binary, at int, low string, high string")
        many = windows.groupBy("window").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.min("string").alias("s"), F.max("string").alias("t")).where("a <> b and s <> t").select("window")
        return windows.join(many, "window").select(F.col("window").alias("class"), "string", F.col("at").alias("first"), F.col("at").alias("last"))

    def _linked(self) -> DataFrame:
        """(a, b): every pair of different texts with a common span, a < b.

        Classes with the same texts say the same; they are told by the number and two
        sums of hashes of their texts, so that no task gathers the texts of a class.
        """
        members = materialize(self.shared.select("class", "string").distinct().join(self.owners.select("string", "text").distinct(), "string").select("class", "text").distinct(), "p4-members")
        marks = [F.bit_xor(F.xxhash64(F.lit(seed), "text")).alias(f"m{seed}") for seed in (1, 2)]
        kept = members.groupBy("class").agg(F.count("*").alias("n"), *marks).groupBy("n", "m1", "m2").agg(F.min("class").alias("class")).select("class")
        of = members.join(kept, "class")
        return of.select("class", F.col("text").alias("a")).join(of.select("class", F.col("text").alias("b")), "class").where("a < b").select("a", "b").distinct()

    def pairs(self) -> DataFrame:
        """(path_a, path_b): every pair of files with a common span, once."""
        linked = self._linked()
        who = self.files.where(F.col("chars") >= self.span).join(self.copies, "digest").select("path", "text", "copies")
        of = who.select("path", "text")
        across = linked.join(of.select(F.col("text").alias("a"), F.col("path").alias("p")), "a").join(of.select(F.col("text").alias("b"), F.col("path").alias("q")), "b").select("p", "q")
        several = who.where("copies > 1").select("path", "text")
        within = several.select("text", F.col("path").alias("p")).join(several.select("text", F.col("path").alias("q")), "text").where("p < q").select("p", "q")
        return across.unionByName(within).select(F.least("p", "q").alias("path_a"), F.greatest("p", "q").alias("path_b")).distinct()

    def links(self) -> DataFrame:
        """(path, class, copies, links): the class of equal texts each file is in, by its first path, how many files that class has, and with how many other texts it shares a span."""
        linked = self._linked()
        both = linked.select(F.explode(F.array("a", "b")).alias("text")).groupBy("text").agg(F.count("*").alias("links"))
        rows = self.files.join(self.copies, "digest", "left").join(both, "text", "left")
        return rows.select("path", F.coalesce("text", "path").alias("class"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))

    def coverage(self) -> DataFrame:
        """(path, chars, shared_chars, copies): how much of each file stands in others."""
        spans = self.shared.join(self.owners, "string").select("text", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + self.span).alias("b")).distinct()
        order = Window.partitionBy("text").orderBy("a", "b")
        before = F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        new = spans.withColumn("new", F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), before)))
        own = new.groupBy("text").agg(F.sum("new").alias("own"))
        rows = self.files.join(self.copies, "digest", "left").join(own, "text", "left")
        return rows.select("path", "chars", F.when(F.col("copies") > 1, F.col("chars").cast("bigint")).otherwise(F.coalesce("own", F.lit(0).cast("bigint"))).alias("shared_chars"), (F.coalesce("copies", F.lit(1)) - 1).alias("exact_copies"))
