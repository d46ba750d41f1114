"""Ranked full-text search over lines: matching and BM25 as column expressions.

A document is one line. The score is negative, better matches lower, and sums
over the phrases of the query that the line matches through; a phrase's weight
comes from the number of lines that hold it. Statistics are of the whole corpus,
whatever the path filter. Ties are in order of path and line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loamdex.functions.fixed import BM25_B, BM25_K1, BM25_LEAST_IDF, OVERFETCH
from loamdex.functions.globs import path_filter
from loamdex.functions.text import tokens
from loamdex.operators.ftsquery import Near, Nothing, Phrase, understood


def tokenized(lines: DataFrame) -> DataFrame:
    """``lines`` with their ``tokens`` and length ``dl``; what an index stores."""
    return lines.withColumn("tokens", tokens(F.col("content"))).withColumn("dl", F.size("tokens"))


def _same(have: Column, want: str, prefix: bool) -> Column:
    return have.startswith(want) if prefix else have == want


def positions(p: Phrase, column: str = "tokens") -> Column:
    """Where a phrase begins in a line's tokens."""
    empty = F.array().cast("array<int>")
    if not p.searched or not p.tokens:
        return empty
    toks, k = F.col(column), len(p.tokens)
    if p.first:
        here = F.size(toks) >= k
        for j, t in enumerate(p.tokens):
            here = here & F.coalesce(_same(F.get(toks, F.lit(j)), t, p.prefix and j == k - 1), F.lit(False))
        return F.when(here, F.array(F.lit(0))).otherwise(empty)
    last = k - 1

    def begins(i: Column) -> Column:
        ok = F.lit(True)
        for j, t in enumerate(p.tokens):
            ok = ok & _same(F.get(toks, i + j), t, p.prefix and j == last)
        return ok

    # Most lines lack one of the tokens; only the others are walked place by place.
    holds = F.size(toks) >= k
    for t in p.tokens[: last if p.prefix else k]:
        holds = holds & F.array_contains(toks, t)
    return F.when(holds, F.filter(F.sequence(F.lit(0), F.size(toks) - k), begins)).otherwise(empty)


def count_of(p: Phrase, column: str = "tokens") -> Column:
    """How often a phrase occurs; single tokens need no positions."""
    if p.searched and len(p.tokens) == 1 and not p.first:
        return F.size(F.filter(F.col(column), lambda t: _same(t, p.tokens[0], p.prefix)))
    return F.size(positions(p, column))


def _near_counts(sizes: list[int], distance: int):
    """A function on batches: of each phrase, how many places are within the distance."""

    def one(places: list[list[int]]) -> list[int]:
        """Moves one pointer a phrase along; a set of places counts if all begin close enough before the last."""
        n = len(places)
        if any(not len(x) for x in places):
            return [0] * n
        at, kept = [0] * n, [set() for _ in range(n)]
        while True:
            top, settled = places[0][at[0]], False
            while not settled:
                settled = True
                for i in range(n):
                    low = top - sizes[i] - distance
                    if not low <= places[i][at[i]] <= top:
                        settled = False
                        while places[i][at[i]] < low:
                            at[i] += 1
                            if at[i] == len(places[i]):
                                return [len(k) for k in kept]
                        top = max(top, places[i][at[i]])
            for i in range(n):
                kept[i].add(places[i][at[i]])
            # The phrase whose next place comes first moves on.
            ahead = [(places[i][at[i] + 1], i) for i in range(n) if at[i] + 1 < len(places[i])]
            if not ahead:
                return [len(k) for k in kept]
            at[min(ahead)[1]] += 1

    def counts(*columns: pd.Series) -> pd.Series:
        return pd.Series([one([list(c) for c in row]) for row in zip(*columns)])

    return F.pandas_udf(counts, ArrayType(IntegerType()))


class Compiled:
    """A query as columns: the counts to add to lines, whether they match, and the phrases that score."""

    def __init__(self, tree, count: Callable[[Phrase], Column] = count_of, places: Callable[[Phrase], Column] = positions):
        """``count`` and ``places`` say how often and where a phrase stands in a row."""
        self.count, self.places = count, places
        self.phrases: list[tuple[Phrase, str]] = []
        self.columns: dict[str, Column] = {}
        self.later: dict[str, Column] = {}
        self.scored: list[tuple[int, Column]] = []
        self.match = self._walk(tree, F.lit(True), True)

    def _phrase(self, p: Phrase) -> str:
        name = f"_n{len(self.phrases)}"
        self.phrases.append((p, name))
        self.columns[name] = self.count(p)
        return name

    def _walk(self, node, above: Column, scores: bool) -> Column:
        if isinstance(node, Nothing):
            return F.lit(False)
        if isinstance(node, Near):
            names = [self._phrase(p) for p in node.phrases]
            hit = F.lit(True)
            for n in names:
                hit = hit & (F.col(n) > 0)
            if len(names) > 1:
                near = f"_near{len(self.later)}"
                places = [self.places(p) for p in node.phrases]
                none = F.array(*[F.lit(0) for _ in names])
                self.later[near] = F.when(hit, _near_counts([len(p.tokens) for p in node.phrases], node.distance)(*places)).otherwise(none)
                hit = F.get(F.col(near), F.lit(0)) > 0
                counts = [F.get(F.col(near), F.lit(i)) for i in range(len(names))]
            else:
                counts = [F.col(n) for n in names]
            if scores:
                for n, c in zip(names, counts):
                    self.scored.append((int(n[2:]), F.when(above & hit, c).otherwise(F.lit(0))))
            return hit
        if node.kind == "or":
            return self._walk(node.left, above, scores) | self._walk(node.right, above, scores)
        mark = len(self.scored)
        left = self._walk(node.left, above, scores)
        right = self._walk(node.right, above, scores and node.kind == "and")
        hit = left & right if node.kind == "and" else left & ~right
        # A phrase counts only where everything around it matches.
        self.scored[mark:] = [(i, F.when(hit, c).otherwise(F.lit(0))) for i, c in self.scored[mark:]]
        return hit


def statistics(lines: DataFrame, query: Compiled) -> DataFrame:
    """One row: number of lines, mean length, and the lines that hold each phrase."""
    held = [F.sum((F.col(n) > 0).cast("bigint")).alias(f"{n}_df") for _, n in query.phrases]
    return lines.agg(F.count(F.lit(1)).alias("_N"), F.sum(F.col("dl").cast("bigint")).alias("_len"), *held)


def score(query: Compiled) -> Column:
    total = F.lit(0.0)
    mean = F.col("_len") / F.col("_N")
    for i, count in query.scored:
        df, c = F.col(f"_n{i}_df"), count.cast("double")
        raw = F.ln((F.col("_N") - df + 0.5) / (df + 0.5))
        idf = F.when(raw > 0, raw).otherwise(F.lit(BM25_LEAST_IDF))
        total = total - idf * c * (BM25_K1 + 1.0) / (c + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / mean))
    return total


def ranked(lines: DataFrame, text: str) -> DataFrame:
    """All matching lines with their ``score``, unordered.

    ``lines`` may already have ``tokens`` and ``dl``; else they are made on the way.
    The statistics are one row, so joining them moves nothing.
    """
    query = Compiled(understood(text))
    have = lines if "tokens" in lines.columns else tokenized(lines)
    counted = have.withColumns(query.columns)
    stats = statistics(counted, query)
    rows = counted.crossJoin(F.broadcast(stats))
    if query.later:
        holds = F.lit(True)
        rows = rows.where(holds).withColumns(query.later)
    return rows.where(query.match).withColumn("score", score(query))


def search(lines: DataFrame, text: str, limit: int = 30, include: str | Iterable[str] | None = None, exclude: str | Iterable[str] | None = None, parity: bool = False) -> DataFrame:
    """The best ``limit`` lines for a query: (path, line, content, score).

    A path filter is applied before the limit; with ``parity`` after fetching
    ``limit * 8`` rows, as an engine without that does, which may leave fewer. A
    limit of 0 gives nothing, a negative one a single row.
    """
    limit = 1 if limit < 0 else limit
    keep = path_filter(F.col("path"), include, exclude)
    rows = ranked(lines, text).select("path", "line", "content", "score")
    order = (F.col("score"), F.col("path"), F.col("line"))
    if parity and (include or exclude):
        return rows.orderBy(*order).limit(limit * OVERFETCH).where(keep).orderBy(*order).limit(limit)
    return rows.where(keep).orderBy(*order).limit(limit)
