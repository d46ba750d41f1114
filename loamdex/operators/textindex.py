"""Full-text search through a stored index: tokenized lines, postings and corpus statistics.

* ``lines``: (path, line, content, tokens, dl), in order of path and line;
* ``postings``: (token, path, line, dl, tf, positions), in order of token, so that the
  scan reads the row groups of a query's tokens only;
* ``totals``: (path, lines, tokens), a row a file, whose sums are the statistics.

A query reads the postings of its tokens. From them the matching lines get their
counts as a scan of all lines would: single tokens by their stored count, phrases,
``^`` and ``NEAR`` from the stored places of their tokens. Document frequencies are counted over those lines, which are
all that hold a phrase; the number of lines and their mean length come from the
totals, so scores are those of a scan.

A line is known by path and line; of a path and line given twice both contents count as one line.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.functions.fixed import OVERFETCH
from loamdex.functions.globs import path_filter
from loamdex.operators.fulltext import Compiled, score, tokenized
from loamdex.operators.ftsquery import Phrase, understood
from loamdex.tables import materialize

#: Hits up to which their lines are looked up by their keys; more are joined.
LOOKED_UP = 1000


def postings_of(lines: DataFrame) -> DataFrame:
    """The postings of tokenized lines: one shuffle, by token and then path, so that a token all files have is no single task's."""
    each = lines.select("path", "line", "dl", F.posexplode("tokens").alias("pos", "token")).repartitionByRange("token", "path")
    rows = each.groupBy("token", "path", "line", "dl").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return rows.select("token", "path", "line", "dl", "tf", "positions").sortWithinPartitions("token", "path", "line")


def totals_of(lines: DataFrame) -> DataFrame:
    return lines.groupBy("path").agg(F.count("*").alias("lines"), F.sum(F.col("dl").cast("bigint")).alias("tokens"))


#: A token of a query, and whether it is a prefix.
Atom = tuple[str, bool]


def _atoms(p: Phrase) -> list[Atom]:
    return [(t, p.prefix and k == len(p.tokens) - 1) for k, t in enumerate(p.tokens)] if p.searched else []


def _holds(atom: Atom) -> Column:
    return F.col("token").startswith(atom[0]) if atom[1] else F.col("token") == atom[0]


class _Places:
    """The columns with the places of a query's tokens in a line, and what phrases make of them."""

    def __init__(self) -> None:
        self.names: dict[Atom, str] = {}

    def of(self, p: Phrase) -> Column:
        columns = [F.col(self.names.setdefault(a, f"_p{len(self.names)}")) for a in _atoms(p)]
        if not columns:
            return F.array().cast("array<int>")

        def begins(x: Column) -> Column:
            ok = F.lit(True)
            for k, c in enumerate(columns[1:], 1):
                ok = ok & F.array_contains(c, x + k)
            return ok

        if p.first:
            return F.when(F.array_contains(columns[0], F.lit(0)) & begins(F.lit(0)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        return F.filter(columns[0], begins) if len(columns) > 1 else columns[0]

    def count(self, p: Phrase) -> Column:
        return F.size(self.of(p))


@dataclass
class TextIndex:
    lines: DataFrame
    postings: DataFrame
    totals: DataFrame

    @classmethod
    def build(cls, lines: DataFrame) -> TextIndex:
        """Writes the index of ``lines`` (path, line, content) below the shared folder."""
        have = lines if "tokens" in lines.columns else tokenized(lines)
        stored = materialize(have.select("path", "line", "content", "tokens", "dl").repartitionByRange("path", "line").sortWithinPartitions("path", "line"), "index-lines")
        return cls(stored, materialize(postings_of(stored), "index-postings"), materialize(totals_of(stored), "index-totals"))

    def statistics(self) -> DataFrame:
        """One row: number of lines and of tokens."""
        return self.totals.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("_N"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("_len"))

    def counted(self, query: Compiled, places: _Places) -> DataFrame:
        """(path, line, dl) and the counts of the query's phrases, for each line that has all tokens of one of them."""
        atoms = sorted({a for p, _ in query.phrases for a in _atoms(p)})
        wanted, whole = F.lit(False), F.lit(False)
        for a in atoms:
            wanted = wanted | _holds(a)
        rows = self.postings.where(wanted)
        if not query.later and all(len(p.tokens) == 1 and not p.first for p, _ in query.phrases):
            counts = [F.sum(F.when(_holds((p.tokens[0], p.prefix)) & F.lit(p.searched), F.col("tf")).otherwise(0)).cast("int").alias(name) for p, name in query.phrases]
            return rows.groupBy("path", "line", "dl").agg(*counts)
        for p, _ in query.phrases:
            if _atoms(p):
                all_of = F.lit(True)
                for a in _atoms(p):
                    all_of = all_of & (F.size(places.names[a]) > 0)
                whole = whole | all_of
        found = rows.groupBy("path", "line", "dl").agg(*[F.flatten(F.collect_list(F.when(_holds(a), F.col("positions")))).alias(places.names[a]) for a in atoms])
        return found.where(whole).withColumns(query.columns)

    def ranked(self, text: str) -> DataFrame:
        """(path, line, score) of all matching lines, unordered."""
        places = _Places()
        query = Compiled(understood(text), places.count, places.of)
        if not any(_atoms(p) for p, _ in query.phrases):
            return self.lines.where(F.lit(False)).select("path", "line", F.lit(0.0).alias("score"))
        counted = self.counted(query, places)
        held = counted.agg(*[F.sum((F.col(n) > 0).cast("bigint")).alias(f"{n}_df") for _, n in query.phrases], F.lit(0).alias("_one"))
        rows = counted.crossJoin(F.broadcast(self.statistics())).crossJoin(F.broadcast(held))  # a row each
        if query.later:
            rows = rows.withColumns(query.later)
        return rows.where(query.match).withColumn("score", score(query)).select("path", "line", "score")

    def search(self, text: str, limit: int = 30, include: str | Iterable[str] | None = None, exclude: str | Iterable[str] | None = None, parity: bool = False) -> DataFrame:
        """The best ``limit`` lines: (path, line, content, score); limits and filters as in a search by scan."""
        limit = 1 if limit < 0 else limit
        keep = path_filter(F.col("path"), include, exclude)
        order = (F.col("score"), F.col("path"), F.col("line"))
        rows = self.ranked(text)
        if parity and (include or exclude):
            top = rows.orderBy(*order).limit(limit * OVERFETCH).where(keep).orderBy(*order).limit(limit)
        else:
            top = rows.where(keep).orderBy(*order).limit(limit)
        content = self.lines.select("path", "line", "content")
        if limit <= LOOKED_UP:  # as many rows as were asked for: the lines' scan is pruned by their paths
            found = [tuple(r) for r in top.collect()]
            top = rows.sparkSession.createDataFrame(found, "path string, line int, score double")
            content = content.where(F.col("path").isin(sorted({r[0] for r in found})) & F.col("line").isin(sorted({r[1] for r in found})))
            return content.join(F.broadcast(top), ["path", "line"]).select("path", "line", "content", "score").orderBy(*order)
        return content.join(top, ["path", "line"]).select("path", "line", "content", "score").orderBy(*order)
