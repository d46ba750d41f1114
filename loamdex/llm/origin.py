"""Files that nobody wrote by hand: vendored, generated, minified, bulk data.

1. Every source file gives the hashes of its telling lines. Files with the same
   lines are one content from here on; a content in two services is a copy.
2. An inverted index of the line hashes of all contents. Lines of one content
   only link nothing and are dropped; a line is rare if no more than ``RARE`` contents
   have it. A content with ``CONTAINED`` of its rare lines in one other content of
   another service is a copy, edited or not. A content with fewer than that of its
   rare lines in the index asks no further; the others are counted, exactly, against
   the contents that stand for their lines (four a line: the one with the most
   copies, the first and last by service, the least by hash), then, if those show no
   copy, against every holder of three of the rarest lines a copy cannot do without.
   Lines that are not rare count only where two contents have ``CONTAINED`` of all
   their lines in common, each of its own; such partners come from the four that
   stand for a line, so a library that a third of all files have edited is found
   without pairing them all.
3. The files that are no copies are told by the composition of their tokens (blanks
   and lengths of lines, shares of numbers, names that count up), and last by
   notices in their leading comments, names and folders.

Defined results: ``evidence`` says what decided (containment, tokens, notice);
``containment`` is null where nothing was counted. Paths without lines have no
row; files with fewer than ``LEAST_SHARED`` telling lines are no copies; lock files
of package tools are output, other configuration and prose are written by hand;
equal rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.byfile import packed
from loamdex.llm.sharedspans import packed_lines, texts
from loamdex.tables import materialize

RARE = 1000
CONTAINED = 0.9
LEAST_SHARED = 6
#: So many of the lines it asks for a partner must have, at least; chance partners seldom do.
HITS = 3

SOURCE = {"py", "pyi", "java", "kt", "ts", "tsx", "js", "jsx", "mjs", "cjs", "go", "rs", "c", "h", "cc", "cpp", "hpp", "cs", "rb", "php", "lua", "css", "scss", "sql", "swift", "scala", "m", "vue"}
LOCKS = re.compile(r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|[\w.-]*[.-]lock(?:\.json|\.ya?ml)?|[\w.-]+\.lock(?:b|file)?|go\.sum|composer\.lock|pnpm-lock\.yaml|Gemfile\.lock|Package\.resolved)$")
LOCK_TEXT = re.compile(r'"lockfileVersion"\s*:|^# (?:yarn lockfile|This file is automatically @generated)|^lockfileVersion:|^lockfile_version\b', re.M)
GENERATED_NAME = re.compile(r"(?i)(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h|c)|\.pb\.gw\.go|Grpc\.java|\.g\.(?:ts|dart|cs)|\.designer\.cs|\.generated\.\w+|_generated\.\w+|\.gen\.\w+)$")
MINIFIED_NAME = re.compile(r"(?i)(?:[.-]min|\.bundle|-bundle)\.(?:js|css|mjs)$")
GENERATED_PLACE = re.compile(r"(?i)(?:^|/)(?:generated-sources|generated|autogen|gen|__generated__|codegen-out)/")
VENDOR_PLACE = re.compile(r"(?i)(?:^|/)(?:vendor|third[_-]party|3rd-?party|node_modules|external|extern|externals|deps|vendored|bower_components|Pods|site-packages)/")
#: Notices of tools, as they stand in leading comments (fixed patterns).
GENERATED = re.compile(
    r"(?im)^\W*(?:code generated by\b.*|.*\bdo not edit(?: (?:this file|manually|by hand|directly))?\s*(?:[.!*)>-].*)?$|@generated\b.*|<auto-?generated.*|auto-?generated\b(?! (?:\w+ ){0,2}(?:pages?|reports?|files? for)).*"
    r"|(?:this (?:file|code|class|module|source) (?:was|is|has been) )?(?:automatically|machine|auto)[- ]generated\b.*|generated (?:from|by|with|using|at|on|automatically)\b.*|this (?:file|code|class|module) (?:was|is|has been) generated\b.*"
    r"|.*\b(?:edits|changes|modifications)\b.*\b(?:(?:are|will be|get) )(?:overwritten|lost|discarded)\b.*|output of (?:the )?\S+ (?:compiler|generator)\b.*"
    r"|.*\b(?:erzeugt|generiert) und wird\b.*|.*\bautomatisch (?:erzeugt|generiert)\b.*|.*\bg[ée]n[ée]r[ée] (?:par|automatiquement)\b.*|.*\bgenerado (?:por|autom[áa]ticamente)\b.*)\W*$"
)
VENDORED = re.compile(r"(?im)^\W*(?:@license\b\s+\S+.*|@preserve\b.*|(?:copied|vendored|imported|taken|forked|extracted) (?:from|at) \S.*\d.*|upstream:\s*\S+.*|\S+ v?\d+(?:\.\d+)+\s*\|\s*\(c\).*|version v?\d+(?:\.\d+)+,? (?:released|distributed|licensed) under\b.*)$")
_COMMENT = re.compile(r"^\s*(?:#(?!include|define|if|pragma|!\[|\[)|//|/\*|\*|--|<!--|;|\"\"\"|''')")
_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?)|[A-Za-z_$][\w$]*|[^\s\w]")
_DATA = re.compile(r"(?:-?0[xX][0-9a-fA-F]+[uUlL]*|-?\d[\d_.]*(?:[eE][+-]?\d+)?[uUlLfF]?|[\[\]{}(),;\s])+")
#: So many names that count up from nought are a generator's; people write a few.
COUNTED = 5
#: Names that are defined: functions and methods, types, fields; numbered names end in the group.
_DEFINED = re.compile(r"(?m)^[ \t]*(?:(?:export|public|private|protected|static|final|async|abstract)[ \t]+)*(?:def|func(?:tion)?(?:[ \t]*\([^)\n]*\))?|class|interface|type|struct|enum|message|fn)[ \t]+([A-Za-z_]\w*)|^[ \t]*private[ \t]+[\w<>\[\].]+[ \t]+(\w+)_;")
_NOUGHT = re.compile(r"[A-Za-z_]0(?:_;|[ \t]*[({<?:=])")


_CODED = re.compile(r"\s*[\"'`][A-Za-z0-9+/=_-]{36,}[\"'`]\s*[,;+.\\]?\s*")


_DIRECTIVE = re.compile(r"^\s*(?:#!|<\?(?:php|xml)\b|<!doctype\b|@charset\b|package\b|['\"]use strict['\"];?\s*$)", re.I)


def leading(lines: list[str]) -> str:
    """The comments above the first line of code, however many."""
    out = []
    block = ""
    for line in lines:
        s = line.strip()
        if block:
            out.append(s)
            if block in s:
                block = ""
        elif _COMMENT.match(line):
            out.append(s)
            if s.startswith("/*") and "*/" not in s:
                block = "*/"
            elif s.startswith("<!--") and "-->" not in s:
                block = "-->"
            elif s[:3] in ('"""', "'''") and s.count(s[:3]) < 2:
                block = s[:3]
        elif s and not _DIRECTIVE.match(line):
            break
    return "\n".join(out)


def minified(text: str, lines: list[str]) -> bool:
    """Long lines with next to no blanks, made of short names and marks."""
    full = [x for x in lines if x.strip()]
    code = [x for x in full if not _COMMENT.match(x)] or full
    longest = max(map(len, code))
    if longest < 300:
        return False
    body = "\n".join(code)
    long = sum(len(x) for x in code if len(x) > 250)
    blanks = sum(body.count(c) for c in " \t") / max(1, len(body))
    marks = sum(body.count(c) for c in ";{}(),=:") / max(1, len(body))
    return long > 0.6 * len(body) and blanks < 0.07 and marks > 0.08


def data(text: str, lines: list[str]) -> bool:
    """Mostly long rows of numbers or of encoded bytes, or one row after the other put into a table."""
    digits = sum(map(text.count, "0123456789"))
    if digits > 0.15 * len(text) and sum(1 for x in lines if len(x) > 20 and _DATA.fullmatch(x)) >= 12:
        tokens = _TOKEN.findall(text)
        numbers = sum(1 for t in tokens if t[0].isdigit() or (t[0] == "-" and len(t) > 1))
        if numbers >= 120 and numbers >= 0.3 * len(tokens):
            return True
    if sum(1 for x in lines if len(x) > 40 and _CODED.fullmatch(x)) >= max(10, 0.5 * sum(1 for x in lines if x.strip())):
        return True
    inserts = text.count("INSERT INTO") + text.count("insert into")
    if inserts >= 10 and inserts >= 0.9 * sum(1 for x in lines if x.strip()):
        return True
    longest = max(lines, key=len)
    if len(text) > 2000 and len(longest) > 400:
        blob = max(map(len, re.findall(r"[A-Za-z0-9+/]{400,}={0,2}", text)), default=0)
        return blob > 0.7 * len(text)
    return False


def templated(text: str, lines: list[str]) -> bool:
    """Definitions whose names count up from nought, as generators name them."""
    if _NOUGHT.search(text):
        names = [a or b for a, b in _DEFINED.findall(text)]
        fields = [b for b in names if b[-1:].isdigit() and "_" in b]
        for some in (names, fields):
            k = 0
            for name in some:
                if name.endswith(str(k)) and (len(name) <= len(str(k)) or k or not name.endswith("00")):
                    k += 1
            if k >= COUNTED and k >= 0.7 * len(some):
                return True
    escapes = text.count("\\x")
    return escapes >= 30 and escapes * 4 > 0.2 * len(text)


#: A word of each alternative of the notices, to look for first.
_GENERATED_HINTS = ("generated", "do not edit", "overwritten", "lost", "discarded", "output of", "erzeugt", "generiert", "généré", "genere", "generado")
_VENDORED_HINTS = ("@license", "@preserve", "copied", "vendored", "imported", "taken", "forked", "extracted", "upstream", "(c)", "version")


def verdict(path: str, text: str, lines: list[str]) -> tuple[str | None, str | None]:
    """(kind by the composition of tokens, kind by notices, name and folder) of a file."""
    name = path.rsplit("/", 1)[-1]
    ending = name.rsplit(".", 1)[-1].lower()
    if LOCKS.search(path) or (ending in ("json", "yaml", "yml", "lock", "toml") and LOCK_TEXT.search(text)):
        return None, "lock file"
    if ending not in SOURCE:
        return None, ("generated" if ending not in ("md", "txt", "rst") and GENERATED_PLACE.search(path) and GENERATED.search(leading(lines)) else None)
    tokens = "minified" if minified(text, lines) else "data" if data(text, lines) else "generated" if templated(text, lines) else None
    if tokens:
        return tokens, None
    head = leading(lines)
    low = head.lower()
    if GENERATED_NAME.search(name) or GENERATED_PLACE.search(path) or (any(w in low for w in _GENERATED_HINTS) and GENERATED.search(head)):
        return None, "generated"
    if MINIFIED_NAME.search(name) and len(text) > 200 and max(map(len, lines)) > 150:
        return None, "minified"
    return None, ("vendored" if VENDOR_PLACE.search(path) or (any(w in low for w in _VENDORED_HINTS) and VENDORED.search(head)) else None)


_NAMED = re.compile(r"[A-Za-z_]\w{2,}")


def telling(lines: list[str]) -> np.ndarray:
    """Hashes of the lines that say something: two names at least, no import, no notice."""
    out = []
    for line in lines:
        s = line.strip()
        if len(s) < 16 or s.startswith(("import ", "#include", "package ", "use ", "SPDX", "Copyright")) or len(_NAMED.findall(s)) < 2:
            continue
        out.append(xxhash.xxh3_64_intdigest(s))
    return np.unique(np.array(out, np.uint64)).view(np.int64) if out else np.zeros(0, np.int64)


_ONE = "path string, service string, file bigint, digest binary, tokens string, notice string, lines int, hashes array<bigint>"
_ONE_ARROW = pa.schema([("path", pa.string()), ("service", pa.string()), ("file", pa.int64()), ("digest", pa.binary()), ("tokens", pa.string()), ("notice", pa.string()), ("lines", pa.int32()), ("hashes", pa.list_(pa.int64()))])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for path, text, _ in texts(batches):
            if not text.strip():
                continue
            lines = text.split("\n")
            tokens, notice = verdict(path, text, lines)
            hashes = telling(lines) if path.rsplit(".", 1)[-1].lower() in SOURCE else None
            enough = hashes is not None and len(hashes) >= LEAST_SHARED
            yield path, path.split("/", 1)[0], xxhash.xxh3_64_intdigest(path) - (1 << 63), xxhash.xxh3_128_digest(hashes.tobytes()) if enough else None, tokens, notice, len(hashes) if enough else 0, hashes.tolist() if enough else None

    yield from packed(rows(), _ONE_ARROW, rows_each=1024)


def judged(lines: DataFrame, rare: int = RARE, contained: float = CONTAINED) -> DataFrame:
    """(path, kind, evidence, containment, shared lines, lines) of each file; kind is null for hand-written ones.

    Hot hashes and hot contents are pre-aggregated where they are counted and
    split by the skew join where they are joined.
    """
    runs = packed_lines(lines).repartition("path").sortWithinPartitions(F.xxhash64("path"), "path")
    one = materialize(runs.mapInArrow(_read, _ONE), "p1-files")
    files = one.select("path", "service", "file", "digest", "tokens", "notice", "lines")
    sole = F.when(F.min("service") == F.max("service"), F.min("service"))
    contents = materialize(files.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("file").alias("content"), sole.alias("home"), F.count("*").alias("copies"), F.first("lines").alias("of")), "p1-contents")
    holders = contents.select(F.col("content").alias("file"), "home", "copies", "of")
    index = one.where(F.col("digest").isNotNull()).select("file", "hashes").join(holders, "file").select(F.explode("hashes").alias("hash"), F.col("file").alias("content"), "home", "copies", "of")

    who = [F.col("content"), F.col("home")]
    stands = F.array(
        _named(F.min(F.struct((-F.col("copies")).alias("k"), *who))),
        _named(F.min(F.struct(F.coalesce("home", F.lit("")).alias("k"), *who))),
        _named(F.max(F.struct(F.coalesce("home", F.lit("")).alias("k"), *who))),
        _named(F.min(F.struct(F.xxhash64("content").alias("k"), *who))),
    )
    # Most lines are of one content; who stands for a line is asked of the others only.
    several = index.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    common = materialize(index.join(several, "hash"), "p1-common")
    held = materialize(common.drop("copies").join(common.groupBy("hash").agg(stands.alias("stands")), "hash"), "p1-held")

    # A copy needs ``need`` of its rare lines in one partner, or the share of all its lines.
    rarely = F.coalesce(F.sum(F.when(F.col("n") <= rare, 1)), F.lit(0))
    need = F.greatest(F.lit(LEAST_SHARED), F.ceil(F.col("rare_of") * contained - 1e-9))
    sums = held.groupBy("content", "home", "of").agg(F.count("*").alias("have"), rarely.alias("have_rare")).withColumn("rare_of", F.col("of") - F.col("have") + F.col("have_rare"))
    able = materialize(sums.where(F.col("home").isNotNull() & ((F.col("have_rare") >= need) | (F.col("have") >= F.greatest(F.lit(LEAST_SHARED), F.col("of") * contained)))), "p1-able")
    line_of = held.select("hash", "content", "n", F.array_distinct("stands").alias("stands"))
    elsewhere = F.col("partner_home").isNull() | (F.col("partner_home") != F.col("home"))
    asked = able.select("content", "home").join(line_of, "content")
    proposed = (
        asked.select("content", "home", F.explode("stands").alias("s")).select("content", "home", F.col("s.content").alias("partner"), F.col("s.home").alias("partner_home"))
        .where((F.col("content") != F.col("partner")) & elsewhere).groupBy("content", "partner").agg(F.count("*").alias("links")).where(F.col("links") >= LEAST_SHARED).select("content", "partner")
    )
    first = materialize(_counted(proposed, held, able, contents, rare), "p1-first")
    found = first.where(F.col("containment") >= contained).select("content").distinct()

    # A content with ``need`` of its rare lines in a partner has ``HITS`` of any (rare_of - need + HITS) of them in it.
    left = able.join(found, "content", "left_anti").select("content", "home", (F.col("have_rare") - need + HITS).alias("ask"))
    order = Window.partitionBy("content").orderBy("n", "hash")
    asks = left.where(F.col("ask") >= HITS).join(line_of.where(F.col("n") <= rare), "content").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("ask"))
    others = asks.select("hash", "content", "home").join(held.select("hash", F.col("content").alias("partner"), F.col("home").alias("partner_home")), "hash").where((F.col("content") != F.col("partner")) & elsewhere).groupBy("content", "partner").agg(F.count("*").alias("hits")).where(F.col("hits") >= HITS).select("content", "partner")
    second = _counted(others, held, able, contents, rare)

    best = first.unionByName(second).groupBy("content").agg(F.max(F.struct("containment", "shared")).alias("best"))
    spread = F.col("home").isNull()
    known = contents.join(best, "content", "left").select(
        "digest", (spread | F.coalesce(F.col("best.containment") >= contained, F.lit(False))).alias("copy"), F.when(spread, 1.0).otherwise(F.col("best.containment")).alias("containment"), F.when(spread, F.col("of").cast("bigint")).otherwise(F.col("best.shared")).alias("shared_lines")
    )
    copy = F.coalesce("copy", F.lit(False))
    return files.join(known, "digest", "left").select(
        "path",
        F.when(copy, F.lit("vendored")).otherwise(F.coalesce("tokens", "notice")).alias("kind"),
        F.when(copy, F.lit("containment")).when(F.col("tokens").isNotNull(), F.lit("tokens")).when(F.col("notice").isNotNull(), F.lit("notice")).alias("evidence"),
        "containment", "shared_lines", "lines",
    )


def _named(s: Column) -> Column:
    return F.struct(s["content"].alias("content"), s["home"].alias("home"))


def _counted(pairs: DataFrame, held: DataFrame, able: DataFrame, contents: DataFrame, rare: int) -> DataFrame:
    """(content, containment, shared) of each pair, by a join of both sides' lines."""
    mine = held.select("content", "hash", (F.col("n") <= rare).cast("int").alias("rare"))
    theirs = held.select(F.col("content").alias("partner"), "hash")
    both = pairs.join(mine, "content").join(theirs, ["partner", "hash"]).groupBy("content", "partner").agg(F.count("*").alias("shared"), F.sum("rare").alias("rare")).where(F.col("shared") >= LEAST_SHARED)
    sized = both.join(able.select("content", "of", "rare_of"), "content").join(contents.select(F.col("content").alias("partner"), F.col("of").alias("partner_of")), "partner")
    by_rare = F.when(F.col("rare") >= LEAST_SHARED, F.col("rare") / F.col("rare_of")).otherwise(0.0)
    alike = F.least(F.col("shared") / F.col("of"), F.col("shared") / F.col("partner_of"))
    return sized.select("content", F.greatest(by_rare, alike).alias("containment"), "shared")


def found(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind").isNotNull()).select("path").distinct()


def hand_written(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind").isNull()).select("path").distinct()
