"""The registered queries over the engine's own operators, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions import fixed
from loamdex.functions.globs import file_expressions
from loamdex.operators import chunks, embed, extract, fulltext, hybrid, maintain, scan, spans, symbols, vectors
from loamdex.operators.textindex import TextIndex
from loamdex.sources import registry as services_of
from loamdex.streaming import watch
from loamdex.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The lines, each once: what an index of the scanned tree holds."""
    rows = read_table(spark, d, "lines_fts").where(F.col("path").isNotNull() & F.col("line").isNotNull())
    return rows.select("path", "line", F.coalesce("content", F.lit("")).alias("content")).distinct()


_INDEXES: dict[tuple[str, str], TextIndex] = {}


def text_index(spark: SparkSession, d: str) -> TextIndex:
    """The full-text index of a folder's lines, built by the first query of a session that asks for it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = TextIndex.build(corpus(spark, d))
    return _INDEXES[key]


# The corpus in SQL: distinct lines with their tokens and length.
_D = r"""
d AS (SELECT path, line, content, regexp_extract_all(lower(strip_accents(content)), '[\p{L}\p{N}]+') AS tokens FROM (SELECT DISTINCT path, line, coalesce(content, '') AS content FROM lines_fts WHERE path IS NOT NULL AND line IS NOT NULL)),
t AS (SELECT *, len(tokens) AS dl FROM d)
"""


def _tf(phrase: str) -> str:
    """The count of a phrase in SQL; a star makes the last token a prefix, a caret asks for the start."""
    first, prefix = phrase.startswith("^"), phrase.endswith("*")
    words = phrase.strip("^*").split()
    if len(words) == 1 and not first:
        return f"len(list_filter(tokens, lambda x: {'starts_with(x, ' + repr(words[0]) + ')' if prefix else 'x = ' + repr(words[0])}))"
    ok = " AND ".join(f"starts_with(tokens[i + {j}], '{w}')" if prefix and j == len(words) - 1 else f"tokens[i + {j}] = '{w}'" for j, w in enumerate(words))
    if first:
        return f"CASE WHEN {ok.replace('i + ', '1 + ')} THEN 1 ELSE 0 END"
    return f"len(list_filter(range(1, len(tokens) - {len(words) - 2}), lambda i: {ok}))"


def _bm25_sql(phrases: list[str], match: str, scored: list[str] | None = None, keep: str = "true", limit: int = 30, fetch: int | None = None) -> str:
    """SQL for a ranked search; in ``match`` and ``scored`` the counts are n0, n1, ..."""
    counts = ", ".join(f"{_tf(p)} AS n{i}" for i, p in enumerate(phrases))
    held = ", ".join(f"sum(CASE WHEN n{i} > 0 THEN 1 ELSE 0 END)::DOUBLE AS df{i}" for i in range(len(phrases)))
    parts = []
    for i in range(len(phrases)):
        c = (scored or [f"n{k}" for k in range(len(phrases))])[i]
        if c == "0":
            continue
        raw = f"ln((N - df{i} + 0.5) / (df{i} + 0.5))"
        parts.append(f"(CASE WHEN {raw} > 0 THEN {raw} ELSE 1e-6 END) * ({c}) * 2.2 / (({c}) + 1.2 * (1 - 0.75 + 0.75 * dl / (total / N)))")
    inner = f"SELECT path, line, content, -({' + '.join(parts)}) AS score FROM c, s WHERE {match}"
    if fetch:
        inner = f"SELECT * FROM ({inner}) ORDER BY score, path, line LIMIT {fetch}"
    return f"""
    WITH {_D}, c AS (SELECT *, {counts} FROM t),
    s AS (SELECT count(*)::DOUBLE AS N, sum(dl)::DOUBLE AS total, {held} FROM c)
    SELECT path, line, content, round(score, 6) AS score FROM (SELECT * FROM ({inner}) WHERE {keep} ORDER BY score, path, line LIMIT {limit})
    """


def _text(query: str, **options) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return text_index(spark, d).search(query, **options).withColumn("score", F.round("score", 6))

    return run


def _glob_sql(patterns: str | list[str]) -> str:
    pieces = patterns.split(",") if isinstance(patterns, str) else patterns
    return " OR ".join(f"regexp_matches(path, '{e}')" for e in file_expressions(p.strip() for p in pieces)) or "false"


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _named(name: str, sql: str | None = None):
    def wrap(f: Query) -> Query:
        _add(name, f, sql)
        return f

    return wrap


# ---- full text

_add("text_term", _text("snapshot"), _bm25_sql(["snapshot"], "n0 > 0"))
_add("text_and", _text("owner AND group OR (manifest AND index)"), _bm25_sql(["owner", "group", "manifest", "index"], "(n0 > 0 AND n1 > 0) OR (n2 > 0 AND n3 > 0)", ["CASE WHEN n0 > 0 AND n1 > 0 THEN n0 ELSE 0 END", "CASE WHEN n0 > 0 AND n1 > 0 THEN n1 ELSE 0 END", "CASE WHEN n2 > 0 AND n3 > 0 THEN n2 ELSE 0 END", "CASE WHEN n2 > 0 AND n3 > 0 THEN n3 ELSE 0 END"]))
_add("text_implicit_and", _text("public final"), _bm25_sql(["public", "final"], "n0 > 0 AND n1 > 0"))
_add("text_or", _text("ledger OR harbor"), _bm25_sql(["ledger", "harbor"], "n0 > 0 OR n1 > 0"))
_add("text_not", _text("import NOT java"), _bm25_sql(["import", "java"], "n0 > 0 AND n1 = 0", ["n0", "0"]))
_add("text_phrase", _text('"the parcel"'), _bm25_sql(["the parcel"], "n0 > 0"))
_add("text_joined", _text("handed_to + the"), _bm25_sql(["handed to the"], "n0 > 0"))
_add("text_prefix", _text("snap* AND re*"), _bm25_sql(["snap*", "re*"], "n0 > 0 AND n1 > 0"))
_add("text_initial", _text("^ return"), _bm25_sql(["^return"], "n0 > 0"))
_add("text_fallback", _text("differs(from"), _bm25_sql(["differs from"], "n0 > 0"))
_add("text_fallback_hit", _text('the "anchor point'), _bm25_sql(["the anchor point"], "n0 > 0"))
_add("text_column", _text("content : token"), _bm25_sql(["token"], "n0 > 0"))
_add("text_unindexed_column", _text("path : token"), _bm25_sql(["token"], "n0 < 0"))
_add("text_glob", _text("queue", include="**/tests/**,src/**"), _bm25_sql(["queue"], "n0 > 0", keep=_glob_sql("**/tests/**,src/**")))
_add("text_exclude", _text("queue", include="*.py", exclude="**/tests/**"), _bm25_sql(["queue"], "n0 > 0", keep=f"({_glob_sql('*.py')}) AND NOT ({_glob_sql('**/tests/**')})"))
_add("text_parity", _text("queue", include="*.go", limit=10, parity=True), _bm25_sql(["queue"], "n0 > 0", keep=_glob_sql("*.go"), limit=10, fetch=80))


@_named("text_near", f"WITH {_D} SELECT path, line FROM t WHERE len(list_filter(range(1, len(tokens) + 1), lambda i: tokens[i] = 'the' AND len(list_filter(range(1, len(tokens) + 1), lambda j: tokens[j] = 'before' AND abs(i - j) <= 4)) > 0)) > 0")
def text_near(spark: SparkSession, d: str) -> DataFrame:
    return text_index(spark, d).ranked("NEAR(the before, 3)").select("path", "line")


@_named("corpus_stats", f"WITH {_D} SELECT count(*) AS lines, sum(dl)::BIGINT AS tokens, round(sum(dl)::DOUBLE / count(*), 6) AS mean_length FROM t")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = text_index(spark, d).statistics()
    return rows.select(F.col("_N").alias("lines"), F.col("_len").alias("tokens"), F.round(F.col("_len") / F.col("_N"), 6).alias("mean_length"))


@_named("postings_top", f"WITH {_D}, x AS (SELECT path, line, unnest(tokens) AS token FROM t) SELECT token, count(DISTINCT (path, line)) AS lines, count(*) AS occurrences FROM x GROUP BY token ORDER BY lines DESC, token LIMIT 50")
def postings_top(spark: SparkSession, d: str) -> DataFrame:
    return text_index(spark, d).postings.groupBy("token").agg(F.count(F.lit(1)).alias("lines"), F.sum("tf").alias("occurrences")).orderBy(F.desc("lines"), "token").limit(50)


@_named("text_by_postings", _bm25_sql(["ledger", "harbor"], "n0 > 0 OR n1 > 0", limit=1_000_000).replace("SELECT path, line, content, round(", "SELECT path, line, round("))
def text_by_postings(spark: SparkSession, d: str) -> DataFrame:
    """All matches of a query with their scores, from the postings alone."""
    return text_index(spark, d).ranked("ledger OR harbor").withColumn("score", F.round("score", 6))


_add("text_by_scan", lambda s, d: fulltext.search(corpus(s, d), "ledger OR harbor", 1000).withColumn("score", F.round("score", 6)), _bm25_sql(["ledger", "harbor"], "n0 > 0 OR n1 > 0", limit=1000))


# ---- symbols, outlines, spans

_SYMBOLS = "SELECT DISTINCT path, name, kind, start_line, end_line FROM symbols"


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "symbols").select(*symbols.HIT).distinct()


_add("symbol_exact", lambda s, d: symbols.search(_symbols(s, d), "Sensor", exact=True), f"SELECT * FROM ({_SYMBOLS}) WHERE name = 'Sensor' ORDER BY path, start_line, end_line, kind LIMIT 30")
_add("symbol_substring", lambda s, d: symbols.search(_symbols(s, d), "LEDGER", 50), f"SELECT * FROM ({_SYMBOLS}) WHERE lower(name) LIKE '%ledger%' ORDER BY length(name), path, start_line, name, kind LIMIT 50")
_add("symbol_wildcard", lambda s, d: symbols.search(_symbols(s, d), "scan_p%", 50), f"SELECT * FROM ({_SYMBOLS}) WHERE lower(name) LIKE '%scan_p%%' ORDER BY length(name), path, start_line, name, kind LIMIT 50")
_add("symbol_glob", lambda s, d: symbols.search(_symbols(s, d), "queue", 40, include="*.py,*.go", exclude="**/tests/**"), f"SELECT * FROM ({_SYMBOLS}) WHERE lower(name) LIKE '%queue%' AND ({_glob_sql('*.py,*.go')}) AND NOT ({_glob_sql('**/tests/**')}) ORDER BY length(name), path, start_line, name, kind LIMIT 40")


@_named("file_outlines", f"SELECT path, count(*) AS symbols, string_agg('L' || start_line || '-' || end_line || chr(9) || kind || chr(9) || name, chr(10) ORDER BY start_line, end_line, name, kind) AS outline FROM ({_SYMBOLS}) GROUP BY path")
def file_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Every file's outline."""
    row = F.format_string("L%d-%d\t%s\t%s", "start_line", "end_line", "kind", "name")
    rows = _symbols(spark, d).withColumn("_r", F.struct("start_line", "end_line", "name", "kind", row.alias("text")))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("symbols"), F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda x: x["text"]), "\n").alias("outline"))


@_named("span_lines", "SELECT path, line, content FROM (SELECT DISTINCT path, line, coalesce(content, '') AS content FROM lines_fts) WHERE path = (SELECT min(path) FROM lines_fts) AND line BETWEEN 1 AND 14")
def span_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lines_fts")
    first = rows.agg(F.min("path")).first()[0]
    return spans.lines_between(rows, first, 3, 10, 4)


@_named("symbol_bodies", f"SELECT s.path, s.name, s.start_line, string_agg(l.content, chr(10) ORDER BY l.line) AS body FROM ({_SYMBOLS}) s JOIN (SELECT DISTINCT path, line, coalesce(content, '') AS content FROM lines_fts) l ON l.path = s.path AND l.line BETWEEN s.start_line AND s.end_line WHERE s.kind = 'struct' GROUP BY s.path, s.name, s.kind, s.start_line, s.end_line")
def symbol_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each struct, as its SQL has them."""
    return _bodies(_symbols(spark, d).where("kind = 'struct'"), read_table(spark, d, "lines_fts")).drop("kind", "end_line")


@_named("symbol_bodies_all")
def symbol_bodies_all(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each symbol of any kind: a span read for a relation of spans."""
    return _bodies(_symbols(spark, d), read_table(spark, d, "lines_fts"))


def _bodies(s: DataFrame, lines: DataFrame) -> DataFrame:
    """Repeated lines are dropped body by body: lines move once, to their path."""
    rows = s.join(lines.select("path", "line", F.coalesce("content", F.lit("")).alias("content")), "path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("line", "content"))), lambda x: x["content"]), "\n")
    return rows.groupBy("path", "name", "kind", "start_line", "end_line").agg(body.alias("body"))


# ---- windows and vectors

_LINES = r"CASE WHEN list_last(p) = '' THEN p[1:len(p) - 1] ELSE p END AS l FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS p FROM documents WHERE text IS NOT NULL)"
_WINDOWS = f"SELECT doc_id, (i + 1)::INT AS start_line, least(i + 60, len(l))::INT AS end_line, array_to_string(l[i + 1:least(i + 60, len(l))], chr(10)) AS chunk FROM (SELECT doc_id, l, unnest(range(0, greatest(0, ceil((len(l) - 60) / 45.0))::INT * 45 + 1, 45)) AS i FROM (SELECT doc_id, {_LINES}) WHERE len(l) > 0)"


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return chunks.windows(read_table(spark, d, "documents").select("doc_id", "text"))


@_named("chunk_windows", f"SELECT doc_id, start_line, end_line, length(chunk) AS chars FROM ({_WINDOWS}) WHERE regexp_matches(chunk, '[^\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x0b]')")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("doc_id", "start_line", "end_line", F.length("chunk").cast("bigint").alias("chars"))


_UUID = "substr(h, 1, 12) || '5' || substr(h, 14, 3) || lower(substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1)) || substr(h, 18, 15)"


@_named("point_ids", f"SELECT path, start_line, end_line, {_UUID} AS point_id FROM (SELECT DISTINCT path, start_line, end_line, substr(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(path || ':' || start_line || '-' || end_line)), 1, 32) AS h FROM semantic_hits)")
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "semantic_hits").select("path", "start_line", "end_line").distinct()
    return rows.withColumn("point_id", chunks.point_id(F.col("path"), F.col("start_line"), F.col("end_line")))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    rows = read_table(spark, d, "embeddings")
    query = rows.where(F.col("vec_id") == rows.agg(F.min("vec_id")).first()[0]).first()["embedding"]
    return vectors.with_norms(rows), [float(x) for x in query]


_COSINE = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE embedding IS NOT NULL)"


@_named("cosine_topk", f"{_COSINE} SELECT vec_id, label, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 10)")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows, q = _vectors(spark, d)
    return vectors.nearest(rows, q, 10, key="vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@_named("cosine_threshold", f"{_COSINE} SELECT vec_id, label, round(score, 6) AS score FROM (SELECT * FROM s WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 200)")
def cosine_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows, q = _vectors(spark, d)
    return vectors.nearest(rows, q, 200, 0.2, key="vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@_named("hits_above", "SELECT DISTINCT hit_id, path, start_line, end_line, score FROM semantic_hits WHERE score >= 0.5")
def hits_above(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "semantic_hits").where(F.col("score") >= 0.5).select("hit_id", "path", "start_line", "end_line", "score").distinct()


@_named("semantic_windows")
def semantic_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of documents embedded offline, and the ten closest to a question."""
    rows = chunks.points(_windows(spark, d).withColumn("path", F.format_string("doc/%d", "doc_id")))
    have = embed.embedded(rows, lambda: embed.HashEmbedder(64)).where(~F.col("failed"))
    question = embed.HashEmbedder(64).embed(["the queue was sealed before the snapshot"])[0]
    return vectors.nearest(vectors.with_norms(have), question, 10).select("path", "start_line", "end_line", F.round("score", 6).alias("score"))


@_named("hybrid_sections")
def hybrid_sections(spark: SparkSession, d: str) -> DataFrame:
    """All three sections; the vectors of the embeddings table stand for points."""
    rows, q = _vectors(spark, d)
    key = F.lpad(F.col("vec_id").cast("string"), 12, "0")
    points = rows.select(key.alias("point_id"), F.concat(F.lit("vec/"), key).alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("label").cast("string").alias("preview"), "embedding", "norm")
    return hybrid.search(text_index(spark, d), _symbols(spark, d), "ledger", 8, points, q).withColumn("score", F.round("score", 6))


SQL["hybrid_sections"] = f"""
    SELECT 'Symbols' AS section, row_number() OVER (ORDER BY length(name), path, start_line, name, kind)::INT AS ord, path, start_line, end_line, kind || ' ' || name AS label, NULL::DOUBLE AS score
    FROM (SELECT * FROM ({_SYMBOLS}) WHERE lower(name) LIKE '%ledger%' ORDER BY length(name), path, start_line, name, kind LIMIT 8)
    UNION ALL
    SELECT 'Text', row_number() OVER (ORDER BY score, path, line)::INT, path, line, line, content, score FROM ({_bm25_sql(["ledger"], "n0 > 0", limit=8)})
    UNION ALL
    SELECT 'Semantic', row_number() OVER (ORDER BY score DESC, vec_id)::INT, 'vec/' || lpad(vec_id::VARCHAR, 12, '0'), 1, 1, label::VARCHAR, round(score, 6)
    FROM ({_COSINE} SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 8)
"""


# ---- scanning

_SUFFIX = r"lower(regexp_extract(path, '(?:^|/)[^/]*[^/.](?:\.*)(\.[^/.]+)$', 1))"
_NAME = "lower(list_last(string_split(path, '/')))"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_KEPT = f"""
    NOT list_has_any(string_split(path, '/')[1:len(string_split(path, '/')) - 1], [{", ".join(f"'{v}'" for v in fixed.IGNORED_FOLDERS)}])
    AND len(list_filter(string_split(path, '/')[1:len(string_split(path, '/')) - 1], lambda x: starts_with(x, '.') AND x NOT IN {_in(fixed.KEPT_DOT_FOLDERS)})) = 0
    AND {_NAME} NOT IN {_in(fixed.IGNORED_NAMES)} AND {" AND ".join(f"NOT contains({_NAME}, '{m}')" for m in fixed.MINIFIED_PARTS)}
    AND ({_SUFFIX} IN {_in(fixed.TEXT_EXTENSIONS)} OR {_NAME} IN {_in(fixed.TEXT_NAMES)}) AND {" AND ".join(f"NOT contains(lower(path), '{m}')" for m in fixed.IGNORED_PARTS)}
    AND size <= CASE WHEN {_SUFFIX} IN {_in(fixed.DOC_EXTENSIONS)} THEN {fixed.MAX_DOC_BYTES} ELSE {fixed.MAX_FILE_BYTES} END
"""


@_named("scan_filters", f"SELECT DISTINCT path, size FROM files WHERE {_KEPT} AND NOT ({_glob_sql('**/docs/notes/**,*.sql')})")
def scan_filters(spark: SparkSession, d: str) -> DataFrame:
    return scan.indexable(read_table(spark, d, "files"), ["**/docs/notes/**", "*.sql"]).select("path", "size").distinct()


@_named("language_tags", f"SELECT language, count(DISTINCT path) AS files FROM (SELECT path, CASE {_SUFFIX} {' '.join(f'''WHEN '{e}' THEN '{x}' ''' for e, x in fixed.LANGUAGE_OF.items())} END AS language FROM files) GROUP BY language")
def language_tags(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").select("path", scan.language(F.col("path")).alias("language")).distinct().groupBy("language").agg(F.count(F.lit(1)).alias("files"))


@_named("long_line_guard", "SELECT path FROM lines_fts GROUP BY path HAVING max(length(coalesce(content, ''))) > 1000")
def long_line_guard(spark: SparkSession, d: str) -> DataFrame:
    """The guard with a limit that these tables reach."""
    return scan.long_lined(read_table(spark, d, "lines_fts"), 1000)


# ---- maintenance

_CURRENT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC, size DESC, indexed_at DESC NULLS LAST) AS rn FROM files) WHERE rn = 1"
_KNOWN = f"SELECT * FROM ({_CURRENT}) WHERE indexed_at IS NOT NULL"


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The scan and what the index knows: all current rows, and the oldest row of each path."""
    files = read_table(spark, d, "files")
    oldest = files.groupBy("path").agg(F.min(F.struct("mtime", "size")).alias("x")).select("path", "x.mtime", "x.size")
    return maintain.current(files), oldest


_OLD = "SELECT path, m.mtime AS mtime, m.size AS size FROM (SELECT path, min({'mtime': mtime, 'size': size}) AS m FROM files GROUP BY path)"

_add("current_files", lambda s, d: maintain.current(read_table(s, d, "files")).select("path", "mtime", "size", "lang"), f"SELECT path, mtime, size, lang FROM ({_CURRENT})")
_add("incr_changed", lambda s, d: maintain.changed(*_files(s, d)).select("path", "mtime", "size"), f"SELECT path, mtime, size FROM ({_CURRENT}) c WHERE NOT EXISTS (SELECT 1 FROM ({_OLD}) o WHERE o.path = c.path AND o.mtime = c.mtime AND o.size = c.size)")
_add("incr_gone", lambda s, d: maintain.gone(read_table(s, d, "lines_fts").where("path IS NOT NULL"), scan.indexable(read_table(s, d, "files")).select("path")), f"SELECT DISTINCT path FROM lines_fts WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM files WHERE {_KEPT})")
_add("orphaned_symbols", lambda s, d: maintain.gone(read_table(s, d, "symbols"), read_table(s, d, "files").select("path").distinct()), "SELECT DISTINCT path FROM symbols WHERE path NOT IN (SELECT path FROM files WHERE path IS NOT NULL)")


@_named("incr_upsert", f"SELECT path, mtime, size FROM ({_CURRENT}) UNION ALL SELECT o.path, o.mtime, o.size FROM ({_OLD}) o WHERE o.path NOT IN (SELECT path FROM ({_CURRENT}))")
def incr_upsert(spark: SparkSession, d: str) -> DataFrame:
    scanned, known = _files(spark, d)
    return maintain.upsert(known, maintain.changed(scanned, known).select("path", "mtime", "size"))


@_named("index_report", f"SELECT (SELECT count(*) FROM ({_CURRENT}) c WHERE NOT EXISTS (SELECT 1 FROM ({_OLD}) o WHERE o.path = c.path AND o.mtime = c.mtime AND o.size = c.size)) AS indexed, (SELECT count(*) FROM ({_CURRENT}) c WHERE EXISTS (SELECT 1 FROM ({_OLD}) o WHERE o.path = c.path AND o.mtime = c.mtime AND o.size = c.size)) AS skipped, 0::BIGINT AS removed, (SELECT count(*) FROM ({_SYMBOLS}) s WHERE s.path IN (SELECT c.path FROM ({_CURRENT}) c WHERE NOT EXISTS (SELECT 1 FROM ({_OLD}) o WHERE o.path = c.path AND o.mtime = c.mtime AND o.size = c.size))) AS symbols")
def index_report(spark: SparkSession, d: str) -> DataFrame:
    return maintain.report(*_files(spark, d), _symbols(spark, d))


@_named("delete_requested", "SELECT count(DISTINCT path) AS requested FROM fs_changes WHERE change_kind = 'deleted'")
def delete_requested(spark: SparkSession, d: str) -> DataFrame:
    return maintain.requested(read_table(spark, d, "fs_changes").where("change_kind = 'deleted'"))


@_named("delete_lines", "SELECT count(*) AS lines FROM lines_fts WHERE path NOT IN (SELECT path FROM fs_changes WHERE change_kind = 'deleted' AND path IS NOT NULL)")
def delete_lines(spark: SparkSession, d: str) -> DataFrame:
    gone = read_table(spark, d, "fs_changes").where("change_kind = 'deleted'")
    return maintain.delete(read_table(spark, d, "lines_fts"), gone).agg(F.count(F.lit(1)).alias("lines"))


@_named("service_stats", "SELECT s.service_id, s.name, coalesce(f.n, 0)::BIGINT AS files, coalesce(y.n, 0)::BIGINT AS symbols FROM services s LEFT JOIN (SELECT service_id, count(*) AS n FROM files GROUP BY 1) f USING (service_id) LEFT JOIN (SELECT service_id, count(*) AS n FROM symbols GROUP BY 1) y USING (service_id)")
def service_stats(spark: SparkSession, d: str) -> DataFrame:
    return maintain.service_stats(read_table(spark, d, "services"), read_table(spark, d, "files"), read_table(spark, d, "symbols"))


@_named("index_stats", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return maintain.stats(read_table(spark, d, "files"), read_table(spark, d, "symbols"))


@_named("registry_dedupe", "SELECT service_id, name, path FROM (SELECT service_id, upper(name) AS name, path FROM services WHERE ignore_globs IS NULL UNION ALL SELECT service_id, name, path FROM services WHERE ignore_globs IS NOT NULL)")
def registry_dedupe(spark: SparkSession, d: str) -> DataFrame:
    found = read_table(spark, d, "services")
    explicit = found.where("ignore_globs IS NULL").withColumn("name", F.upper("name"))
    return services_of.deduplicated(explicit, found)


# ---- events

_RELEVANT = f"path IS NOT NULL AND NOT list_has_any(string_split(path, '/'), [{', '.join(repr(v) for v in fixed.IGNORED_FOLDERS)}]) AND ({_SUFFIX} IN {_in(fixed.TEXT_EXTENSIONS)} OR {_NAME} IN {_in(fixed.TEXT_NAMES)})"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return watch.relevant(watch.once(read_table(spark, d, "fs_changes")))


_ONCE = "SELECT change_id, min_by(service_id, received_at) AS service_id, min_by(path, received_at) AS path, min_by(change_kind, received_at) AS change_kind, min_by(event_ts, received_at) AS event_ts FROM fs_changes GROUP BY change_id"
_add("events_relevant", lambda s, d: _events(s, d).groupBy("change_kind").agg(F.count(F.lit(1)).alias("events")), f"SELECT change_kind, count(*) AS events FROM ({_ONCE}) WHERE {_RELEVANT} GROUP BY change_kind")


@_named("events_debounce", f"WITH e AS (SELECT * FROM ({_ONCE}) WHERE {_RELEVANT}), g AS (SELECT *, CASE WHEN event_ts - lag(event_ts) OVER w > INTERVAL 3 SECOND OR lag(event_ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY service_id ORDER BY event_ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY service_id ORDER BY event_ts ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT service_id, epoch_us(min(event_ts)) AS first_us, count(*) AS events FROM b GROUP BY service_id, burst")
def events_debounce(spark: SparkSession, d: str) -> DataFrame:
    return watch.debounced(_events(spark, d)).select("service_id", F.unix_micros("first_ts").alias("first_us"), "events")


@_named("symbols_extracted")
def symbols_extracted(spark: SparkSession, d: str) -> DataFrame:
    """The symbol table made anew from the texts of all files whose language is known by their row or extension."""
    files = read_table(spark, d, "files").where(F.col("path").isNotNull())
    lang = files.groupBy("path").agg(F.max_by("lang", "mtime").alias("lang")).select("path", F.coalesce("lang", scan.language(F.col("path"))).alias("lang"))
    lines = read_table(spark, d, "lines_fts").where(F.col("path").isNotNull() & F.col("line").isNotNull())
    return extract.symbols_of_lines(lines, lang.where(F.col("lang").isNotNull()))


@_named("symbols_confirmed", f"SELECT * FROM ({_SYMBOLS}) WHERE path IN (SELECT path FROM lines_fts WHERE path IS NOT NULL)")
def symbols_confirmed(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the symbol table that extraction gives again; all of files that still have lines, if nothing is missed."""
    return symbols_extracted(spark, d).join(_symbols(spark, d), ["path", "name", "kind", "start_line", "end_line"], "left_semi").distinct()


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
