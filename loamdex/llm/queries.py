"""The registered queries of this package, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamdex.llm import credentials, documenting, encoding, mixing, origin, parsing, sharedspans, splitting, tokenizing
from loamdex.tables import read_table


def p1_judged(spark: SparkSession, d: str) -> DataFrame:
    return origin.judged(read_table(spark, d, "lines_fts"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return origin.found(p1_judged(spark, d))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_hits(read_table(spark, d, "semantic_hits"), read_table(spark, d, "files"), read_table(spark, d, "chunk_limits"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(p2_pieces(spark, d))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documenting.documented(read_table(spark, d, "symbols"), read_table(spark, d, "lines_fts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return documenting.found(p3_pairs(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.Shared(read_table(spark, d, "lines_fts")).pairs()


def p4_shared(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.Shared(read_table(spark, d, "lines_fts")).coverage()


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.Shared(read_table(spark, d, "lines_fts")).links()


def p5_parsed(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parsed(read_table(spark, d, "files"), read_table(spark, d, "lines_fts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.found(p5_parsed(spark, d))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rates(p5_parsed(spark, d))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(read_table(spark, d, "lines_fts"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.found(p6_redacted(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizing.encode(read_table(spark, d, "documents"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return tokenizing.token_counts(read_table(spark, d, "documents").select("doc_id", "source", "text"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    from loamdex.tables import materialize

    return mixing.report(materialize(_counts(spark, d), "p8-counts"), read_table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    from loamdex.tables import materialize

    return mixing.mix(materialize(_counts(spark, d), "p8-counts"), read_table(spark, d, "mix_targets"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged(read_table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.found(p9_restored(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


#: Texts of at least 400 characters, each once, with their windows; windows that several texts have.
_SHARED_SQL = """
    d AS (SELECT DISTINCT path, line, coalesce(content, '') AS content FROM lines_fts WHERE path IS NOT NULL AND line IS NOT NULL),
    t AS (SELECT path, string_agg(content, chr(10) ORDER BY line, content) AS text FROM d GROUP BY path),
    u AS (SELECT min(path) AS rep, count(*) AS copies, text FROM t GROUP BY text HAVING length(text) >= 400),
    w AS (SELECT rep, i, md5(substr(text, i, 400)) AS h FROM (SELECT rep, text, unnest(range(1, length(text) - 398)) AS i FROM u)),
    m AS (SELECT h FROM w GROUP BY h HAVING min(rep) <> max(rep)),
    s AS (SELECT rep, i, h FROM w WHERE h IN (SELECT h FROM m)),
    p AS (SELECT DISTINCT a.rep AS x, b.rep AS y FROM (SELECT DISTINCT rep, h FROM s) a JOIN (SELECT DISTINCT rep, h FROM s) b USING (h) WHERE a.rep <> b.rep)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries it can express."""
    return {
        "p2_found": """
            WITH current AS (SELECT path, arg_max(lang, mtime) AS lang FROM files WHERE path IS NOT NULL GROUP BY path),
            wanted AS (
                SELECT h.hit_id, h.preview, coalesce(l.max_chars, o.max_chars) AS max_chars
                FROM semantic_hits h LEFT JOIN current c USING (path) LEFT JOIN chunk_limits l ON l.lang = c.lang LEFT JOIN chunk_limits o ON o.lang = 'other')
            SELECT DISTINCT hit_id FROM wanted WHERE length(preview) > max_chars
        """,
        "p4_found": f"""
            WITH {_SHARED_SQL}, f AS (SELECT x, y FROM p UNION SELECT rep, rep FROM u)
            SELECT DISTINCT ta.path AS path_a, tb.path AS path_b
            FROM f JOIN u ua ON ua.rep = f.x JOIN u ub ON ub.rep = f.y JOIN t ta ON ta.text = ua.text JOIN t tb ON tb.text = ub.text WHERE ta.path < tb.path
        """,
        "p4_shared": f"""
            WITH {_SHARED_SQL}, n AS (SELECT rep, i, lead(i) OVER (PARTITION BY rep ORDER BY i) AS after FROM s),
            c AS (SELECT rep, sum(CASE WHEN after IS NULL THEN 400 ELSE least(400, after - i) END)::BIGINT AS own FROM n GROUP BY rep)
            SELECT t.path, length(t.text)::INT AS chars, CASE WHEN u.copies > 1 THEN length(t.text) ELSE coalesce(c.own, 0) END::BIGINT AS shared_chars, (coalesce(u.copies, 1) - 1)::BIGINT AS exact_copies
            FROM t LEFT JOIN u USING (text) LEFT JOIN c USING (rep)
        """,
        "p4_links": f"""
            WITH {_SHARED_SQL}, k AS (SELECT x AS rep, count(*) AS links FROM p GROUP BY x)
            SELECT t.path, coalesce(u.rep, t.path) AS class, coalesce(u.copies, 1)::BIGINT AS copies, coalesce(k.links, 0)::BIGINT AS links FROM t LEFT JOIN u USING (text) LEFT JOIN k USING (rep)
        """,
    }
