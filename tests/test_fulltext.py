"""Against the full-text engine of the standard library's SQLite on the same lines and random queries."""

import random
import sqlite3

import pytest

from loamdex.operators import fulltext
from loamdex.operators.ftsquery import QueryError, parse, tokens_of
from loamdex.operators.textindex import TextIndex

WORDS = "alpha beta gamma delta Alpha BETA café CAFE naïve charge_customer chargeCustomer x1 foo-bar a.b größe".split()


def corpus(n=400, seed=7):
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append((f"src/f{i % 9}.py", i, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 9)))))
    return out


@pytest.fixture(scope="module")
def both(spark):
    rows = corpus()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(path UNINDEXED, line UNINDEXED, content, tokenize='unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    df = fulltext.tokenized(spark.createDataFrame(rows, "path string, line int, content string")).cache()
    return db, df


QUERIES = [
    "alpha", "alpha beta", "alpha AND beta", "alpha OR gamma", "alpha NOT beta", '"alpha beta"', "alph*", '"alpha bet" *', "^alpha", "^ alpha beta", "NEAR(alpha beta, 1)", "NEAR(alpha beta gamma, 3)",
    "alpha + beta", "charge_customer", "chargeCustomer", "content : alpha", "path : alpha", "- content : alpha", "{content path} : alpha", "(alpha OR beta) AND gamma", "alpha AND beta OR gamma NOT delta", "cafe", 'foo "" bar',
    "größe", "content : (alpha OR beta)", "alpha NOT (beta OR gamma)", "foo AND bar AND x1", "NEAR(foo bar)", "alpha OR beta OR gamma OR delta", "a AND b", "NAÏVE", "alpha NOT beta NOT gamma",
]


@pytest.mark.parametrize("query", QUERIES)
def test_same_as_sqlite(both, query):
    db, df = both
    theirs = {(p, n): r for p, n, r in db.execute("SELECT path, line, rank FROM t WHERE t MATCH ?", (query,))}
    mine = {(r["path"], r["line"]): r["score"] for r in fulltext.ranked(df, query).collect()}
    assert set(mine) == set(theirs)
    assert all(abs(mine[k] - theirs[k]) < 1e-9 for k in mine)


def test_random_queries(both):
    db, df = both
    r = random.Random(3)

    def made(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(["alpha", "beta", "gamma", "delta", "caf*", '"alpha beta"', "x1", "^foo", "NEAR(alpha beta, 2)"])
        return f"({made(depth - 1)}) {r.choice(['AND', 'OR', 'NOT'])} ({made(depth - 1)})"

    for _ in range(12):
        query = made(2)
        theirs = {(p, n): s for p, n, s in db.execute("SELECT path, line, rank FROM t WHERE t MATCH ?", (query,))}
        mine = {(x["path"], x["line"]): x["score"] for x in fulltext.ranked(df, query).collect()}
        assert set(mine) == set(theirs), query
        assert all(abs(mine[k] - theirs[k]) < 1e-9 for k in mine), query


@pytest.mark.parametrize("query", ["foo-bar", "foo:bar", "foo.bar", "compute(x", '"oops', "AND OR NOT", "foo NOT", "foo'bar", "()", "!!!", "*", "", "  ", "(alpha) beta", "alpha (beta)"])
def test_no_queries(both, query):
    db, _ = both
    with pytest.raises(QueryError):
        parse(query)
    with pytest.raises(sqlite3.OperationalError):
        db.execute("SELECT 1 FROM t WHERE t MATCH ?", (query,)).fetchall()


def test_fallback_and_limits(both):
    _, df = both
    rows = lambda q, **k: fulltext.search(df, q, **k).collect()
    assert [r["content"] for r in rows("foo-bar")] and all("foo-bar" in r["content"] for r in rows("foo-bar"))
    assert rows("!!!") == [] and rows("") == [] and rows("alpha", limit=0) == [] and len(rows("alpha", limit=-3)) == 1
    assert len(rows("alpha", limit=5, include="src/f1.py")) == 5
    assert {r["path"] for r in rows("alpha", exclude="src/f1.py", limit=400)} == {f"src/f{i}.py" for i in range(9) if i != 1}


@pytest.fixture(scope="module")
def index(both):
    return TextIndex.build(both[1])


@pytest.mark.parametrize("query", [*QUERIES, "alpha NOT (alph* AND beta)", "^gr*", "!!!", ""])
def test_index_gives_the_same(both, index, query):
    a = {(r["path"], r["line"]): r["score"] for r in fulltext.ranked(both[1], query).collect()}
    b = {(r["path"], r["line"]): r["score"] for r in index.ranked(query).collect()}
    assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_index_searches_the_same(both, index):
    for options in ({}, {"limit": 5, "include": "src/f1.py"}, {"limit": 3, "exclude": "src/f1.py", "parity": True, "include": "src/*"}, {"limit": 0}, {"limit": -2}, {"limit": 2000}):
        a, b = (x.search("alpha OR x1", **options).collect() if x is index else fulltext.search(both[1], "alpha OR x1", **options).collect() for x in (fulltext, index))
        assert [r[:3] for r in a] == [r[:3] for r in b] and all(abs(x[3] - y[3]) < 1e-9 for x, y in zip(a, b))


def test_tokens():
    assert tokens_of("Charge_customer É-x1 ß") == ("charge", "customer", "e", "x1", "ß")


def test_empty_and_null(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "")], "path string, line int, content string")
    assert fulltext.search(df, "x").collect() == [] and fulltext.search(df.limit(0), "x").collect() == []
    for rows in (df, df.limit(0)):
        assert TextIndex.build(rows).search("x").collect() == []
