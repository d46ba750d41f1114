import re

import pytest

from loamdex.functions import globs

CASES = [
    ("**/generated/**", "a/generated/b.py", True), ("**/generated/**", "generated/x/b.py", True), ("**/generated/**", "a/gen/b.py", False),
    ("*.pb.go", "x/y/z.pb.go", True), ("*.pb.go", "x/y/z.go", False), ("docs/legacy/**", "docs/legacy/a/b.md", True), ("docs/legacy/**", "x/docs/legacy/a.md", False),
    ("/secret.txt", "secret.txt", True), ("/secret.txt", "a/secret.txt", False), ("build", "a/build/b.py", True), ("a?c", "abc", True), ("a?c", "a/c", False),
    ("x[1].py", "x[1].py", True), ("x[1].py", "x1.py", False), ("src/", "src/a.py", False), ("**", "any/thing", True),
]


@pytest.mark.parametrize("pattern,path,expected", CASES)
def test_cases(pattern, path, expected):
    assert any(re.match(e, path) for e in globs.file_expressions([pattern])) is expected


def test_says_nothing():
    assert globs.file_expressions(["", "# x", "!keep", "  "]) == []
    assert globs.as_patterns(" a , ,b ") == ["a", "b"] and globs.as_patterns(None) is None and globs.as_patterns([" "]) is None


def test_filter(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("backend/svc.py",), ("backend/tests/test_svc.py",), ("web/a.ts",)], "path string")
    keep = lambda i, e: sorted(r[0] for r in df.where(globs.path_filter(F.col("path"), i, e)).collect())
    assert keep("backend/**", "**/tests/**") == ["backend/svc.py"]
    assert keep(None, None) == ["backend/svc.py", "backend/tests/test_svc.py", "web/a.ts"]
    assert keep(["# only a comment"], None) == []
    assert keep(None, ["# only a comment"]) == ["backend/svc.py", "backend/tests/test_svc.py", "web/a.ts"]
    plan = df.where(globs.path_filter(F.col("path"), "backend/**"))._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" in plan
