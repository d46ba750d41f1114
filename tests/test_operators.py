import uuid

import pytest
from pyspark.sql import functions as F

from loamdex.functions import text
from loamdex.operators import chunks, embed, extract, hybrid, maintain, scan, spans, symbols, vectors


def test_lines_like_python(spark):
    cases = ["", "a", "a\n", "a\n\nb", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k", "\n", "a\n\n"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(text.lines_of(F.col("t"))).collect()] == [c.splitlines() for c in cases]


def test_suffix_and_uuid(spark):
    df = spark.createDataFrame([("a/b.PY",), (".env",), ("x/.gitignore",), ("a.tar.gz",), ("Makefile",), ("a.b/c",)], "p string")
    assert [r[0] for r in df.select(text.suffix(F.col("p"))).collect()] == [".py", "", "", ".gz", "", ""]
    df = spark.createDataFrame([("a.py:1-60",), ("größe:2-3",)], "p string")
    assert [r[0] for r in df.select(text.url_uuid(F.col("p"))).collect()] == [uuid.uuid5(uuid.NAMESPACE_URL, "a.py:1-60").hex, uuid.uuid5(uuid.NAMESPACE_URL, "größe:2-3").hex]


def test_symbols(spark):
    rows = [("a.py", "charge_x", "function", 1, 2), ("a.py", "chargeAx", "function", 3, 4), ("b.py", "Charge", "class", 1, 9), ("b.py", "É", "class", 1, 1), ("b.py", "a\\b", "class", 2, 2)]
    df = spark.createDataFrame(rows, "path string, name string, kind string, start_line int, end_line int")
    names = lambda *a, **k: [r["name"] for r in symbols.search(df, *a, **k).collect()]
    assert names("charge_x") == ["charge_x", "chargeAx"] and names("CHARGE") == ["Charge", "charge_x", "chargeAx"]
    assert names("Charge", exact=True) == ["Charge"] and names("é") == [] and names("\\b") == ["a\\b"] and names("charge", limit=-1) == ["Charge"]
    assert [r["start_line"] for r in symbols.outline(df, "a.py").collect()] == [1, 3]


@pytest.mark.parametrize("n,expected", [(0, 0), (1, 1), (60, 1), (61, 2), (105, 2), (106, 3), (200, 5)])
def test_windows(spark, n, expected):
    df = spark.createDataFrame([("a", "\n".join(str(i + 1) for i in range(n)))], "path string, text string")
    rows = chunks.windows(df).orderBy("start_line").collect()
    assert len(rows) == expected
    if n == 200:
        assert (rows[0]["start_line"], rows[0]["end_line"]) == (1, 60) and rows[1]["start_line"] == 46 and rows[-1]["end_line"] == 200
    assert all(r["chunk"].split("\n") == [str(i) for i in range(r["start_line"], r["end_line"] + 1)] for r in rows)


def test_blank_window(spark):
    assert chunks.windows(spark.createDataFrame([("a", "\xa0\n \n"), ("b", None)], "path string, text string")).collect() == []


def test_vectors(spark):
    df = spark.createDataFrame([("p1", "a.py", [1.0, 0.0]), ("p2", "b.py", [0.6, 0.8]), ("p3", "b.py", [0.0, 0.0]), ("p4", "c.py", None)], "point_id string, path string, embedding array<float>")
    rows = vectors.nearest(vectors.with_norms(df), [1.0, 0.0], 3).collect()
    assert [r["point_id"] for r in rows] == ["p1", "p2", "p3"] and abs(rows[1]["score"] - 0.6) < 1e-6
    assert [r["point_id"] for r in vectors.nearest(df, [1.0, 0.0], 3, threshold=0.7).collect()] == ["p1"]
    assert [r["point_id"] for r in vectors.nearest(df, [1.0, 0.0], 3, include="b.py").collect()] == ["p2", "p3"]


def test_embedding_answers():
    assert embed.parsed('{"data":[{"embedding":["1.5", 2]}],"error":{"message":"x"}}', 1) == [[1.5, 2.0]]
    ok = embed.parsed('{"data":[{"index":1,"embedding":[2]},{"index":0,"embedding":[1]}]}', 2)
    assert ok == [[1.0], [2.0]]
    for bad in ("<html>", "[]", '{"error":"x"}', '{"data":[]}', '{"data":[{"index":0}]}', '{"data":[{"embedding":["a"]}]}', '{"data":[{"embedding":[NaN]}]}', '{"data":[{"embedding":[]}]}'):
        with pytest.raises(embed.EmbeddingError):
            embed.parsed(bad, 1)
    calls = []

    def post(payload, timeout):
        calls.append(payload["input"])
        if len(calls) < 3:
            raise OSError
        return '{"data":[' + ",".join(f'{{"index":{i},"embedding":[{i}]}}' for i in range(len(payload["input"]))) + "]}"

    e = embed.ServiceEmbedder("http://x", "m", post=post, sleep=lambda s: None)
    assert e.embed(["a", "b"]) == [[0.0], [1.0]] and len(calls) == 3
    assert e.embed_query("q") == e.embed_query("q") and len(calls) == 4


def test_embedded_failures(spark):
    class Broken:
        def embed(self, texts):
            raise OSError

    df = spark.createDataFrame([(1, "a b")], "id int, chunk string")
    assert embed.embedded(df, Broken).collect()[0]["failed"] is True
    assert len(embed.embedded(df, lambda: embed.HashEmbedder(8)).collect()[0]["embedding"]) == 8


def test_spans(spark, tmp_path):
    df = spark.createDataFrame([("a.py", i, f"l{i}") for i in range(1, 6)] + [("a.py", 2, "l2")], "path string, line int, content string")
    assert [r["content"] for r in spans.lines_between(df, "a.py", 2, 4).collect()] == ["l2", "l3", "l4"]
    assert spans.span_text(df, "a.py", 2, 3).collect()[0]["body"] == "l2\nl3" and spans.lines_between(df, "no", 1, 2).collect() == []
    (tmp_path / "f.txt").write_text("\n".join(map(str, range(1, 11))))
    assert spans.live_span(str(tmp_path), "f.txt", 3, 4, 1) == "2\n3\n4\n5" and spans.live_span(str(tmp_path), "../x", 1, 2) is None and spans.live_span(str(tmp_path), "f.txt", 50, 60) == ""
    assert spans.read_span(df, str(tmp_path), "f.txt", 0, 0) == "f.txt:1-1\n1" and spans.read_span(df, str(tmp_path), "a.py", 1, 1) == "a.py:1-1 (from index)\nl1"


def test_scan(spark):
    paths = ["src/a.py", "node_modules/x.js", ".git/config.py", ".github/ci.yml", "a/.hidden/b.py", "go.sum", "x.min.js", "b.rst", "Dockerfile", "docs/i18n/a.md", "i18n/a.md", "big.md", "a.bin", ".env"]
    df = spark.createDataFrame([(p, 200_000 if p == "big.md" else 10) for p in paths], "path string, size bigint")
    assert sorted(r["path"] for r in scan.indexable(df, ["src/b*"]).collect()) == [".github/ci.yml", "Dockerfile", "i18n/a.md", "src/a.py"]
    assert scan.indexable(df, ["src/"]).where("path like 'src%'").count() == 0
    ev = spark.createDataFrame([("C:\\x\\a.py",), ("x\\build\\a.py",), ("a.exe",), ("Makefile",)], "path string")
    assert [r[0] for r in ev.select(scan.relevant_event(F.col("path"))).collect()] == [True, False, False, True]


def test_incremental_equals_full(spark):
    known = spark.createDataFrame([("a", 1.0, 5), ("b", 1.0, 5), ("c", 1.0, 5)], "path string, mtime double, size bigint")
    scanned = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 5), ("d", 1.0, 1)], "path string, mtime double, size bigint")
    new = maintain.changed(scanned, known)
    assert sorted(r["path"] for r in new.collect()) == ["b", "d"] and [r["path"] for r in maintain.gone(known, scanned).collect()] == ["c"]
    after = maintain.delete(maintain.upsert(known, new), maintain.gone(known, scanned))
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, scanned.collect()))
    lots = spark.createDataFrame([(f"f{i}.java",) for i in [*range(400), 3, 9999]], "path string")
    assert maintain.requested(lots).first()[0] == 401


def test_store(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    store = maintain.Store(spark, folder, buckets=8, kept=2)
    rows = lambda some: spark.createDataFrame(some, "path string, size int")
    have = lambda: sorted(map(tuple, store.read().tables["files"].collect()))
    assert store.read() is None and store.version() is None
    v1 = store.commit({"files": rows([(f"p{i}", i) for i in range(30)])})
    old = store.read()
    touched = store.touched(rows([("p3", 0)]))
    assert len(touched) == 1
    kept = store.read(buckets=touched).tables["files"]
    assert 0 < kept.count() < 30
    names = store.files.names(f"{folder}/data")
    v2 = store.commit({"files": kept.where("path <> 'p3'").unionByName(rows([("p3", 99)]))}, touched)
    assert v1 < v2 and have() == sorted([(f"p{i}", i) for i in range(30) if i != 3] + [("p3", 99)]) and old.tables["files"].where("size = 3").count() == 1
    new = [n for n in store.files.names(f"{folder}/data") if n not in names]
    assert len(store.files.names(f"{folder}/data/{new[0]}")) <= 2  # the touched bucket and the writer's mark
    (tmp_path / "index/manifests/9.json").write_text("{")  # of a writer that died
    assert store.version() == v2 and maintain.Store(spark, folder).buckets == 8
    with pytest.raises(Exception):
        store.files.create(f"{folder}/manifests/{v2}.json", "{}")
    v3 = store.commit({"files": rows([])}, None)
    assert v3 == 10 and have() == [] and store._numbers() == [10, 9]


def test_extract():
    py = extract.extract("class A:\n    def f(self):\n        pass\n\n\nasync def g():\n    return 1\n", "python")
    assert [(d.name, d.kind, d.start_line, d.end_line) for d in py] == [("A", "class", 1, 3), ("f", "function", 2, 3), ("g", "function", 6, 7)]
    broken = extract.extract("def f(:\n    x\n\ndef g()\n    y\n", "python")
    assert [d.name for d in broken] == ["f", "g"]
    java = extract.extract("package a;\npublic class Money {\n  // int no() {\n  public int total(int a) {\n    return a;\n  }\n  Money() { }\n}\nenum E { A }\nrecord P(int x) { }\n", "java")
    assert {(d.name, d.kind) for d in java} == {("Money", "class"), ("total", "method"), ("Money", "constructor"), ("E", "enum"), ("P", "record")}
    assert next(d for d in java if d.name == "total")[2:] == (4, 6)
    noted = extract.extract('package a;\n@Foo(x = "(")\npublic @Bar final class A {\n  @Override public int f() { return g(1); }\n  @A\n  @B(c={1,\n 2})\n  A(int x) { super(x); }\n  int h() {\n    return f(1);\n  }\n}\n', "java")
    assert [tuple(d) for d in noted] == [("A", "class", 2, 12), ("f", "method", 4, 4), ("A", "constructor", 5, 8), ("h", "method", 9, 11)]
    ts = extract.extract('export interface I {\n  a: string;\n}\nexport type T = "x";\nexport class C {\n  private m(a: number): void {\n  }\n}\nfunction f<T>(x: T) {\n}\n', "typescript")
    assert {(d.name, d.kind) for d in ts} == {("I", "interface"), ("T", "type"), ("C", "class"), ("m", "method"), ("f", "function")}
    js = extract.extract("export function* gen(a) {\n  yield 1;\n}\n", "javascript")
    assert [(d.name, d.kind) for d in js] == [("gen", "generator_function_declaration")]
    go = extract.extract("package p\n\nfunc (s *S) M() int {\n\treturn 1\n}\n\ntype S struct {\n\ta int\n}\nfunc F() {\n}\n", "go")
    assert [(d.name, d.kind, d.start_line, d.end_line) for d in go] == [("M", "method", 3, 5), ("S", "type", 7, 9), ("F", "function", 10, 11)]
    rs = extract.extract("pub struct A { x: i32 }\nimpl A {\n    pub fn f(&self) -> i32 {\n        1\n    }\n}\n", "rust")
    assert [(d.name, d.kind) for d in rs] == [("A", "struct"), ("A", "impl"), ("f", "function")]
    c = extract.extract("struct p { int a; };\nstatic int f(const char *s) {\n  return 0;\n}\n", "c")
    assert {(d.name, d.kind) for d in c} == {("p", "struct"), ("f", "function")}
    assert [d.name for d in extract.extract("module M\n  class A\n    def f\n    end\n  end\nend\n", "ruby")] == ["M", "A", "f"]
    assert [(d.name, d.end_line) for d in extract.extract("local function f(a)\n  if a then\n  end\nend\n", "lua")] == [("f", 4)]
    assert extract.extract("x", "markdown") == [] and extract.extract("", "python") == [] and extract.extract("x", None) == []


def test_hybrid(spark):
    lines = spark.createDataFrame([("a.py", 1, "charge the customer"), ("b.py", 2, "nothing")], "path string, line int, content string")
    syms = spark.createDataFrame([("a.py", "charge", "function", 1, 2)], "path string, name string, kind string, start_line int, end_line int")
    pts = spark.createDataFrame([("p", "a.py", 1, 2, "x", [1.0, 0.0])], "point_id string, path string, start_line int, end_line int, preview string, embedding array<float>")
    rows = hybrid.search(lines, syms, "charge", points=pts, query_vector=[1.0, 0.0])
    assert [(r["section"], r["path"]) for r in rows.orderBy("section", "ord").collect()] == [("Semantic", "a.py"), ("Symbols", "a.py"), ("Text", "a.py")]
    assert hybrid.fused(rows).first()["sections"] == "Semantic+Symbols+Text" and hybrid.search(lines, syms, "none").collect() == []


def test_symbol_bodies_of_all_kinds(spark, tmp_path):
    files = {"s/a.py": ["class A:", "    def f(self):", "        return 1", "", "def g():", "    pass"], "s/b.go": ["type T struct {", "\tX int", "}"]}
    symbols = [("s/a.py", "A", "class", 1, 3), ("s/a.py", "f", "method", 2, 3), ("s/a.py", "g", "function", 5, 9), ("s/b.go", "T", "struct", 1, 3), ("s/b.go", "T", "type", 1, 3), ("s/gone.py", "h", "function", 1, 2), ("s/a.py", "f", "method", 2, 3)]
    lines = [(p, i, c or None) for p, x in files.items() for i, c in enumerate(x, 1)]
    spark.createDataFrame([("s", *x) for x in symbols], "service_id string, path string, name string, kind string, start_line int, end_line int").write.parquet(str(tmp_path / "symbols.parquet"))
    spark.createDataFrame([("s", *x) for x in [*lines[::-1], *lines[:2]]], "service_id string, path string, line int, content string").write.parquet(str(tmp_path / "lines_fts.parquet"))
    from loamdex.plans import registry

    want = {(p, n, k, a, b, "\n".join(files[p][a - 1 : b])) for p, n, k, a, b in symbols if p in files}
    rows = [tuple(r) for r in registry.queries()["symbol_bodies_all"](spark, str(tmp_path)).collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert [tuple(r) for r in registry.queries()["symbol_bodies"](spark, str(tmp_path)).collect()] == [("s/b.go", "T", 1, "type T struct {\n\tX int\n}")]


def test_symbols_of_lines(spark):
    lines = spark.createDataFrame([("a.py", 2, "    pass"), ("a.py", 1, "def f():"), ("a.py", 1, "def f():"), ("b.go", 1, "func G() {}"), ("c.txt", 1, "def g():"), ("d.py", 1, None), (None, 1, "x")], "path string, line int, content string")
    lang = spark.createDataFrame([("a.py", "python"), ("b.go", "go"), ("d.py", "python"), ("e.py", "python")], "path string, lang string")
    assert sorted(map(tuple, extract.symbols_of_lines(lines, lang).collect())) == [("a.py", "f", "function", 1, 2), ("b.go", "G", "function", 1, 1)]
    assert extract.symbols_of_lines(lines.limit(0), lang).count() == 0
