import random
import time

import pytest

from loamdex.llm import parsing as P
from loamdex.llm.grammars import GRAMMARS

VALID = {
    "java": ['package a.b; import java.util.*;\n@Foo(x="y", v={1,2}) public class A<T extends B<T>> extends C implements D<List<Map<String,int[]>>> {\n private final Map<String, List<Integer>> m = new HashMap<>(); int a, b[] = {1,2};\n A(int x, String... y) throws E { super(x); }\n <R> R f(final List<? super T> l) { for (int i = 0; i < 3; i++) { if (a) continue; else return null; } for (Map.Entry<K,V> e : m.entrySet()) p((String) e.getKey()); Runnable r = () -> { g(); }; F<A> h = x -> x + 1; l.stream().map(String::valueOf); try (var in = o()) { x(); } catch (A | B e) { throw e; } finally { y(); } int k = switch (x) { case A, B -> 1; default -> { yield 2; } }; long t = a ? b : c >>> 2; return (R) x; }\n enum E { A(1) { }, B; int v; } record P(int x) { } @interface Q { int v() default 1; } }'],
    "javascript": ['import a, { b as c } from "x"; export default class F extends G.H { static x = 1; #p = 2; get z() { return this.#p } async *g() { yield* f() } }\nconst q = async (x) => { await x; }, w = x => ({ a: x, ...y, [k]: 1, m() {}, "s": 2 });\nfunction f(a, b = 1, ...c) { if (a) return b\n else return c }\nlet re = /ab+c/gi.test(x), h = a ? b : c ? d : e, t = `x${a}`\nfor (const [k, v] of o) { p(k) } try { a() } catch { b() }\n(function () { })(); a?.b?.[c]?.(d)', "if(_e.f>7){_e(6,e0)}else{_e=!0}_q.c=function(e){return e?7:\"r\"};for(var _w=0;_w<9;_w++)q(_w)"],
    "typescript": ['import type { A } from "./a"; export interface F<T> extends B<T> { a?: number; readonly c: Array<Map<string, number[]>>; m(x: number): void; [k: string]: any }\ntype U = | "a" | { x: number } & Z; type F2 = (a: string) => Promise<void>;\nabstract class K<T> extends B<T> implements I { private x: number = 1; constructor(private readonly a: string) { super(); } abstract foo(): void; async bar<U>(x: U): Promise<U | null> { return x as unknown as U; } }\nenum E { A = 1, B } function g<T>(x: T | undefined): x is string { const y: Map<string, number> = new Map<string, number>(); return !!x; }'],
    "go": ['package main\nimport ("fmt"; x "a/b")\ntype S struct { a, b int `json:"a"`\n *E\n f func(int) (string, error) }\ntype I interface { Foo(x int) (int, error) }\nfunc (s *S) M(a int) (n int, err error) {\n if err := f(); err != nil { return 0, err } else { }\n for k, v := range m { fmt.Println(k, v) }\n switch x := y.(type) { case int: a(); default: b() }\n p := &S{a: 1}\n q := []S{{1, 2}}\n go func() { ch <- 1 }()\n return a[1:2], nil\n}\n'],
    "rust": ["use std::{a::B, io::{self, R}};\n#[derive(Debug)] pub struct A<'a, T: C + 'a> where T: D { x: &'a str }\nimpl<'a, T> Tr<T> for A<'a, T> where T: C { fn f(&mut self, x: &[u8]) -> Result<(), Box<dyn E>> { let z = x?.y()?; match x { 0 => p!(\"{}\", x), 1 | 2 => {} E::B(n) if n > 1 => { return; } A { x, .. } => (), _ => g() } for (i, x) in v.iter().enumerate() { if x == &1 { continue; } } let c = |x: i32| x + 1; let s = A { x: \"a\", ..d() }; Ok(()) } }\nmacro_rules! m { ($x:expr) => { $x + 1 }; }"],
    "c": ['#include <a.h>\n#define X(a) \\\n (a + 1)\ntypedef struct n { int a; struct n *next; } n_t; enum E { A, B = 2 };\nstatic const char *names[] = { "a" "b", [1] = "c" };\nint main(int argc, char **argv) { for (int i = 0; i < 3; ++i) { n_t *q = (n_t *) malloc(sizeof(n_t)); q->next->a = x ? 1 : ~0; (*fp)(1); } switch (n) { case 1: return 1; default: goto end; } end: return 0; }'],
    "python": ["def f(x):\n    match x:\n        case [1, *_]:\n            return 1\n", "", "# c\n"],
    "json": ['{"a": [1, null, "x"]}', "3"],
}
INVALID = {
    "java": ["class A { void f() { int x = 1 } }", "class A { void f() { foo( } }", "class A { void f() { foo() bar(); } }", "class A { void f() { a.b(c)\n int x = 1; } }", "clas A {}", "class A {\n<<<<<<< HEAD\n int a;\n=======\n int b;\n>>>>>>> x\n}", "<!doctype html>\n<p>x</p>", 'class A { String s = "x; }', "class A {"],
    "javascript": ["function f( { }", "const = 1;", "let x = ;", "foo() bar();", "let a = b c;", "a b c", "# title\n\nSome words here.", "use crate::a::B;"],
    "typescript": ["const x: = 1;", "interface A { a: }", "class A { f( }"],
    "go": ["package a\nfunc f() { x := }", "func f() {}", "package a\nfunc f() { a b }", "package a\nfunc f() { a() b() }", "package a\nfunc f() {"],
    "rust": ["fn f() { let x = ; }", "fn f() { let x 1; }", "fn f() { a() b(); }", "import a from 'b';"],
    "c": ["int f() { return 1 }", "int f() { a() b(); }", "int f() { a(b)\n long c = d; }", "int x = ;", "package a.b;"],
    "python": ["def f()\n  x", "<<<<<<< a\n"],
    "json": ["", "{'a': 1}", '{"a": 1,}', "NaN", "{} {}"],
}


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in VALID.items() for t in v])
def test_valid(lang, text):
    assert P.parses(text, lang)


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(lang, text):
    assert not P.parses(text, lang)


def test_every_cut_of_a_file_is_invalid():
    text = VALID["java"][0]
    cuts = range(40, len(text) - 4, 7)
    assert sum(P.parses(text[:i], "java") for i in cuts) == 0


def test_memory_does_not_change_results():
    g = GRAMMARS["java"]
    first = [g.parses(t) for t in VALID["java"] + INVALID["java"]]
    assert first == [g.parses(t) for t in VALID["java"] + INVALID["java"]]


def test_causes():
    assert P.judge('{\n  "a": 1\n}\n{\n  "b": 2\n}', "json") == (True, "corrupt", None)
    assert P.parses("{ a(); }\n({ b: 1 });\nx = { c: 1 };", "javascript") and not P.parses('{ "a": 1 }', "javascript")
    assert P.judge(VALID["rust"][0], "python") == (True, "wrong extension", "rust")
    assert P.judge("x = (", "python") == (True, "corrupt", None)


def test_every_file_is_given_to_all_grammars(spark, monkeypatch):
    asked = []
    with monkeypatch.context() as m:
        m.setattr(P, "parses", lambda text, lang: asked.append(lang) or lang == "python")
        assert P.judge("x = 1", "python") == (False, None, None) and asked == list(P.LANGUAGES)
        assert P.judge("x", "json") == (True, "corrupt", None) and asked == list(P.LANGUAGES) * 2
    assert P.grammars("let x = () => 1;") == ["typescript", "javascript"] and P.grammars("x y z (") == []
    assert P.grammars("/* nothing */") == ["java", "typescript", "javascript", "rust", "c"]
    files = spark.createDataFrame([("s", "s/a.js", 1.0, 1, "javascript"), ("s", "s/b.json", 1.0, 1, "json")], "service_id string, path string, mtime double, size bigint, lang string")
    lines = spark.createDataFrame([("s", "s/a.js", 1, "let x = () => 1;"), ("s", "s/b.json", 1, "[1]")], "service_id string, path string, line int, content string")
    rows = {r["path"]: (r["invalid"], r["accepted"]) for r in P.parsed(files, lines).collect()}
    assert rows == {"s/a.js": (False, ["typescript", "javascript"]), "s/b.json": (False, ["python", "typescript", "javascript", "json"])}


def test_what_a_file_begins_with_changes_no_result(monkeypatch):
    r = random.Random(1)
    texts = [t for v in (VALID, INVALID) for ts in v.values() for t in ts] + ["package a\n;", "import a.b.*;", "@A class B { }", "package", "import static a", "int x;\nf(a);", "f(a) ;", "a::b! { }", "#![a]\nfn f() { }", "@A b c", "@a b\nclass C { }", "union A { }"]
    for t in list(texts):
        cuts = sorted(r.randrange(min(len(t), 120) + 1) for _ in range(6))
        texts += [t[:k] for k in cuts] + [t[k:] for k in cuts] + [t[:k] + r.choice([";", "@", "<a>", " x ", "#", "!", "("]) + t[k:] for k in cuts]
    found = {(lang, t): g.parses(t) for lang, g in GRAMMARS.items() for t in texts}
    monkeypatch.setattr(type(GRAMMARS["java"]), "begins", lambda self, code: "\x00" not in code)
    assert [k for k, ok in found.items() if GRAMMARS[k[0]].parses(k[1]) != ok] == [] and sum(found.values()) > 50


def test_open_quotes_and_comments_take_no_time():
    began = time.process_time()
    assert P.grammars("x = b'" + "\\x0e\\x53" * 40) == [] and P.grammars("/* " * 20_000) == []
    assert not P.parses("/* a/*.b */" + "/* c */" * 60, "rust") and P.parses("/* a /* b */ c */ /* d */", "rust")
    assert time.process_time() - began < 20


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, "x\\u00e9"], "b": {}}', "[]", " 3 ", '"x"', "[[], {}]"])
def test_json_by_stack(text):
    assert P._deep_json(text)
    for i in range(len(text)):
        for cut in (text[:i] + text[i + 1 :], text[:i] + "," + text[i:]):
            try:
                P.json.loads(cut, parse_constant=P._no_constant)
                ok = True
            except ValueError:
                ok = False
            assert P._deep_json(cut) == ok, cut


def test_functions_without_names():
    assert P.parses("export default function (a) { return a; }", "typescript") and P.parses("x(function () { });\nlet y = async function* () { };", "javascript")
    assert not P.parses("export function (a: number) { return a; }", "typescript") and not P.parses("function (a) { return a; }", "javascript")


def test_deep_and_long():
    deep = 100_000
    assert not P.parses("[" * deep, "json") and P.parses("[" * deep + "]" * deep, "json") and not P.parses("[" * deep + "1,]" + "]" * (deep - 1), "json")
    assert not P.parses("(" * deep, "python")
    for lang, text in (("java", "class A { X" + "<X" * 40 + ">" * 40 + " a; }"), ("typescript", "let a: X" + "<X" * 40 + ">" * 40 + " = 1;")):
        assert P.parses(text, lang) and not P.parses(text.replace(">", "", 1), lang)
    assert P.parses("[" * 300 + "]" * 300, "javascript") and P.parses("var a = [" + "1," * 200_000 + "1];", "javascript")


def test_table(spark):
    files = spark.createDataFrame([("s", "s/a.py", 1.0, 1, "python"), ("s", "s/a.py", 2.0, 1, "json"), ("s", "s/e.json", 1.0, 0, "json"), ("s", "s/n.py", 1.0, 1, None), ("s", "s/m.md", 1.0, 1, "markdown"), ("s", None, 1.0, 1, "python"), ("s", "s/i.py", None, None, "python")], "service_id string, path string, mtime double, size bigint, lang string")
    lines = spark.createDataFrame([("s", "s/a.py", 2, "}", 0), ("s", "s/a.py", 1, "{", 0), ("s", "s/a.py", 2, "}", 0), ("s", "s/n.py", 1, "(", 0), ("s", "s/i.py", 1, None, 0), ("s", None, 1, "(", 0), ("s", "s/i.py", None, "(", 0)], "service_id string, path string, line int, content string, kind int")
    rows = {r["path"]: r["invalid"] for r in P.parsed(files, lines).collect()}
    assert rows == {"s/a.py": False, "s/e.json": True, "s/i.py": False}
    assert P.rates(P.parsed(files, lines)).where("lang = 'json'").first()["invalid_rate"] == 0.5 and P.parsed(files.limit(0), lines).count() == 0
