import json
import os

import pytest

from loamdex.operators import scan
from loamdex.sources import registry, status, tree


def test_tree(spark, tmp_path):
    root = tmp_path / "repo"
    for path, data in {
        "src/A.java": b"class A {}\n", "src/__init__.py": b"", ".github/ci.yml": b"a: 1\n", "build/B.java": b"x", ".git/c.py": b"x", "bin.py": b"a\x00b", "long.js": b"x" * 6000, "bad.txt": b"a\xffb", "skip/s.py": b"x", "secret.txt": b"x", "README.md": b"# hi\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    (root / ".gitignore").write_text("# c\n\nskip/\n!keep\n/secret.txt\n")
    tree.register(spark)
    rows = {r["path"]: r for r in spark.read.format("source_tree").load(str(root)).collect()}
    assert sorted(rows) == [".github/ci.yml", "README.md", "bad.txt", "bin.py", "long.js", "src/A.java", "src/__init__.py"]
    assert rows["bin.py"]["text"] is None and rows["long.js"]["text"] is None and rows["bad.txt"]["text"] == "a�b" and rows["src/A.java"]["lang"] == "java"
    for parts in (1, 2, 3, 100):
        assert sorted(r["path"] for r in spark.read.format("source_tree").option("parts", parts).load(str(root)).collect()) == sorted(rows)
    assert rows["src/A.java"]["mtime"] == os.stat(root / "src/A.java").st_mtime


def test_registry(spark, tmp_path):
    for p in ("ws/one/.git", "ws/two/.git", "ws/.dot/.git", "ws/deep/three/.git", "solo"):
        (tmp_path / p).mkdir(parents=True)
    f = tmp_path / "r.toml"
    assert registry.load(str(f)) == []
    registry.add_service(str(f), 'My "one"', str(tmp_path / "ws/one"), ("x/**",))
    registry.add_workspace(str(f), str(tmp_path / "ws"), 2)
    got = registry.load(str(f))
    assert [s.name for s in got] == ['My "one"', "three", "two"] and got[0].ignore == ("x/**",)
    assert registry.resolve(got, "two").path.endswith("ws/two") and registry.resolve(got, None) is None
    with pytest.raises(ValueError):
        registry.resolve(got, "no")
    # A root that is a repository and has repositories in it gives all of them; a depth may be text.
    (tmp_path / "ws/.git").mkdir()
    assert sorted(os.path.basename(p) for p in registry.discovered(str(tmp_path / "ws"), 1)) == ["one", "two", "ws"]
    f.write_text(f'[[workspace]]\npath = "{tmp_path}/ws"\ndepth = "2"\n')
    assert [s.name for s in registry.load(str(f))] == ["one", "three", "two", "ws"]
    f.write_text("[[service]\n")
    assert registry.load(str(f)) == []
    with pytest.raises(registry.RegistryError):
        registry.load(str(f), strict=True)
    assert registry.as_table(spark, got).count() == 3


def test_status(spark, tmp_path):
    w = status.Writer(str(tmp_path), "s1", "one", "/x")
    w.update(phase="indexing", done=5, total=20, semantic_failures=2)
    (tmp_path / "bad.json").write_text("{")
    services = spark.createDataFrame([("s1", "one"), ("s2", "two")], "service_id string, name string")
    counts = spark.createDataFrame([("s1", 7, 9)], "service_id string, files bigint, symbols bigint")
    rows = {r["service_id"]: r for r in status.table(services, status.read_all(spark, str(tmp_path)), counts).collect()}
    assert rows["s1"]["progress"] == 25.0 and rows["s1"]["busy"] and rows["s1"]["lost"] == 2 and rows["s2"]["phase"] == "never"
    w.finish()
    assert json.loads((tmp_path / "s1.json").read_text())["phase"] == "done"


def test_reporters(tmp_path):
    class Bad:
        def update(self, **fields):
            raise OSError

        def finish(self, error=None):
            raise OSError

    said = []
    both = status.Several(Bad(), status.Printed(said.append), status.Silent(), status.Writer(str(tmp_path), "s", "n", "/x"))
    both.update(phase="scanning")
    both.update(phase="scanning", done=1)
    both.finish("it broke")
    assert said == ["scanning", "error: it broke"]
    assert status.read_one(str(tmp_path), "s")["phase"] == "error" and status.read_one(str(tmp_path), "no") == {}


def test_decode(spark):
    rows = spark.createDataFrame([(1, bytearray(b"a\xffb")), (2, bytearray(b"a\x00b")), (3, bytearray("é".encode()))], "i int, c binary")
    assert [r[1] for r in rows.select("i", scan.decoded(rows["c"])).orderBy("i").collect()] == ["a�b", None, "é"]
