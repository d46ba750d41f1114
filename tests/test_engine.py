import io
import json
import time
import urllib.request
import threading

import pytest

from loamdex import jobs, service
from loamdex.__main__ import parser
from loamdex.engine import Engine
from loamdex.operators.embed import HashEmbedder
from loamdex.settings import Settings, embedder
from loamdex.sources.registry import Service
from loamdex.streaming.watch import Daemon


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for path, text in {"src/Billing.java": "package a;\npublic class Billing {\n  public int charge(int a) {\n    return a;\n  }\n}\n", "helper.py": "def charge_customer(x):\n    return x\n", "app.properties": "server.port=8080\n", "build/G.java": "class G {}\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_build_search_and_change(spark, repo, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/index", [Service("Repo", str(repo))], lambda: HashEmbedder(32))
    with pytest.raises(ValueError):
        e.search_text("x")
    assert e.index_stats() == "no index yet"
    r = e.reindex()
    assert (r.indexed, r.skipped, r.removed, r.symbols, r.semantic_files) == (3, 0, 0, 3, 3)
    assert e.search_text("port AND 8080") == "app.properties:1: server.port=8080" and e.search_text("zzz") == "No text matches for: zzz"
    assert e.search_symbol("charge", limit=1) == "method charge  ->  src/Billing.java:3-5" and e.search_symbol("Charge", exact=True) == "No symbols match: Charge"
    assert e.file_symbols("helper.py") == "L1-2\tfunction\tcharge_customer" and e.read_span("helper.py", 1, 1) == "helper.py:1-1\ndef charge_customer(x):"
    assert e.search_semantic("charge customer", 1).startswith("helper.py:1-2  (score ") and "## Symbols" in e.search_hybrid("charge") and "## Semantic" in e.search_hybrid("charge")
    r = e.reindex()
    assert (r.indexed, r.skipped, r.removed) == (0, 3, 0)
    (repo / "helper.py").write_text("def other():\n    return 1\n")
    (repo / "app.properties").unlink()
    (repo / "src/Billing.java").write_bytes(b"a\x00b")
    r = e.reindex()
    assert (r.indexed, r.removed) == (1, 1) and e.search_symbol("charge") == "No symbols match: charge" and e.search_text("8080").startswith("No text")
    version = e._store(e.services[0]).version()
    assert e.reindex().indexed == 0 and e._store(e.services[0]).version() == version  # nothing changed, nothing written
    before = {n: sorted(map(str, t.drop("norm").collect())) for n, t in e.tables().items()}
    e.reindex(full=True)
    assert before == {n: sorted(map(str, t.drop("norm").collect())) for n, t in e.tables().items()}
    assert Engine(spark, e.folder, e.services).search_semantic("x").startswith("Semantic search disabled")


def test_command_line():
    a = parser().parse_args(["search-text", "x y", "--path-glob", "src/**"])
    assert (a.command, a.query, a.limit, a.path_glob) == ("search-text", "x y", 30, "src/**")
    assert parser().parse_args(["search-hybrid", "x"]).limit == 8


def test_jobs_status_and_health(spark, repo, tmp_path):
    one = Service("Repo", str(repo))
    e = Engine(spark, f"file://{tmp_path}/index", [one], lambda: HashEmbedder(16), status=str(tmp_path / "status"))
    assert e.health()["error"] == "collection does not exist yet" and e.active() is None
    hold = threading.Event()
    run, e._run = e._run, lambda *a: hold.wait(60) and run(*a)
    assert e.reindex_background().startswith("reindex started in background (service=Repo")
    assert e.reindex_background().startswith("reindex already running (service=Repo") and e.active() is not None
    hold.set()
    e.jobs[one.id].join(120)
    assert e.active() is None and e.health()["status"] == "ok" and e.health()["points"] == 3
    assert "files=3 symbols=3" in e.index_stats() and "semantic: ok (collection=code_" in e.index_stats()
    row = e.snapshot()[0]
    assert (row["phase"], row["indexed"], row["files"], row["busy"]) == ("done", 3, 3, False) and "Repo\tdone" in e.status_table()

    def broken(*a):
        raise OSError("disk")

    e._run = broken
    with pytest.raises(OSError):
        e.reindex()
    assert e.snapshot()[0]["error"] == "OSError: disk" and Engine(spark, e.folder, [one]).health()["status"] == "disabled"
    # Another process's run is active while that process lives.
    (tmp_path / "status" / f"{one.id}.json").write_text(json.dumps({"phase": "indexing", "pid": 2**22 + 5}))
    assert e.active() is None
    (tmp_path / "status" / f"{one.id}.json").write_text(json.dumps({"phase": "embedding", "pid": __import__("os").getppid()}))
    assert e.active() == "embedding"


class Stub:
    """An engine that only notes what is asked."""

    embedder = None

    def __init__(self, root):
        self.services, self.asked = [Service("Repo", str(root))], []

    def reindex(self, wanted=None, full=False):
        self.asked.append(wanted)
        if len(self.asked) == 2:
            raise OSError

    def sweep(self):
        self.asked.append("sweep")

    def snapshot(self):
        return [{"id": self.services[0].id}]

    def reindex_background(self, wanted=None, full=False):
        self.asked.append((wanted, full))
        return "reindex started"

    def search_text(self, query: str, limit: int = 30, service: str | None = None) -> str:
        if query == "bad":
            raise ValueError("no")
        return f"{query} {limit}"

    list_services = index_stats = file_symbols = read_span = search_semantic = search_hybrid = search_symbol = search_text


def test_daemon(repo):
    now = [0.0]
    e = Stub(repo)
    d = Daemon(e, interval=100, debounce=3, clock=lambda: now[0])
    d.begin()
    assert d.step() == [] and len(e.asked) == 1
    (repo / "helper.py").write_text("x = 1\n")
    (repo / "build/G.java").write_text("class H {}")
    assert d.step() == []
    now[0] = 2.0
    (repo / "new.py").write_text("y = 1\n")
    assert d.step() == []
    now[0] = 4.0
    assert d.step() == []  # the later change moved the run
    now[0] = 5.0
    assert d.step() == [e.services[0].id] and len(e.asked) == 2  # it fails, and the daemon goes on
    now[0] = 101.0
    d.step()
    assert e.asked[-1] == "sweep"


def test_tools_over_lines_and_http(repo):
    e = Stub(repo)
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search_text", "arguments": {"query": "x", "limit": 4}}}, {"id": 4, "method": "tools/call", "params": {"name": "search_text", "arguments": {"query": "bad"}}}, {"id": 5, "method": "no"}, {"id": 6, "method": "tools/call", "params": {"name": "reindex_background", "arguments": {"service": "a", "full": True}}}]
    out = io.StringIO()
    service.serve_lines(service.Tools(e), io.StringIO("\n".join(map(json.dumps, asked)) + "\n{\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, None]
    assert len(got[1]["result"]["tools"]) == 10 and got[1]["result"]["tools"][0]["inputSchema"] == {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}, "service": {"type": "string"}}, "required": ["query"]}
    assert got[2]["result"]["content"][0]["text"] == "x 4" and got[3]["result"]["isError"] and got[4]["error"]["code"] == -32601 and e.asked[-1] == ("a", True)
    server = service.http_server(e, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(f"{base}/api/status"))["services"] == e.snapshot() and b"<table" in urllib.request.urlopen(base + "/").read()
    done = json.load(urllib.request.urlopen(urllib.request.Request(f"{base}/api/reindex?service={e.services[0].id}&full=1", method="POST")))
    assert done["ok"] and e.asked[-1] == (e.services[0].id, True)
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(urllib.request.Request(f"{base}/api/reindex?service=no", method="POST"))
    server.shutdown()


def test_commands_that_change_files():
    for line in ("git pull", "cd x && git -C y -c a=b commit -m z", "git --no-pager merge x | cat", "git stash pop", "make; git checkout -b x"):
        assert jobs.changes_files(line), line
    for line in ("git status", "git stash", "echo git-pull", "legit pull", "", "git", "git -C x", "git log; ls"):
        assert not jobs.changes_files(line), line


def test_settings():
    s = Settings.load({"LOAMDEX_SEMANTIC": "no", "LOAMDEX_EMBED_BATCH": "0", "LOAMDEX_CACHE_HOME": "/c", "LOAMDEX_SEARCH_SCORE": "-0.5"})
    assert not s.semantic and s.embed_batch == 1 and s.status_folder == "/c/status" and s.search_score == -0.5 and embedder(s) is None
    made = embedder(Settings(embed_backend="service", embed_api_base="http://x", embed_search_retries=2))()
    assert made.search_retries == 2 and made.batch == 64 and isinstance(embedder(Settings())(), HashEmbedder)
    with pytest.raises(RuntimeError):
        embedder(Settings(embed_backend="local"))()
    assert parser().parse_args(["watch", "--no-periodic"]).debounce == 3.0 and parser().parse_args(["index", "--background"]).background
