"""The engine as one object: building the index of a service and answering in text."""

from __future__ import annotations

import logging
import os
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions.text import lines_of, stripped
from loamdex.operators import chunks, embed, extract, fulltext, hybrid, maintain, spans, symbols, vectors
from loamdex.operators.hybrid import Layer
from loamdex.operators.textindex import TextIndex, postings_of, totals_of
from loamdex.sources import status, tree
from loamdex.sources.registry import Service, resolve
from loamdex.tables import discard, materialize

LOG = logging.getLogger(__name__)

EMPTY = {
    "files": "path string, mtime double, size bigint, lang string",
    "lines": "path string, line int, content string, tokens array<string>, dl int",
    "postings": "token string, path string, line int, dl int, tf int, positions array<int>",
    "totals": "path string, lines bigint, tokens bigint",
    "symbols": extract.SCHEMA,
    "points": "point_id string, path string, start_line int, end_line int, preview string, embedding array<float>, norm double",
}


#: In what order the rows of a bucket stand: postings by token, so that scans read few row groups of it.
ORDER = {"lines": ["path", "line"], "postings": ["token", "path", "line"], "symbols": ["path", "start_line"]}


@dataclass
class Report:
    """The counters of a run."""

    indexed: int = 0
    skipped: int = 0
    removed: int = 0
    symbols: int = 0
    semantic_enabled: bool = False
    semantic_files: int = 0
    semantic_embed_failures: int = 0
    seconds: float = field(default=0.0, compare=False)


class Engine:
    """Indexes services below ``folder`` and searches them.

    ``embedder`` makes an embedder on an executor; None disables the vector layer.
    Runs tell their status to files below ``status`` (a folder of this machine), if given.
    """

    def __init__(self, spark: SparkSession, folder: str, services: list[Service], embedder: Callable[[], embed.Embedder] | None = None, default: str | None = None, status: str | None = None, buckets: int = 16):
        self.spark, self.folder, self.services, self.embedder, self.status, self.buckets = spark, folder.rstrip("/"), services, embedder, status, buckets
        self.default = default or (services[0].id if services else None)
        self.jobs: dict[str, threading.Thread] = {}
        self.starting, self.running = threading.Lock(), threading.Lock()

    # ---- building

    def service(self, wanted: str | None = None) -> Service:
        found = resolve(self.services, wanted if wanted is not None else self.default)
        if found is None:
            raise ValueError("no service")
        return found

    def _store(self, s: Service) -> maintain.Store:
        return maintain.Store(self.spark, f"{self.folder}/{s.id}", self.buckets)

    def tables(self, wanted: str | None = None) -> dict[str, DataFrame] | None:
        """The current tables of a service; a reader keeps them whatever is written meanwhile."""
        snapshot = self._store(self.service(wanted)).read()
        return snapshot.tables if snapshot else None

    def reporter(self, s: Service) -> status.Reporter:
        return status.Writer(self.status, s.id, s.name, s.path) if self.status else status.Silent()

    def reindex(self, wanted: str | None = None, full: bool = False, reporter: status.Reporter | None = None) -> Report:
        """Scans a service's tree and writes the buckets of what changed; all of them if ``full``.

        Files that are no text any more, or empty now, lose their old rows. One run
        goes at a time.
        """
        s = self.service(wanted)
        told = reporter or self.reporter(s)
        with self.running:
            try:
                report = self._run(s, full, told)
            except Exception as e:
                told.finish(f"{type(e).__name__}: {e}")
                raise
            told.update(indexed=report.indexed, skipped=report.skipped, removed=report.removed, symbols=report.symbols, semantic=report.semantic_enabled, semantic_embed_failures=report.semantic_embed_failures)
            told.finish()
        return report

    def _run(self, s: Service, full: bool, told: status.Reporter) -> Report:
        began = time.time()
        report = Report(semantic_enabled=self.embedder is not None)
        told.update(phase="scanning", done=0, total=0)
        tree.register(self.spark)
        scan = materialize(self.spark.read.format("source_tree").option("ignore", "\n".join(s.ignore)).option("usegitignore", str(s.use_gitignore).lower()).load(s.path), "scan")
        store = self._store(s)
        before = None if full else store.read()
        known = before.tables["files"] if before else self._empty("files")
        new = maintain.changed(scan, known)
        gone = maintain.gone(known, scan)
        stale = new.select("path").unionByName(gone)
        touched = None if before is None else store.touched(stale)
        total, text_files, removed = scan.count(), new.where(F.col("text").isNotNull()).count(), gone.count()
        report.indexed, report.skipped, report.removed = text_files, total - text_files, removed
        if touched != []:
            told.update(phase="indexing", done=0, total=text_files)
            old = store.read(before.version, touched).tables if before else {}
            old = {n: old[n] if n in old else self._empty(n) for n in EMPTY}
            text = new.where(F.col("text").isNotNull())
            lines = materialize(fulltext.tokenized(text.select("path", F.posexplode(lines_of(F.col("text"))).alias("line", "content")).withColumn("line", (F.col("line") + 1).cast("int"))), "lines")
            syms = materialize(extract.symbols_of(text), "symbols")
            report.symbols = syms.count()
            fresh = {"files": new.select("path", "mtime", "size", "lang"), "lines": lines, "postings": postings_of(lines), "totals": totals_of(lines), "symbols": syms}
            kept = [scan, lines, syms]
            if self.embedder is not None:
                told.update(phase="embedding")
                points = materialize(embed.embedded(chunks.points(chunks.windows(text.select("path", "text"))), self.embedder), "points")
                kept.append(points)
                failed = points.agg(F.sum(F.col("failed").cast("int")), F.count_distinct(F.when(~F.col("failed"), F.col("path")))).first()
                report.semantic_embed_failures, report.semantic_files = failed[0] or 0, failed[1] or 0
                fresh["points"] = vectors.with_norms(points.where(~F.col("failed")))
            told.update(phase="removing")
            tables = {n: maintain.delete(rows, stale).unionByName(fresh[n].select(*rows.columns)) if n in fresh else maintain.delete(rows, stale) for n, rows in old.items()}
            store.commit(tables, touched, ORDER)
        else:
            kept = [scan]
        for df in kept:
            discard(df)
        report.seconds = time.time() - began
        return report

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], EMPTY[name])

    def active(self, wanted: str | None = None) -> str | None:
        """The phase of a run of this engine's or another process's; None if there is none."""
        s = self.service(wanted)
        record = status.read_one(self.status, s.id) if self.status else {}
        phase = record.get("phase")
        job = self.jobs.get(s.id)
        if job is not None and job.is_alive():
            return phase or "starting"
        return phase if phase in status.ACTIVE and _alive(record.get("pid")) else None

    def reindex_background(self, wanted: str | None = None, full: bool = False) -> str:
        """Starts a run and returns at once; one run a service, here or in another process."""
        s = self.service(wanted)
        with self.starting:
            phase = self.active(s.id)
            if phase:
                return f"reindex already running (service={s.name}, phase={phase}); not starting a second one. Poll index_stats for progress."

            def run() -> None:
                try:
                    self.reindex(s.id, full)
                except Exception:
                    LOG.exception("run for %s failed", s.id)

            self.jobs[s.id] = threading.Thread(target=run, daemon=True)
            self.jobs[s.id].start()
        return f"reindex started in background (service={s.name}, full={full}). Poll index_stats for progress; results land in search shortly."

    def sweep(self) -> None:
        """An incremental run of every service; one that fails is logged and the rest go on."""
        for s in self.services:
            try:
                self.reindex(s.id)
            except Exception:
                LOG.exception("run for %s failed", s.id)

    def snapshot(self) -> list[dict]:
        """Every service with its status record and counts."""
        out = []
        for s in self.services:
            record = status.read_one(self.status, s.id) if self.status else {}
            have = self.tables(s.id)
            counts = maintain.stats(have["files"], have["symbols"]).first() if have else None
            out.append(
                {"id": s.id, "name": s.name, "path": s.path, "phase": record.get("phase", "idle"), **{k: record.get(k, 0) for k in ("done", "total", "indexed", "skipped", "removed", "semantic_failures", "semantic_embed_failures")}, "current": record.get("current") or "", "semantic": record.get("semantic"), "updated_at": record.get("updated_at"), "finished_at": record.get("finished_at"), "error": record.get("error"), "files": counts and counts["files"], "symbols": counts and counts["symbols"], "busy": self.active(s.id) is not None}
            )
        return out

    def status_table(self) -> str:
        """The snapshot as lines of text."""
        out = ["service\tphase\tprogress\tfiles\tsymbols\tcurrent"]
        for r in self.snapshot():
            lost = (r["semantic_failures"] or 0) + (r["semantic_embed_failures"] or 0)
            share = f"{100 * r['done'] / r['total']:.0f}% ({r['done']}/{r['total']})" if r["total"] else "-"
            out.append(f"{r['name']}\t{r['phase']}{f' ({lost} sem lost)' if lost else ''}\t{share}\t{'?' if r['files'] is None else r['files']}\t{'?' if r['symbols'] is None else r['symbols']}\t{r['current']}")
        return "\n".join(out)

    # ---- searching, as rows

    def text(self, query: str, limit: int = 30, service: str | None = None, path_glob=None, exclude_glob=None) -> DataFrame:
        return self.text_index(service).search(query, limit, path_glob, exclude_glob)

    def text_index(self, service: str | None = None) -> TextIndex:
        have = self._need(service)
        return TextIndex(have["lines"], have["postings"], have["totals"])

    def symbol(self, name: str, limit: int = 30, exact: bool = False, service: str | None = None, path_glob=None, exclude_glob=None) -> DataFrame:
        return symbols.search(self._need(service)["symbols"], name, limit, exact, path_glob, exclude_glob)

    def semantic(self, query: str, limit: int = 10, service: str | None = None, path_glob=None, exclude_glob=None, threshold: float = 0.0) -> Layer:
        """The vector layer's hits, or why there are none."""
        if self.embedder is None:
            return Layer("disabled", reason="the vector layer is off")
        have = self._need(service)
        if have["points"].limit(1).count() == 0:
            return Layer("unavailable", reason="nothing is embedded yet")
        try:
            e = self.embedder()
            q = e.embed_query(query) if hasattr(e, "embed_query") else e.embed([query])[0]
        except Exception as error:  # the service may fail in any way
            return Layer("failed", reason=str(error))
        return Layer("ok", vectors.nearest(have["points"], q, limit, threshold, include=path_glob, exclude=exclude_glob))

    def _need(self, service: str | None) -> dict[str, DataFrame]:
        have = self.tables(service)
        if have is None:
            raise ValueError("the service has no index yet")
        return have

    # ---- answers as text

    def search_text(self, query: str, limit: int = 30, service: str | None = None, path_glob=None, exclude_glob=None) -> str:
        rows = self.text(query, limit, service, path_glob, exclude_glob).withColumn("content", stripped(F.col("content"))).collect()
        return "\n".join(f"{r['path']}:{r['line']}: {r['content']}" for r in rows) or f"No text matches for: {query}"

    def search_symbol(self, name: str, limit: int = 30, exact: bool = False, service: str | None = None, path_glob=None, exclude_glob=None) -> str:
        rows = self.symbol(name, limit, exact, service, path_glob, exclude_glob).collect()
        return "\n".join(f"{r['kind']} {r['name']}  ->  {r['path']}:{r['start_line']}-{r['end_line']}" for r in rows) or f"No symbols match: {name}"

    def file_symbols(self, path: str, service: str | None = None) -> str:
        rows = symbols.outline(self._need(service)["symbols"], path).collect()
        return "\n".join(f"L{r['start_line']}-{r['end_line']}\t{r['kind']}\t{r['name']}" for r in rows) or f"No symbols in: {path}"

    def read_span(self, path: str, start_line: int, end_line: int, context: int = 0, service: str | None = None) -> str:
        return spans.read_span(self._need(service)["lines"], self.service(service).path, path, start_line, end_line, context)

    def search_semantic(self, query: str, limit: int = 10, service: str | None = None, path_glob=None, exclude_glob=None) -> str:
        layer = self.semantic(query, limit, service, path_glob, exclude_glob)
        if layer.state != "ok":
            return f"Semantic search {layer.state}: {layer.reason}"
        rows = layer.rows.collect()
        return "\n\n".join(f"{r['path']}:{r['start_line']}-{r['end_line']}  (score {r['score']:.3f})\n{r['preview']}" for r in rows) or f"No semantic matches for: {query}"

    def search_hybrid(self, query: str, limit: int = 8, service: str | None = None, path_glob=None, exclude_glob=None) -> str:
        out = []
        for title, answer, none in (
            ("Symbols", self.search_symbol(query, limit, False, service, path_glob, exclude_glob), "No symbols"),
            ("Text", self.search_text(query, limit, service, path_glob, exclude_glob), "No text"),
            ("Semantic", self.search_semantic(query, limit, service, path_glob, exclude_glob), "No semantic"),
        ):
            if not answer.startswith(none) and not answer.startswith("Semantic search disabled"):
                out.append(f"## {title}\n{answer}")
        return "\n\n".join(out) or f"No matches for: {query}"

    def list_services(self) -> str:
        return "\n".join(f"{s.id}\t{s.name}\t{s.path}" for s in self.services)

    def health(self, service: str | None = None) -> dict:
        """The vector layer's state (disabled, ok, unavailable), its table, points and error."""
        s = self.service(service)
        out = {"status": "disabled", "collection": f"code_{s.id}", "points": None, "error": None}
        if self.embedder is None:
            return out
        try:
            have = self.tables(s.id)
            if have is None:
                return out | {"status": "unavailable", "points": 0, "error": "collection does not exist yet"}
            return out | {"status": "ok", "points": have["points"].count()}
        except Exception as e:
            return out | {"status": "unavailable", "error": f"{type(e).__name__}: {e}"}

    def index_stats(self, service: str | None = None) -> str:
        have = self.tables(service)
        if have is None:
            return "no index yet"
        counts = maintain.stats(have["files"], have["symbols"]).first()
        h = self.health(service)
        layer = {"disabled": "disabled", "ok": f"ok (collection={h['collection']}, points={h['points']})"}.get(h["status"], f"unavailable ({h['error']})")
        phase = self.active(service)
        return f"files={counts['files']} symbols={counts['symbols']}\nsemantic: {layer}" + (f"\nrun: {phase}" if phase else "")


def _alive(pid) -> bool:
    try:
        os.kill(int(pid), 0)
    except (TypeError, ValueError, ProcessLookupError):
        return False
    except PermissionError:
        pass
    return True


EMPTY_COLUMNS = {n: [c.strip().split(" ")[0] for c in schema.split(", ")] for n, schema in EMPTY.items()}


def hybrid_rows(engine: Engine, query: str, limit: int = 8, service: str | None = None, globs: Iterable[str] | None = None) -> DataFrame:
    """The sections of a combined search as one table."""
    have = engine._need(service)
    vector = engine.embedder().embed([query])[0] if engine.embedder else None
    return hybrid.search(engine.text_index(service), have["symbols"], query, limit, have["points"] if vector else None, vector, include=globs)
