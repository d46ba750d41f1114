"""``python -m loamdex``: index services of a registry and search them."""

from __future__ import annotations

import argparse
import os
import sys

from loamdex.settings import Settings, embedder
from loamdex.sources import registry


def parser(s: Settings | None = None) -> argparse.ArgumentParser:
    s = s or Settings.load()
    p = argparse.ArgumentParser(prog="loamdex", description=__doc__)
    p.add_argument("--registry", default=s.registry)
    p.add_argument("--index", default=s.index_folder)
    p.add_argument("--status", dest="status_folder", default=s.status_folder)
    p.add_argument("--no-embed", action="store_true", help="leave the vector layer out")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "index-all", "stats", "stats-all", "services", "list"):
        c = sub.add_parser(name)
        c.add_argument("--service")
        c.add_argument("--full", action="store_true")
        c.add_argument("--background", action="store_true")
    sub.add_parser("status")
    sub.add_parser("serve")
    c = sub.add_parser("web")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8765)
    c = sub.add_parser("watch")
    c.add_argument("--interval", type=float, default=600.0, help="seconds between sweeps")
    c.add_argument("--debounce", type=float, default=3.0, help="seconds after a change")
    c.add_argument("--no-periodic", action="store_true", help="no sweeps")
    c.add_argument("--warm-interval", type=float, default=s.warm_interval, help="seconds between calls that keep the embedder warm; 0 for none")
    c = sub.add_parser("add")
    c.add_argument("path")
    c.add_argument("--name")
    c.add_argument("--ignore", action="append", default=[])
    c = sub.add_parser("add-workspace")
    c.add_argument("path")
    c.add_argument("--depth", type=int, default=1)
    for name, limit in (("search-text", 30), ("search-symbol", 30), ("search-semantic", 10), ("search-hybrid", 8)):
        c = sub.add_parser(name)
        c.add_argument("query")
        c.add_argument("--limit", type=int, default=limit)
        c.add_argument("--service")
        c.add_argument("--path-glob")
        c.add_argument("--exclude-glob")
        c.add_argument("--exact", action="store_true")
    c = sub.add_parser("file-symbols")
    c.add_argument("path")
    c.add_argument("--service")
    c = sub.add_parser("read-span")
    c.add_argument("path")
    c.add_argument("start_line", type=int)
    c.add_argument("end_line", type=int)
    c.add_argument("--context", type=int, default=0)
    c.add_argument("--service")
    return p


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    settings = Settings.load()
    a = parser(settings).parse_args(argv)
    if a.command == "add":
        registry.add_service(a.registry, a.name or os.path.basename(os.path.realpath(a.path)), os.path.realpath(a.path), tuple(a.ignore))
        return 0
    if a.command == "add-workspace":
        registry.add_workspace(a.registry, os.path.realpath(a.path), a.depth)
        return 0
    if a.command == "index" and a.background:
        from loamdex.jobs import detached

        print(f"started in background (pid {detached([x for x in argv if x != '--background'])})")
        return 0
    from pyspark.sql import SparkSession

    from loamdex.engine import Engine

    spark = SparkSession.builder.appName("loamdex").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        index = a.index if "://" in a.index else f"file://{os.path.realpath(os.path.expanduser(a.index))}"
        engine = Engine(spark, index, registry.load(a.registry, strict=True), None if a.no_embed else embedder(settings), status=a.status_folder)
        if a.command == "serve":
            from loamdex.service import Tools, log_to_file, serve_lines

            log_to_file(settings)
            serve_lines(Tools(engine, settings.slow_tool_seconds))
        elif a.command == "web":
            from loamdex.service import http_server

            http_server(engine, a.host, a.port).serve_forever()
        elif a.command == "watch":
            from loamdex.streaming.watch import Daemon

            Daemon(engine, a.interval, a.debounce, not a.no_periodic, a.warm_interval).run()
        else:
            print(answer(engine, a))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        pass
    return 0


def answer(engine, a: argparse.Namespace) -> str:
    if a.command in ("services", "list"):
        return engine.list_services()
    if a.command == "status":
        return engine.status_table()
    if a.command in ("index", "stats"):
        return str(engine.reindex(a.service, a.full)) if a.command == "index" else engine.index_stats(a.service)
    if a.command in ("index-all", "stats-all"):
        return "\n".join(f"{s.name}: {engine.reindex(s.id, a.full) if a.command == 'index-all' else engine.index_stats(s.id)}" for s in engine.services)
    if a.command == "file-symbols":
        return engine.file_symbols(a.path, a.service)
    if a.command == "read-span":
        return engine.read_span(a.path, a.start_line, a.end_line, a.context, a.service)
    options = dict(limit=a.limit, service=a.service, path_glob=a.path_glob, exclude_glob=a.exclude_glob)
    if a.command == "search-symbol":
        return engine.search_symbol(a.query, exact=a.exact, **options)
    return {"search-text": engine.search_text, "search-semantic": engine.search_semantic, "search-hybrid": engine.search_hybrid}[a.command](a.query, **options)


if __name__ == "__main__":
    sys.exit(main())
