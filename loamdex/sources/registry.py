"""The registry of services: a TOML file of services and workspaces."""

from __future__ import annotations

import hashlib
import logging
import os
import re
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


LOG = logging.getLogger(__name__)


class RegistryError(ValueError):
    """The registry cannot be read."""


@dataclass(frozen=True)
class Service:
    name: str
    path: str
    ignore: tuple[str, ...] = ()
    use_gitignore: bool = True

    @property
    def id(self) -> str:
        base = os.path.basename(self.path.rstrip("/"))
        clean = "".join(c if c.isalnum() or c in "-_" else "_" for c in base) or "root"
        return f"{clean}_{hashlib.sha1(self.path.encode()).hexdigest()[:12]}"


def _texts(value) -> tuple[str, ...]:
    if isinstance(value, str):
        return (value,)
    return tuple(str(x) for x in value) if isinstance(value, (list, tuple)) else ()


def _truth(value, default: bool = True) -> bool:
    if value is None:
        return default
    return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")


def _listed(value) -> list[dict]:
    return [value] if isinstance(value, dict) else [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _is_repo(path: str) -> bool:
    return os.path.exists(os.path.join(path, ".git"))


def discovered(root: str, depth: int = 1) -> list[str]:
    """Repositories below a workspace, to a depth, and the root itself if it is one; nothing below another repository."""
    out: list[str] = []
    level = [root]
    for _ in range(max(1, depth)):
        below: list[str] = []
        for folder in level:
            try:
                names = sorted(os.listdir(folder))
            except OSError:
                continue
            for n in names:
                full = os.path.join(folder, n)
                if n.startswith(".") or not os.path.isdir(full):
                    continue
                (out if _is_repo(full) else below).append(full)
        level = below
    return [*out, root] if _is_repo(root) else out


def _depth(value) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return 1


def load(path: str, strict: bool = False) -> list[Service]:
    """Services of a registry, by lower-case name; explicit ones win over discovered ones.

    A missing file has none; a malformed one has none either, with a warning, or raises if ``strict``.
    """
    if not os.path.exists(path):
        return []
    try:
        with open(path, "rb") as f:
            data = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as e:
        if strict:
            raise RegistryError(str(e)) from e
        LOG.warning("registry %s is ignored: %s", path, e)
        return []
    found: dict[str, Service] = {}
    for s in _listed(data.get("service")):
        if isinstance(s.get("path"), str) and s["path"]:
            full = os.path.realpath(os.path.expanduser(s["path"]))
            found[full] = Service(str(s.get("name") or os.path.basename(full)), full, _texts(s.get("ignore")), _truth(s.get("use_gitignore")))
    for w in _listed(data.get("workspace")):
        if isinstance(w.get("path"), str) and w["path"]:
            for full in map(os.path.realpath, discovered(os.path.realpath(os.path.expanduser(w["path"])), _depth(w.get("depth", 1)))):
                found.setdefault(full, Service(os.path.basename(full), full, _texts(w.get("ignore")), _truth(w.get("use_gitignore"))))
    return sorted(found.values(), key=lambda s: s.name.lower())


def resolve(services: list[Service], wanted: str | None) -> Service | None:
    """A service by id or name; None asks for the default."""
    if wanted is None:
        return None
    for s in services:
        if wanted in (s.id, s.name):
            return s
    raise ValueError(f"unknown service: {wanted}")


def _toml(value: str) -> str:
    return '"' + re.sub(r'(["\\])', r"\\\1", value) + '"'


def add_service(path: str, name: str, folder: str, ignore: tuple[str, ...] = ()) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(f"\n[[service]]\nname = {_toml(name)}\npath = {_toml(folder)}\n" + (f"ignore = [{', '.join(map(_toml, ignore))}]\n" if ignore else ""))


def add_workspace(path: str, folder: str, depth: int = 1) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(f"\n[[workspace]]\npath = {_toml(folder)}\ndepth = {int(depth)}\n")


def as_table(spark: SparkSession, services: list[Service]) -> DataFrame:
    rows = [(s.id, s.name, s.path, list(s.ignore), s.use_gitignore) for s in services]
    return spark.createDataFrame(rows, "service_id string, name string, path string, ignore_globs array<string>, use_gitignore boolean")


def deduplicated(explicit: DataFrame, found: DataFrame) -> DataFrame:
    """One row a path: explicit entries win, of several the last by name."""
    both = explicit.select("service_id", "name", "path", F.lit(0).alias("_p")).unionByName(found.select("service_id", "name", "path", F.lit(1).alias("_p")))
    w = Window.partitionBy("path").orderBy("_p", F.col("name").desc(), "service_id")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("service_id", "name", "path")
