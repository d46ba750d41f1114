"""Keeping an index current: differences, upserts, deletes, snapshots and counts.

Tables are Parquet files by bucket of the path. A change writes the buckets it
touches and then a manifest that names the files of every bucket, so readers always
see a whole snapshot, a lost executor loses nothing, and a changed file rewrites its
bucket only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamdex.tables import Files


def current(files: DataFrame) -> DataFrame:
    """The newest row of each path; ties go to the greatest size."""
    w = Window.partitionBy("path").orderBy(F.col("mtime").desc(), F.col("size").desc(), F.col("indexed_at").desc_nulls_last() if "indexed_at" in files.columns else F.col("size"))
    return files.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def changed(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Scanned files that are new, or whose mtime or size is not exactly the known one."""
    return scanned.join(known.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def unchanged(scanned: DataFrame, known: DataFrame) -> DataFrame:
    return scanned.join(known.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")


def gone(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """Known paths that the scan no longer has."""
    return known.select("path").distinct().join(scanned.select("path"), "path", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``old`` without the rows of the keys that ``new`` has, and ``new``."""
    keys = keys or ["path"]
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def delete(rows: DataFrame, paths: DataFrame, key: str = "path") -> DataFrame:
    return rows.join(paths.select(key).distinct(), key, "left_anti")


def requested(paths: DataFrame, key: str = "path") -> DataFrame:
    """How many different keys a delete asks for; unknown ones count."""
    return paths.agg(F.count_distinct(key).alias("requested"))


def stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files")).crossJoin(F.broadcast(symbols.agg(F.count(F.lit(1)).alias("symbols"))))


def service_stats(services: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files and symbols of each registered service."""
    f = files.groupBy("service_id").agg(F.count(F.lit(1)).alias("files"))
    s = symbols.groupBy("service_id").agg(F.count(F.lit(1)).alias("symbols"))
    return services.select("service_id", "name").join(f, "service_id", "left").join(s, "service_id", "left").fillna(0, ["files", "symbols"])


def report(scanned: DataFrame, known: DataFrame, symbols: DataFrame) -> DataFrame:
    """The counters of an incremental run as one row."""
    new = changed(scanned, known)
    n = new.agg(F.count(F.lit(1)).alias("indexed"))
    k = unchanged(scanned, known).agg(F.count(F.lit(1)).alias("skipped"))
    g = gone(known, scanned).agg(F.count(F.lit(1)).alias("removed"))
    s = symbols.join(new.select("path").distinct(), "path", "left_semi").agg(F.count(F.lit(1)).alias("symbols"))
    return n.crossJoin(F.broadcast(k)).crossJoin(F.broadcast(g)).crossJoin(F.broadcast(s))


class Snapshot(NamedTuple):
    version: int
    tables: dict[str, DataFrame]


def bucket_of(path: str = "path", buckets: int = 64):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


class Store:
    """Snapshots of named tables with a ``path`` column, under a folder of any file system Spark knows.

    Manifests are numbered; the greatest readable one is current. Creating one fails
    if another writer was first. ``buckets`` is fixed by the first commit; ``kept``
    manifests and their files stay for readers, older ones are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, kept: int = 3):
        self.spark, self.folder, self.kept = spark, folder.rstrip("/"), kept
        self.files = Files(spark, self.folder)
        have = self.manifest()
        self.buckets = have["buckets"] if have else buckets

    def _numbers(self) -> list[int]:
        names = self.files.names(f"{self.folder}/manifests")
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def manifest(self, version: int | None = None) -> dict | None:
        for n in self._numbers() if version is None else [version]:
            try:
                return {"version": n, **json.loads(self.files.text(f"{self.folder}/manifests/{n}.json"))}
            except ValueError:  # being written, or left half written by a writer that died
                continue
        return None

    def version(self) -> int | None:
        have = self.manifest()
        return have and have["version"]

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> Snapshot | None:
        """A pinned snapshot, or the part of it in some buckets; None before the first commit."""
        have = self.manifest(version)
        if have is None:
            return None
        some = None if buckets is None else {str(b) for b in buckets}
        tables = {}
        for name, t in have["tables"].items():
            schema = StructType.fromJson(t["schema"])
            folders = [f"{self.folder}/data/{f}" for b, f in sorted(t["folders"].items()) if some is None or b in some]
            tables[name] = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return Snapshot(have["version"], tables)

    def touched(self, paths: DataFrame) -> list[int]:
        """The buckets of some paths: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in paths.select(bucket_of("path", self.buckets)).distinct().collect())

    def commit(self, tables: dict[str, DataFrame], touched: Iterable[int] | None = None, order: dict[str, list[str]] | None = None) -> int:
        """Writes the rows of the touched buckets (all if None) and a manifest of them and of what stays.

        ``tables`` has all rows of the touched buckets; rows of others are left out.
        """
        before = self.manifest()
        some = None if touched is None else sorted(set(touched))
        manifest: dict = {"buckets": self.buckets, "tables": {}}
        for name, df in tables.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            rows = df.withColumn("_bucket", bucket_of("path", self.buckets))
            if some is not None:
                rows = rows.where(F.col("_bucket").isin(some))
            rows.repartition("_bucket").sortWithinPartitions("_bucket", *(order or {}).get(name, ["path"])).write.partitionBy("_bucket").parquet(f"{self.folder}/data/{folder}")
            old = before["tables"].get(name, {}).get("folders", {}) if before and some is not None else {}
            stays = {b: f for b, f in old.items() if int(b) not in (some or ())}
            new = {n.removeprefix("_bucket="): f"{folder}/{n}" for n in self.files.names(f"{self.folder}/data/{folder}") if n.startswith("_bucket=")}
            manifest["tables"][name] = {"schema": json.loads(df.schema.json()), "folders": stays | new}
        number = max(self._numbers(), default=0) + 1
        self.files.create(f"{self.folder}/manifests/{number}.json", json.dumps(manifest))
        self.vacuum()
        return number

    def vacuum(self) -> None:
        """Deletes manifests but for the last ``kept``, and files that none of those names."""
        numbers = self._numbers()
        used = set()
        for n in numbers[: self.kept]:
            have = self.manifest(n)
            used |= {f.split("/")[0] for t in (have or {"tables": {}})["tables"].values() for f in t["folders"].values()}
        for n in numbers[self.kept :]:
            self.files.delete(f"{self.folder}/manifests/{n}.json")
        if len(numbers) > self.kept:
            for name in self.files.names(f"{self.folder}/data"):
                if name not in used and self.files.age(f"{self.folder}/data/{name}") > 3600:
                    self.files.delete(f"{self.folder}/data/{name}")
