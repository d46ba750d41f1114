"""Status records of indexing runs: one JSON file a service, replaced at once; and what else a run reports to."""

from __future__ import annotations

import json
import logging
import os
import time
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = (
    "id string, name string, path string, phase string, done bigint, total bigint, current string, indexed bigint, skipped bigint, removed bigint, symbols bigint, "
    "semantic boolean, semantic_failures bigint, semantic_embed_failures bigint, pid bigint, started_at double, updated_at double, finished_at double, error string"
)
ACTIVE = ("scanning", "indexing", "removing", "embedding")


LOG = logging.getLogger(__name__)


class Reporter(Protocol):
    """What a run tells of itself."""

    def update(self, **fields) -> None: ...

    def finish(self, error: str | None = None) -> None: ...


class Silent:
    """Tells nobody."""

    def update(self, **fields) -> None:
        pass

    def finish(self, error: str | None = None) -> None:
        pass


class Printed:
    """A line for each phase and the end of a run."""

    def __init__(self, say=print):
        self.say, self.phase = say, None

    def update(self, **fields) -> None:
        if fields.get("phase", self.phase) != self.phase:
            self.phase = fields["phase"]
            self.say(f"{self.phase} {fields.get('done', '')}".strip())

    def finish(self, error: str | None = None) -> None:
        self.say(f"error: {error}" if error else "done")


class Several:
    """Tells several reporters; one that fails is logged and the others still hear."""

    def __init__(self, *reporters: Reporter):
        self.reporters = reporters

    def _each(self, call) -> None:
        for r in self.reporters:
            try:
                call(r)
            except Exception:
                LOG.exception("a reporter failed")

    def update(self, **fields) -> None:
        self._each(lambda r: r.update(**fields))

    def finish(self, error: str | None = None) -> None:
        self._each(lambda r: r.finish(error))


class Writer:
    """Writes a run's status, at most every ``every`` seconds unless the phase changes."""

    def __init__(self, folder: str, service_id: str, name: str, path: str, every: float = 0.3):
        os.makedirs(folder, exist_ok=True)
        self.file, self.every, self.last = os.path.join(folder, f"{service_id}.json"), every, 0.0
        self.record = {"id": service_id, "name": name, "path": path, "phase": "starting", "pid": os.getpid(), "started_at": time.time()}

    def update(self, **fields) -> None:
        phase = fields.get("phase", self.record["phase"]) != self.record["phase"]
        self.record.update(fields, updated_at=time.time())
        if phase or time.time() - self.last >= self.every:
            self.flush()

    def finish(self, error: str | None = None) -> None:
        self.record.update(phase="error" if error else "done", error=error, finished_at=time.time(), updated_at=time.time())
        self.flush()

    def flush(self) -> None:
        new = f"{self.file}.{uuid.uuid4().hex}.tmp"
        with open(new, "w", encoding="utf-8") as f:
            json.dump(self.record, f)
        os.replace(new, self.file)
        self.last = time.time()


def read_one(folder: str, service_id: str) -> dict:
    """A service's record; empty if there is none that can be read."""
    try:
        with open(os.path.join(folder, f"{service_id}.json"), encoding="utf-8") as f:
            got = json.load(f)
        return got if isinstance(got, dict) else {}
    except (OSError, ValueError):
        return {}


def read_all(spark: SparkSession, folder: str) -> DataFrame:
    """All records; unreadable files are skipped."""
    rows = spark.read.schema(FIELDS + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    return rows.where(F.col("id").isNotNull()).drop("_corrupt")


def table(services: DataFrame, status: DataFrame, counts: DataFrame) -> DataFrame:
    """Every service with its run's state and counts; progress in per cent."""
    s = status.select(F.col("id").alias("service_id"), "phase", "done", "total", F.coalesce("semantic_failures", F.lit(0)).alias("_a"), F.coalesce("semantic_embed_failures", F.lit(0)).alias("_b"), "error")
    return (
        services.select("service_id", "name").join(s, "service_id", "left").join(counts.select("service_id", "files", "symbols"), "service_id", "left")
        .select(
            "service_id", "name", F.coalesce("phase", F.lit("never")).alias("phase"), F.when(F.col("total") > 0, F.round(100.0 * F.col("done") / F.col("total"), 1)).alias("progress"),
            (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias("lost"), F.col("phase").isin(*ACTIVE).alias("busy"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("symbols", F.lit(0)).alias("symbols"), "error",
        )
    )
