"""Following changes of the trees: relevant events, debounced runs, periodic sweeps."""

from __future__ import annotations

import logging
import os
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamdex.operators.scan import relevant_event
from loamdex.sources.tree import Walk

LOG = logging.getLogger(__name__)


def relevant(events: DataFrame) -> DataFrame:
    """Events on files that can be indexed; events without a path concern nothing."""
    return events.where(F.col("path").isNotNull() & relevant_event(F.col("path")))


def debounced(events: DataFrame, gap: str = "3 seconds", late: str = "10 minutes", time: str = "event_ts") -> DataFrame:
    """One row a service and burst of events: a run starts ``gap`` after the last of them.

    Works on batches and streams; a stream holds a burst back until the watermark
    (``late`` behind the newest event) has passed it, and drops what comes later still.
    """
    rows = events
    if "_ts" not in events.columns:  # else the watermark is already set
        rows = events.withColumn("_ts", F.col(time).cast("timestamp"))
        if events.isStreaming:
            rows = rows.withWatermark("_ts", late)
    bursts = rows.groupBy("service_id", F.session_window("_ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return bursts.select("service_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("run_ts"), "events")


def once(events: DataFrame, key: str = "change_id", late: str = "10 minutes") -> DataFrame:
    """Notifications received twice count once; the earliest received stays.

    On a stream the first to arrive stays, and the result has the watermark column ``_ts``.
    """
    if events.isStreaming:
        return events.withColumn("_ts", F.col("event_ts").cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key])
    return events.groupBy(key).agg(*[F.min_by(c, "received_at").alias(c) for c in events.columns if c != key])


def follow(bursts: DataFrame, run: Callable[[str], None], checkpoint: str, every: str | None = "10 seconds", initial: Callable[[], None] | None = None) -> StreamingQuery:
    """Runs ``run(service)`` for each burst, one after the other; a failing run is logged and the rest go on.

    ``every`` None processes what there is and stops. A batch holds a row a
    service and burst, so what the driver reads is as many services as changed.
    """
    if initial:
        initial()

    def batch(df: DataFrame, _: int) -> None:
        for row in df.select("service_id").distinct().toLocalIterator():
            try:
                run(row["service_id"])
            except Exception:
                LOG.exception("run for %s failed", row["service_id"])

    writer = bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


class Daemon:
    """Keeps the services of an engine current on this machine: a baseline run, runs after changes, and sweeps.

    Trees are looked at every ``look`` seconds for files whose mtime or size differs
    or that came or went; a service's run starts ``debounce`` seconds after the last
    change seen. Sweeps run all services every ``interval`` seconds, unless ``periodic``
    is False. With an embedder, ``warm`` seconds after the last it embeds two words, so
    that a remote model stays loaded; 0 never does. Runs go one after the other; one
    that fails is logged.
    """

    def __init__(self, engine, interval: float = 600.0, debounce: float = 3.0, periodic: bool = True, warm: float = 120.0, look: float = 1.0, clock: Callable[[], float] = time.time):
        self.engine, self.interval, self.debounce, self.periodic, self.warm, self.look, self.clock = engine, interval, debounce, periodic, warm, look, clock
        self.seen: dict[str, dict[str, tuple[float, int]]] = {}
        self.due: dict[str, float] = {}
        self.ended = threading.Event()
        self.swept = self.warmed = clock()

    def _state(self, root: str) -> dict[str, tuple[float, int]]:
        walk, out = Walk([]), {}
        for folder, names, files in os.walk(root):
            rel = os.path.relpath(folder, root).replace(os.sep, "/")
            rel = "" if rel == "." else rel + "/"
            names[:] = [n for n in names if walk.folder(n, rel + n)]
            for f in files:
                try:
                    st = os.stat(os.path.join(folder, f))
                except OSError:
                    continue
                if walk.file(f, rel + f, st.st_size):
                    out[rel + f] = (st.st_mtime, st.st_size)
        return out

    def _run(self, service: str) -> None:
        try:
            self.engine.reindex(service)
        except Exception:
            LOG.exception("run for %s failed", service)

    def begin(self) -> None:
        """The baseline."""
        for s in self.engine.services:
            self.seen[s.id] = self._state(s.path)
            self._run(s.id)
        self.swept = self.clock()

    def step(self) -> list[str]:
        """Looks once and does what is due; gives the services that ran."""
        now, ran = self.clock(), []
        for s in self.engine.services:
            state = self._state(s.path)
            if state != self.seen.get(s.id):
                self.seen[s.id] = state
                self.due[s.id] = now + self.debounce
        for service in sorted(k for k, at in self.due.items() if at <= now):
            del self.due[service]
            self._run(service)
            ran.append(service)
        if self.periodic and now - self.swept >= self.interval:
            self.engine.sweep()
            self.swept = now
            ran = [s.id for s in self.engine.services]
        if self.warm and self.engine.embedder is not None and now - self.warmed >= self.warm:
            self.warmed = now
            try:
                self.engine.embedder().embed(["keep warm"])
            except Exception:
                LOG.warning("the embedder did not answer")
        return ran

    def run(self) -> None:
        self.begin()
        while not self.ended.wait(self.look):
            self.step()
