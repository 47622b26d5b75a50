"""Reports of how far a load, a run of rules or a stream has come, few enough to show, from what Spark says of its work."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

Report = Callable[[str, int, int], None]


class Progress:
    """Lets the first, the last and changed phases through, and else one report per interval."""

    def __init__(self, report: Report, interval: float = 0.5):
        self.report, self.interval, self.phase, self.at = report, interval, None, 0.0

    def __call__(self, phase: str, done: int, total: int) -> None:
        now = time.monotonic()
        if phase != self.phase or (total >= 0 and done >= total) or now - self.at >= self.interval:
            self.phase, self.at = phase, now
            self.report(phase, done, total)


def work(spark: SparkSession, tag: str) -> dict[str, int]:
    """Of the jobs with a tag: tasks done and known so far, and the bytes, rows read and rows written by their stages."""
    sc = spark.sparkContext
    tracker, store, jobs = sc._jsc.statusTracker(), sc._jsc.sc().statusStore(), sc._jsc.sc().statusTracker().getJobIdsForTag(tag)
    out = dict.fromkeys(("tasks", "of", "bytes", "read", "written"), 0)
    stages = {s for job in jobs if (info := tracker.getJobInfo(job)) for s in info.stageIds()}
    for stage in stages:
        try:
            data = store.lastStageAttempt(stage)
        except Exception:  # noqa: BLE001, S112
            continue  # one that is skipped or not there yet
        out["tasks"] += data.numCompleteTasks()
        out["of"] += data.numTasks()
        out["bytes"] += data.inputBytes()
        out["read"] += data.inputRecords()
        out["written"] += data.outputRecords()
    return out


@contextmanager
def watched(spark: SparkSession, report: Report, phase: str, interval: float = 0.5) -> Iterator[None]:
    """Reports while Spark works: (phase, tasks done, tasks known), (phase bytes, n, -1) and (phase rows, n, -1), each as it grows; then (phase, 1, 1)."""
    sc, tag, over = spark.sparkContext, f"progress-{uuid.uuid4().hex}", threading.Event()
    last: dict[str, int] = {}

    def look() -> None:
        now = work(spark, tag)
        if now["of"] and now != last:
            report(phase, min(now["tasks"], now["of"] - 1), now["of"])
            for name, key in (("bytes", "bytes"), ("rows", "written")):
                if now[key] > last.get(key, 0):
                    report(f"{phase} {name}", now[key], -1)
            last.update({k: max(v, last.get(k, 0)) for k, v in now.items()})

    def poll() -> None:
        while not over.wait(interval):
            look()

    report(phase, 0, 1)
    sc.addJobTag(tag)
    poller = threading.Thread(target=poll, daemon=True)
    poller.start()
    try:
        yield
    finally:
        over.set()
        poller.join()
        sc.removeJobTag(tag)
        look()
    report(phase, 1, 1)


class StreamProgress(StreamingQueryListener):
    """Reports the rows of each batch of a query as they add up: (phase, rows, -1), and (phase, rows, rows) when it ends."""

    def __init__(self, report: Report, phase: str = "stream", query: str | None = None):
        self.report, self.phase, self.query, self.rows = report, phase, query, 0

    def _mine(self, run: object) -> bool:
        return self.query is None or str(run) == self.query

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if self._mine(event.id):
            self.report(self.phase, self.rows, -1)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if self._mine(event.progress.id):
            self.rows += event.progress.numInputRows
            self.report(self.phase, self.rows, -1)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if self._mine(event.id):
            self.report(self.phase, self.rows, self.rows)
