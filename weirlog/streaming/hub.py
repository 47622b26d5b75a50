"""Live rows to any number of subscribers, each with a bounded buffer: a slow one loses rows, the others none."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Subscriber:
    """A ring of the rows that wait for `send`, which a thread of its own calls. The ring is full: the new row is dropped and counted."""

    def __init__(self, send: Callable[[dict], None], test: Column | None, size: int, limit: float):
        self.send, self.test, self.size, self.limit = send, test, size, limit
        self.waiting: deque[dict] = deque()
        self.dropped = self.sent = 0
        self.closed, self.busy_since, self.error = False, None, None
        self.ready = threading.Condition()
        threading.Thread(target=self._run, daemon=True).start()

    def offer(self, row: dict) -> None:
        """Never waits."""
        with self.ready:
            if self.closed:
                return
            if len(self.waiting) >= self.size:
                self.dropped += 1
            else:
                self.waiting.append(row)
                self.ready.notify_all()

    def _run(self) -> None:
        while True:
            with self.ready:
                while not self.waiting and not self.closed:
                    self.ready.wait()
                if self.closed:
                    return
                row, self.busy_since = self.waiting.popleft(), time.monotonic()
            try:
                self.send(row)
            except Exception as e:  # noqa: BLE001
                self.error = e
                self.close()
                return
            with self.ready:
                self.busy_since = None
                self.sent += 1
                self.ready.notify_all()

    def late(self) -> bool:
        """Whether it has been sending one row for longer than its limit."""
        since = self.busy_since
        return since is not None and time.monotonic() - since > self.limit

    def close(self) -> None:
        with self.ready:
            self.closed = True
            self.waiting.clear()
            self.ready.notify_all()

    def drained(self, timeout: float = 10.0) -> bool:
        """Waits until all that it was offered has been sent."""
        with self.ready:
            return self.ready.wait_for(lambda: self.closed or not self.waiting and self.busy_since is None, timeout)


class Hub:
    """Hands rows of batches to subscribers. A batch is read through in order, a partition at a time, and is never held as a whole;
    which subscribers a row is for, Spark tells along with it."""

    def __init__(self):
        self.subscribers: list[Subscriber] = []
        self.lock = threading.Lock()

    def subscribe(self, send: Callable[[dict], None], test: Column | None = None, size: int = 64, limit: float = 5.0) -> Subscriber:
        """test: a Column such as filters.matches_view(), for the rows that it wants. limit: seconds that sending a row may take."""
        one = Subscriber(send, test, size, limit)
        with self.lock:
            self.subscribers.append(one)
        return one

    def unsubscribe(self, one: Subscriber) -> None:
        one.close()
        with self.lock:
            self.subscribers = [s for s in self.subscribers if s is not one]

    def publish(self, rows: DataFrame) -> None:
        with self.lock:
            there = list(self.subscribers)
        for s in there:
            if s.closed or s.late():
                self.unsubscribe(s)
        there = [s for s in there if not s.closed]
        if not there:
            return
        tests = [F.lit(True) if s.test is None else F.coalesce(s.test, F.lit(False)) for s in there]
        for row in rows.select("*", F.array(*tests).alias("_for")).where(F.exists("_for", lambda x: x)).orderBy("seq").toLocalIterator():
            found = row.asDict()
            for wanted, s in zip(found.pop("_for"), there, strict=True):
                if wanted:
                    s.offer(found)
