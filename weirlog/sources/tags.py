"""The tag document: ip to tag, time, source and reason, as an indented JSON file written beside and renamed."""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile
import time
from contextlib import closing
from dataclasses import asdict, dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from weirlog.model import TAGS


@dataclass
class Tag:
    tag: str
    at: float
    source: str = "manual"
    reason: str = ""


class TagSet:
    """Tags by address and the history of what was applied; removing a tag leaves what it did to the rows."""

    def __init__(self, path: str | None = None):
        self.path, self.tags, self.history = path, {}, []
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
            entries = found.get("tags", found)
            for ip, x in entries.items():
                self.tags[ip] = Tag(x["tag"], x.get("at", 0.0), x.get("source") or "manual", x.get("reason", ""))
            self.history = [tuple(h) for h in found.get("history", [])] if "tags" in found else [(ip, t.tag) for ip, t in self.tags.items()]

    def adopt(self, database: str) -> int:
        """Takes over the table manual_tags(ip, tag, at) of an older store's SQLite file, its times in nanoseconds, where this document
        has no tags yet; returns how many. What isn't a tag is passed over, a file or table that isn't there has none."""
        if self.tags or not os.path.exists(database):
            return 0
        with closing(sqlite3.connect(f"file:{quote(os.path.abspath(database))}?mode=ro", uri=True)) as old:
            there = old.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = 'manual_tags'").fetchone()
            found = old.execute("SELECT ip, tag, at FROM manual_tags ORDER BY at, ip").fetchall() if there else []  # a row per tag that somebody set by hand
        for ip, tag, at in found:
            if tag in TAGS:
                self.put(ip, tag, at=(at or 0) / 1e9)
        self.save()
        return len(self.tags)

    def put(self, ip: str, tag: str, source: str = "manual", reason: str = "", at: float | None = None) -> None:
        if tag not in TAGS:
            raise ValueError(f"unknown tag {tag!r}")
        self.tags[ip] = Tag(tag, time.time() if at is None else at, source, reason)
        self.history.append((ip, tag))

    def delete(self, ip: str) -> bool:
        return self.tags.pop(ip, None) is not None

    def get(self, ip: str) -> Tag | None:
        return self.tags.get(ip)

    def newest(self, source: str = "") -> list[tuple[str, Tag]]:
        """Of a source, or of all; the newest first."""
        return sorted(((ip, t) for ip, t in self.tags.items() if not source or t.source == source), key=lambda x: (-x[1].at, x[0]))

    def addresses(self) -> list[str]:
        """All that have been tagged, also those whose tag is gone."""
        return sorted({ip for ip, _ in self.history})

    def save(self) -> None:
        if not self.path:
            return
        folder = os.path.dirname(os.path.abspath(self.path))
        os.makedirs(folder, exist_ok=True)
        fd, beside = tempfile.mkstemp(dir=folder)
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump({"tags": {ip: asdict(t) for ip, t in self.tags.items()}, "history": self.history}, f, indent=2)
        os.replace(beside, self.path)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(ip, t.tag, t.source, t.reason) for ip, t in self.tags.items()], "ip string, tag string, source string, reason string")

    def history_frame(self, spark: SparkSession) -> DataFrame | None:
        if not self.history:
            return None
        return spark.createDataFrame([(ip, tag, n) for n, (ip, tag) in enumerate(self.history)], "ip string, tag string, n long")
