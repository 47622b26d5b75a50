"""Growing log files as a stream: Spark's file source sees new files only, this one sees bytes that are appended.

The offset says of each file which inodes it has been and the byte behind the last whole line of each that was read:
{"files": {path: [[inode, byte], ...]}, "read": bytes so far}. A file that was replaced is read from its start, after what
was left of the one before, which is found by its inode under the name it has now; a file that shrank is read from its start. Files
that come to match a pattern later are read from their start; one that comes and is renamed between two looks is never seen. A batch takes maxBytes at most, shared so that no file takes
more than its part while others have lines left; only a single line that is longer than that is taken as a whole. It is
read in spans, each a task, so executors must see the files under the same paths.

Spark doesn't tell a reader where it restarts; `resume`, the last offset of the query's checkpoint, does (see live.tail()). A
restart without it is an error, as the reader would fall back behind what the query has read.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a task.
SPAN = 16 << 20


class Span(InputPartition):
    def __init__(self, path: str, name: str, inode: int, start: int, end: int, before: int):
        super().__init__(None)
        self.path, self.name, self.inode, self.start, self.end, self.before = path, name, inode, start, end, before


def whole_lines_end(path: str, start: int, end: int) -> int:
    """Byte behind the last line end at or before `end`, found from the back; `start` if there is none."""
    with open(path, "rb") as f:
        at = end
        while at > start:
            step = max(start, at - 65_536)
            f.seek(step)
            found = f.read(at - step).rfind(b"\n")
            if found >= 0:
                return step + found + 1
            at = step
    return start


def first_line_end(path: str, start: int, end: int) -> int:
    """Byte behind the first line end from `start` on; 0 if there is none before `end`."""
    with open(path, "rb") as f:
        f.seek(start)
        for at in range(start, end, 65_536):
            found = f.read(min(65_536, end - at)).find(b"\n")
            if found >= 0:
                return at + found + 1
    return 0


def place_of(path: str, inode: int) -> str | None:
    """Where the file that was known by this path is now."""
    folder = os.path.dirname(path) or "."
    try:
        if os.stat(path).st_ino == inode:
            return path
    except FileNotFoundError:
        pass
    try:
        with os.scandir(folder) as there:
            return next((x.path for x in there if x.inode() == inode), None)
    except FileNotFoundError:
        return None


def shares(wanted: list[int], most: int) -> list[int]:
    """What each may take of `most`: all if it is little, else an equal part of what the others leave."""
    out, left = [0] * len(wanted), most
    order = sorted(range(len(wanted)), key=lambda i: wanted[i])
    for k, i in enumerate(order):
        out[i] = min(wanted[i], left // (len(order) - k))
        left -= out[i]
    return out


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.patterns = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.from_start = options.get("fromstart", "true").lower() == "true"
        self.starts, self.most = json.loads(options.get("startbytes", "{}")), int(options.get("maxbytes", str(64 << 20)))
        self.now: dict | None = json.loads(options["resume"]) if options.get("resume") else None
        self.first: dict | None = None

    def _files(self) -> list[str]:
        return sorted({p for pattern in self.patterns for p in ([pattern] if os.path.exists(pattern) else glob.glob(pattern)) if os.path.isfile(p)})

    def initialOffset(self) -> dict:
        """Where the query begins; Spark asks for it after the first latestOffset()."""
        if self.first is None:
            self.first = self._begin()
        return self.first

    def _begin(self) -> dict:
        files = {}
        for p in self._files():
            s = os.stat(p)
            files[p] = [[s.st_ino, min(self.starts.get(p, 0), s.st_size) if self.from_start else s.st_size]]
        return {"files": files, "read": 0}

    def _seen(self) -> dict[str, list[list[int]]]:
        """The files as they are, each with the inodes that it has been and how far these have been read; an inode that is gone is left out."""
        known = self.now["files"]
        out = {}
        for p in sorted({*known, *self._files()}):
            had = [list(x) for x in known.get(p, [])]
            try:
                s = os.stat(p)
                if not had or had[-1][0] != s.st_ino:
                    had.append([s.st_ino, 0])
                elif s.st_size < had[-1][1]:
                    had[-1][1] = 0
            except FileNotFoundError:
                pass
            left = [x for x in had[:-1] if (at := place_of(p, x[0])) and os.path.getsize(at) > x[1]] + had[-1:]
            out[p] = left
        return out

    def latestOffset(self) -> dict:
        if self.now is None:
            self.now = self.initialOffset()
        files, read = self._seen(), self.now["read"]
        ends: list[tuple[list[int], str, int, bool]] = []  # of each inode: its state, its place, its size, whether another one follows
        for p, had in files.items():
            for k, x in enumerate(had):
                if at := place_of(p, x[0]):
                    ends.append((x, at, os.path.getsize(at), k + 1 < len(had)))
        parts = shares([size - x[1] for x, _, size, _ in ends], self.most)
        for (x, at, size, old), part in zip(ends, parts, strict=True):
            upto = x[1] + part
            to = upto if old and upto == size else whole_lines_end(at, x[1], upto) if part else x[1]  # nobody ends the last line of an old one
            read, x[1] = read + to - x[1], to
        if read == self.now["read"]:
            for x, at, size, _ in ends:  # no line fits: one is taken as a whole
                if to := first_line_end(at, x[1], size):
                    read, x[1] = read + to - x[1], to
                    break
        self.now = {"files": files, "read": read}
        return self.now

    def partitions(self, start: dict, end: dict) -> list[Span]:
        if end["read"] < start["read"]:
            raise ValueError("the query has read more than its source knows; restart it with `resume`")
        self.now = end
        spans, before = [], start["read"]
        for p, had in sorted(end["files"].items()):
            was = {inode: byte for inode, byte in start["files"].get(p, [])}
            for inode, byte in had:
                at = was.get(inode, 0) if was.get(inode, 0) <= byte else 0
                if at >= byte:
                    continue
                name = place_of(p, inode)
                if name is None:
                    raise FileNotFoundError(f"{p} was removed before bytes {at} to {byte} were read")
                while at < byte:
                    to = byte if byte - at <= SPAN else whole_lines_end(name, at, at + SPAN)
                    to = to if to > at else first_line_end(name, at, byte) or byte
                    spans.append(Span(p, name, inode, at, to, before))
                    before += to - at
                    at = to
        return spans or [Span("", "", 0, 0, 0, before)]

    def read(self, partition: Span) -> Iterator[tuple]:
        if partition.end <= partition.start:
            return
        name = partition.name
        if not os.path.exists(name) or os.stat(name).st_ino != partition.inode:
            name = place_of(partition.path, partition.inode)
        if name is None:
            raise FileNotFoundError(f"{partition.path} isn't there, or is another file than the driver sees; executors must see the files that are followed")
        with open(name, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline(partition.end - at)
                if not line:
                    return
                if text := line.rstrip(b"\r\n"):
                    yield text.decode("utf-8", "replace"), partition.path, at, partition.before + at - partition.start
                at += len(line)

    def commit(self, end: dict) -> None:
        pass  # offsets live in Spark's checkpoint


class TailSource(DataSource):
    """spark.readStream.format("tail").option("paths", JSON list of files and globs).load(): a line, its file, the byte it
    begins at, and its place among all bytes that the stream has read, by which lines of all files are in order."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string, file string, byte long, arrival long"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})
