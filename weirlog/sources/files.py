"""Files and folders through Spark's own file systems, so local, HDFS and object store paths are treated alike."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def has_scheme(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) is not None


class Files:
    """A few calls of the file system that Spark reads a path with."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _of(self, path: str):
        found = self.jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.conf), found

    def exists(self, path: str) -> bool:
        fs, p = self._of(path)
        return fs.exists(p)

    def age(self, path: str) -> float:
        """Seconds since a file or folder was changed."""
        fs, p = self._of(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def remove(self, path: str) -> None:
        fs, p = self._of(path)
        fs.delete(p, True)

    def glob(self, pattern: str) -> list[str]:
        fs, p = self._of(pattern)
        return sorted(x.getPath().toString() for x in fs.globStatus(p) or [])

    def names(self, folder: str) -> list[str]:
        fs, p = self._of(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def write(self, path: str, text: str) -> None:
        fs, p = self._of(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        fs, p = self._of(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """A new file as a whole, or False if there is one of that name: written beside it, and renamed where the file system allows
        this only if nothing is there (at once on HDFS; object stores check first, then copy a file of a few kilobytes)."""
        fs, p = self._of(path)
        beside = f"{path}.{uuid.uuid4().hex}"
        self.write(beside, text)
        old, new = fs.makeQualified(self._of(beside)[1]), fs.makeQualified(p)
        how = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.conf)
            context.rename(old, new, self.jvm.java.lang.reflect.Array.newInstance(how, 0))
        except Exception as e:
            fs.delete(old, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def facts(self, path: str) -> list[tuple[str, int, int]]:
        """Path, size and time of change of a file, or of the files of a folder."""
        fs, p = self._of(path)
        return sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(p))


def fingerprint(files: Files, paths: list[str]) -> str:
    facts = [f for p in sorted(paths) for f in files.facts(p)]
    return hashlib.sha256("".join(f"{p}\0{s}\0{t}\n" for p, s, t in facts).encode()).hexdigest()[:24]


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master gets one of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/weirlog"
    return found


def sweep(spark: SparkSession, folder: str, prefixes: tuple[str, ...], age: float = 7 * 86_400) -> list[str]:
    """Removes what applications have left behind there under these names and nobody has changed for so many seconds."""
    files = Files(spark)
    old = [n for n in files.names(folder) if n.startswith(prefixes) and files.age(f"{folder}/{n}") >= age]
    for n in old:
        files.remove(f"{folder}/{n}")
    return old


def once(spark: SparkSession, at: str, make: Callable[[], DataFrame], by: list[str]) -> str:
    """Writes a table below a folder unless it has one, and returns where it is. A table counts once the folder's manifest
    names it, which only the first writer can create; what another one has written goes again."""
    files = Files(spark)
    if not files.exists(f"{at}/manifest.json"):
        mine = f"{at}/rows-{uuid.uuid4().hex}"
        make().write.partitionBy(*by).parquet(mine)
        if not files.create(f"{at}/manifest.json", json.dumps({"rows": mine})):
            files.remove(mine)
    return json.loads(files.read(f"{at}/manifest.json"))["rows"]
