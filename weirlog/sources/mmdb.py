"""Place databases in the MaxMind DB format (its public specification, version 2) as a batch source of networks.

The file is a binary tree over the bits of addresses, whose leaves point into a section of typed data. The driver reads the
description at the end and cuts the tree into subtrees some levels down; a task walks its subtree without recursion over a
memory map of the file, so executors must see it under the same path. Networks come as two longs (signed, the high and the
low 64 bits) and a prefix length out of 128; IPv4 networks lie below ::/96, and where a tree lists them again
(::ffff:0:0/96 and tunnels) that is left out.
"""

from __future__ import annotations

import json
import mmap
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MARKER = b"\xab\xcd\xefMaxMind.com"
#: Levels at which the tree is cut into partitions, below its root and below the root of IPv4; data that a task keeps decoded.
LEVELS, KEPT = 8, 50_000
_CODES = {2: "text", 3: "double", 4: "bytes", 5: "uint", 6: "uint", 7: "map", 8: "int", 9: "uint", 10: "uint", 11: "array", 14: "bool", 15: "float"}


class Data:
    """Decodes values of the data section that begins at `base`."""

    def __init__(self, raw: bytes | mmap.mmap, base: int):
        self.raw, self.base = raw, base

    def value(self, at: int) -> tuple[object, int]:
        """The value at a place, and the place behind it; values that nest are decoded by calls of their depth."""
        control, at = self.raw[at], at + 1
        kind, size = control >> 5, control & 31
        if kind == 1:
            more, low = size >> 3, size & 7
            read = int.from_bytes(self.raw[at : at + more + 1], "big")
            target = read if more == 3 else (low << 8 * (more + 1)) + read + (0, 2048, 526_336)[more]
            return self.value(self.base + target)[0], at + more + 1
        if kind == 0:
            kind, at = self.raw[at] + 7, at + 1
        if size > 28:
            extra = size - 28
            size, at = (29, 285, 65_821)[extra - 1] + int.from_bytes(self.raw[at : at + extra], "big"), at + extra
        what = _CODES.get(kind)
        if what == "map":
            found = {}
            for _ in range(size):
                key, at = self.value(at)
                found[key], at = self.value(at)
            return found, at
        if what == "array":
            items = []
            for _ in range(size):
                item, at = self.value(at)
                items.append(item)
            return items, at
        if what == "bool":
            return bool(size), at
        part = bytes(self.raw[at : at + size])
        if what == "text":
            return part.decode(), at + size
        if what == "double":
            return struct.unpack(">d", part)[0], at + size
        if what == "float":
            return struct.unpack(">f", part)[0], at + size
        if what == "uint":
            return int.from_bytes(part, "big"), at + size
        if what == "int":
            return int.from_bytes(part, "big", signed=size == 4), at + size
        if what == "bytes":
            return part, at + size
        raise ValueError(f"data of type {kind}")


class Database:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        found = self.raw.rfind(MARKER)
        if found < 0:
            raise ValueError(f"{path} isn't a place database")
        self.about = Data(self.raw, found + len(MARKER)).value(found + len(MARKER))[0]
        self.nodes, self.bits, self.version = (self.about[k] for k in ("node_count", "record_size", "ip_version"))
        if self.bits not in (24, 28, 32):
            raise ValueError(f"records of {self.bits} bits")
        self.data = Data(self.raw, self.nodes * self.bits // 4 + 16)
        self.v4 = 0
        for _ in range(96 if self.version == 6 else 0):
            self.v4 = self.child(self.v4, 0) if self.v4 < self.nodes else self.v4
        self.kept: dict[int, object] = {}

    def child(self, node: int, side: int) -> int:
        """A number below `nodes` is a node, `nodes` is nothing, one above is data."""
        width = self.bits // 4
        at = node * width
        if self.bits == 28:
            middle = self.raw[at + 3]
            high = middle >> 4 if side == 0 else middle & 15
            return high << 24 | int.from_bytes(self.raw[at + 4 * side : at + 4 * side + 3], "big")
        half = width // 2
        return int.from_bytes(self.raw[at + half * side : at + half * (side + 1)], "big")

    def record(self, number: int) -> object:
        if number not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[number] = self.data.value(self.data.base + number - self.nodes - 16)[0]
        return self.kept[number]

    def walk(self, node: int, prefix: int, bits: int, upto: int) -> Iterator[tuple[int, int, int]]:
        """(node or data, prefix as a number, its length) of what lies below a node: data, and nodes at the depth `upto`."""
        todo = [(node, prefix, bits)]
        while todo:
            node, prefix, bits = todo.pop()
            if node == self.nodes:
                continue
            if node > self.nodes or bits == upto:
                yield node, prefix, bits
            elif not (node == self.v4 and self.version == 6 and bits and prefix << (128 - bits) >> 32):  # IPv4 again, by another way
                todo += [(self.child(node, side), prefix << 1 | side, bits + 1) for side in (1, 0)]


class Subtree(InputPartition):
    def __init__(self, node: int, prefix: int, bits: int):
        super().__init__(None)
        self.node, self.prefix, self.bits = node, prefix, bits


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class MmdbReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Subtree]:
        db = Database(self.path)
        if db.version == 4:
            return [Subtree(*x) for x in db.walk(0, 0, 96, 96 + LEVELS)]
        found = []
        for node, prefix, bits in db.walk(0, 0, 0, LEVELS):
            if prefix or node > db.nodes:
                found.append((node, prefix, bits))
                continue
            at = node  # what is on the way to IPv4, and IPv4 itself
            for depth in range(bits, 96):
                found.append((db.child(at, 1), 1, depth + 1))
                at = db.child(at, 0)
                if at >= db.nodes:
                    found.append((at, 0, depth + 1))
                    break
            else:
                found += db.walk(at, 0, 96, 96 + LEVELS)
        return [Subtree(*x) for x in found if x[0] != db.nodes]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        db = Database(self.path)
        name = lambda of: str(((of or {}).get("names") or {}).get("en", ""))
        for number, prefix, bits in db.walk(partition.node, partition.prefix, partition.bits, 128):
            if number < db.nodes:
                continue
            record, start = db.record(number), prefix << (128 - bits)
            place = record if isinstance(record, dict) else {}
            yield _long(start >> 64), _long(start & (1 << 64) - 1), bits, name(place.get("country")), name(place.get("city")), json.dumps(record, default=str, ensure_ascii=False)


class MmdbSource(DataSource):
    """spark.read.format("mmdb").option("path", file).load(): networks with the English names of country and city ('' without one) and all data as JSON."""

    @classmethod
    def name(cls) -> str:
        return "mmdb"

    def schema(self) -> str:
        return "hi long, lo long, bits int, country string, city string, data string"

    def reader(self, schema: StructType) -> MmdbReader:
        return MmdbReader(self.options["path"])
