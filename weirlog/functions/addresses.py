"""Addresses as numbers, in Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_number(ip: Column) -> Column:
    """A dotted address as a number, null for anything else."""
    part = [F.try_to_number(F.split_part(ip, F.lit("."), F.lit(i)), F.lit("999")).cast("long") for i in range(1, 5)]
    number = part[0] * 16_777_216 + part[1] * 65_536 + part[2] * 256 + part[3]
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times and computes it once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ip_halves(ip: Column, fold: bool = True) -> Column:
    """An address as (hi, lo), 64 bits each as signed longs, null for anything else. A dotted address is a number below 2^32, and
    so is one mapped into IPv6 (::ffff:1.2.3.4), unless fold is false; an address with a zone is none."""
    pair = lambda hi, lo: F.struct(hi.alias("hi"), lo.alias("lo"))
    zero, groups_of = F.lit(0).cast("long"), lambda x: F.filter(F.split(x, ":"), lambda g: g != "")

    def numbered(x: Column) -> Column:
        """Of (text, octets at its end): the octets as a number, null if one is too large."""
        return F.when(F.forall(x["octets"], lambda o: o < 256), F.aggregate(x["octets"], zero, lambda a, o: a * 256 + o))

    def halves(groups: Column) -> Column:
        half = lambda i: F.aggregate(F.slice(groups, i, 4), zero, lambda a, g: F.shiftleft(a, 16).bitwiseOR(F.conv(g, 16, 10).cast("long")))
        mapped = lambda p: (p["hi"] == 0) & (F.shiftrightunsigned(p["lo"], 32) == 0xFFFF)
        folded = lambda p: pair(p["hi"], F.when(mapped(p), p["lo"].bitwiseAND(0xFFFFFFFF)).otherwise(p["lo"])) if fold else p
        return F.when(F.size(groups) == 8, _let(pair(half(1), half(5)), folded))

    def filled(text: Column) -> Column:
        """Eight groups of digits; what "::" stands for is at least one of zero."""
        parts = F.struct(groups_of(F.substring_index(text, "::", 1)).alias("head"), groups_of(F.substring_index(text, "::", -1)).alias("rest"))
        spread = _let(parts, lambda p: F.concat(p["head"], F.array_repeat(F.lit("0"), F.greatest(8 - F.size(p["head"]) - F.size(p["rest"]), F.lit(1))), p["rest"]))
        return F.when(text.contains("::"), spread).otherwise(groups_of(text))

    shape = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$"
    octets = F.transform(F.split(F.regexp_extract(ip, r"(\d{1,3}(?:\.\d{1,3}){3})$", 1), r"\."), lambda o: o.try_cast("int").cast("long"))
    ends = F.struct(F.lower(ip).alias("text"), octets.alias("octets"))
    as_groups = lambda n: F.format_string("%x:%x", F.shiftright(n, 16), n.bitwiseAND(65535))
    mixed = _let(ends, lambda x: F.concat(F.regexp_replace(x["text"], r"\d{1,3}(\.\d{1,3}){3}$", ""), _let(numbered(x), as_groups)))
    text = F.when(ip.contains("."), mixed).otherwise(F.lower(ip))
    v6 = _let(text, lambda t: F.when(t.rlike(shape), _let(filled(t), halves)))
    v4 = F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), _let(_let(ends, numbered), lambda n: F.when(n.isNotNull(), pair(zero, n))))
    return F.when(ip.contains(":"), v6).otherwise(v4)


#: Local networks: the first address and the length of the prefix, of dotted addresses and of IPv6 (the high half).
LOCAL_V4 = [((10, 0), 8), ((172, 16), 12), ((192, 168), 16), ((100, 64), 10), ((127, 0), 8), ((169, 254), 16), ((0, 0), 8)]
LOCAL_V6 = [(0xFC00, 7), (0xFE80, 10)]


def local_number(n: Column) -> Column:
    """Whether the number of a dotted address is in a local network."""
    tests = [F.shiftright(n, 32 - bits) == (a << 24 | b << 16) >> (32 - bits) for (a, b), bits in LOCAL_V4]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def local_v6(ip: Column) -> Column:
    """Whether an address with colons is a local one: unique local, link local, ::1, ::, or a local dotted one that is mapped."""

    def inside(p: Column) -> Column:
        high = F.lit(False)
        for first, bits in LOCAL_V6:
            high = high | (F.shiftrightunsigned(p["hi"], 64 - bits) == first >> (16 - bits))
        low = (p["hi"] == 0) & (p["lo"].between(0, 1) | ((F.shiftrightunsigned(p["lo"], 32) == 0xFFFF) & local_number(p["lo"].bitwiseAND(0xFFFFFFFF))))
        return high | low

    return F.coalesce(_let(ip_halves(ip, fold=False), inside), F.lit(False))
