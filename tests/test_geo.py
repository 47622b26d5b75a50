"""Addresses as numbers, longest prefixes, and place databases that the tests build themselves."""

import ipaddress
import random
import struct

import pytest
from pyspark.sql import functions as F

from weirlog.sources.geo import ip_halves, locate, networks
from weirlog.sources.mmdb import MARKER, Database, MmdbReader


def number(text):
    """The 128-bit number of an address; mapped ones are dotted ones."""
    try:
        x = ipaddress.ip_address(text)
    except ValueError:
        return None
    if "%" in text:
        return None
    x = getattr(x, "ipv4_mapped", None) or x
    return int(x)


def test_halves(spark):
    rnd = random.Random(1)
    cases = ["1.2.3.4", "256.1.1.1", "1.2.3", "", "::", "::1", "1::", "fe80::1%eth0", "2001:db8::1::2", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.4", "::FFFF:255.255.255.255", "::1.2.3.4", "64:ff9b::1.2.3.4", "::ffff:300.1.1.1", "12345::", "g::", ":1::", "1:::2", "x", ":", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "1::2:3:4:5:6:7:8"]
    cases += [str(ipaddress.ip_address(rnd.getrandbits(128) & rnd.getrandbits(128) & rnd.getrandbits(128))) for _ in range(200)] + [ipaddress.ip_address(rnd.getrandbits(128)).exploded.upper() for _ in range(20)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ip string")
    for r in df.select("i", ip_halves(F.col("ip")).alias("h")).collect():
        got = None if r["h"] is None else (r["h"]["hi"] % 2**64) << 64 | r["h"]["lo"] % 2**64
        assert got == number(cases[r["i"]]), cases[r["i"]]


def longest(nets, text):
    x = number(text)
    found = [(bits, place) for net, bits, place in nets if x is not None and x >> (128 - bits) == net >> (128 - bits)] if x is not None else []
    return max(found)[1] if found else ("", "")


def random_nets(rnd, n):
    """Disjoint or nested networks of both kinds, as (first address, length, place)."""
    out = {}
    for i in range(n):
        bits = rnd.choice([97, 104, 112, 120, 128, 128]) if i % 2 else rnd.choice([16, 32, 33, 47, 48, 64, 65, 128])
        x = rnd.getrandbits(32) if i % 2 else 0x2001 << 112 | rnd.getrandbits(8) << 100 | rnd.getrandbits(60)
        out[x >> (128 - bits) << (128 - bits), bits] = (f"country {i % 7}", f"Stadt {i} é")
    return [(net, bits, place) for (net, bits), place in out.items()]


def test_longest_prefix(spark):
    rnd = random.Random(2)
    nets = random_nets(rnd, 150)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    table = spark.createDataFrame([(signed(n >> 64), signed(n & 2**64 - 1), b, *p) for n, b, p in nets], "hi long, lo long, bits int, country string, city string")
    ips = [str(ipaddress.IPv4Address(net | rnd.getrandbits(128 - b))) if net < 2**32 else str(ipaddress.IPv6Address(net | rnd.getrandbits(128 - b))) for net, b, _ in nets for _ in range(2)] + ["", "9.9.9.9", "::1", "nope", "::ffff:1.2.3.4"]
    rows = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips * 2)], "i int, ip string")
    for r in locate(rows, table).collect():
        assert (r["country"], r["city"]) == longest(nets, r["ip"]), r
    plan = locate(rows, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# A writer of the format, for the tests only.


def encoded(x):
    def control(kind, size):
        extra = b""
        if size >= 285:
            size, extra = 30, struct.pack(">H", size - 285)
        elif size >= 29:
            size, extra = 29, bytes([size - 29])
        return (bytes([kind << 5 | size]) if kind < 8 else bytes([size, kind - 7])) + extra

    if isinstance(x, bool):
        return control(14, int(x))
    if isinstance(x, str):
        return control(2, len(x.encode())) + x.encode()
    if isinstance(x, float):
        return control(3, 8) + struct.pack(">d", x)
    if isinstance(x, int) and x < 0:
        return control(8, 4) + struct.pack(">i", x)
    if isinstance(x, int):
        raw = x.to_bytes((x.bit_length() + 7) // 8, "big")
        return control(6 if len(raw) <= 4 else 9 if len(raw) <= 8 else 10, len(raw)) + raw
    if isinstance(x, dict):
        return control(7, len(x)) + b"".join(encoded(k) + encoded(v) for k, v in x.items())
    if isinstance(x, list):
        return control(11, len(x)) + b"".join(map(encoded, x))
    return x  # encoded already


def database(path, nets, record=28, version=6, alias=False):
    """A tree of disjoint or nested networks; nested ones are pushed down to leaves. Values share their country by pointers."""
    first = 96 if version == 4 else 0
    tree = [[None, None]]
    data, places = b"", {}

    def put(net, bits, value):
        node = 0
        for depth in range(first, bits):
            side = net >> (127 - depth) & 1
            if depth == bits - 1:
                if isinstance(tree[node][side], int):
                    fill(tree[node][side], value)
                else:
                    tree[node][side] = ("data", value)
                return
            if not isinstance(tree[node][side], int):
                tree.append([tree[node][side], tree[node][side]])
                tree[node][side] = len(tree) - 1
            node = tree[node][side]

    def fill(node, value):
        for side in (0, 1):
            if isinstance(tree[node][side], int):
                fill(tree[node][side], value)
            elif tree[node][side] is None:
                tree[node][side] = ("data", value)

    for net, bits, (country, city) in sorted(nets, key=lambda n: n[1]):
        if country not in places:
            places[country] = len(data)
            data += encoded({"names": {"de": "x", "en": country}, "n": [1, -2, 2**40, 2.5, True, "y" * 300]})
        at = places[country]
        pointer = bytes([1 << 5 | at >> 8, at & 255]) if at < 2048 else bytes([1 << 5 | 1 << 3 | (at - 2048) >> 16, (at - 2048) >> 8 & 255, (at - 2048) & 255])
        value = len(data)
        data += encoded({"country": pointer, "city": {"names": {"en": city}}})
        put(net, bits, value)
    if alias:  # ::ffff:0:0/96 leads to IPv4 too
        node = v4 = 0
        for _ in range(96):
            v4 = tree[v4][0]
        for depth in range(96):
            side = 1 if depth >= 80 else 0
            if depth == 95:
                tree[node][side] = v4
            elif not isinstance(tree[node][side], int):
                tree.append([None, None])
                tree[node][side] = len(tree) - 1
            node = tree[node][side]
    n = len(tree)
    code = lambda x: n if x is None else x if isinstance(x, int) else n + 16 + x[1]
    raw = b""
    for a, b in ((code(x), code(y)) for x, y in tree):
        raw += {24: lambda: a.to_bytes(3, "big") + b.to_bytes(3, "big"), 28: lambda: (a & 0xFFFFFF).to_bytes(3, "big") + bytes([a >> 24 << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big"), 32: lambda: a.to_bytes(4, "big") + b.to_bytes(4, "big")}[record]()
    about = {"node_count": n, "record_size": record, "ip_version": version, "database_type": "Test-City", "languages": ["en"], "binary_format_major_version": 2, "description": {"en": "z" * 400}}
    path.write_bytes(raw + bytes(16) + data + MARKER + encoded(about))


@pytest.mark.parametrize(("record", "version"), [(24, 6), (28, 6), (32, 6), (28, 4)])
def test_database(spark, tmp_path, record, version):
    """Places by the source equal those of the networks that the file was made of, read whole and by subtree."""
    rnd, path = random.Random(record), tmp_path / "places.mmdb"
    nets = [n for n in random_nets(rnd, 120) if version == 6 or n[0] < 2**32 and n[1] > 96]
    database(path, nets, record, version, alias=version == 6)
    got = networks(spark, str(path)).collect()
    ranges = sorted(((r["hi"] % 2**64) << 64 | r["lo"] % 2**64, r["bits"], r["country"], r["city"]) for r in got)
    ends = [(start, start + 2 ** (128 - bits)) for start, bits, _, _ in ranges]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False)) and len(MmdbReader(str(path)).partitions()) > 1  # none twice, the alias neither
    for start, bits, country, city in ranges:
        assert (country, city) == max((b, p) for net, b, p in nets if b <= bits and start >> (128 - b) == net >> (128 - b))[1]
    for net, bits, _ in nets:
        assert sum(min(e, net + 2 ** (128 - bits)) - max(s, net) for s, e in ends if s < net + 2 ** (128 - bits) and e > net) == 2 ** (128 - bits)
    ips = [str(ipaddress.ip_address(net + rnd.getrandbits(128 - b))) if net >= 2**32 else str(ipaddress.IPv4Address(net | rnd.getrandbits(128 - b))) for net, b, _ in nets]
    for r in locate(spark.createDataFrame([(x,) for x in ips], "ip string"), networks(spark, str(path))).collect():
        assert (r["country"], r["city"]) == longest(nets, r["ip"])
    with pytest.raises(ValueError):
        (tmp_path / "no").write_bytes(b"x" * 100)
        Database(str(tmp_path / "no"))


def test_local_addresses(spark):
    """IPv6 addresses near the bounds of local networks, mapped ones and wrong ones, against Python's networks."""
    from weirlog.functions.labels import is_local

    nets = [ipaddress.ip_network(n) for n in ("::1/128", "fc00::/7", "fe80::/10", "::/128")]
    v4 = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8")]
    cases = ["fbff::", "fc00::", "fdff:ffff::1", "fe00::", "fe7f:ffff::", "fe80::", "febf::9", "fec0::", "ff02::1", "::", "::1", "::2", "::10.0.0.1", "::ffff:0:0", "1::ffff:10.0.0.1", "fe80::1%eth0", "x:", ":", "::ffff:10.0.0.256", "0:0:0:0:0:0:0:1"]
    cases += [f"::ffff:{n.network_address + d}" for n in v4 for d in (0, 1) if int(n.network_address) + d < 2**32] + [f"::FFFF:{n.broadcast_address + 1}" for n in v4] + ["10.1.2.3", "172.32.0.1", ""]

    def local(text):
        try:
            x = ipaddress.ip_address(text)
        except ValueError:
            return False
        if "%" in text:
            return False
        mapped = x if x.version == 4 else x.ipv4_mapped
        return any(mapped in n for n in v4) if mapped else any(x in n for n in nets)

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ip string")
    got = {cases[r["i"]]: r["x"] for r in df.select("i", is_local(F.col("ip")).alias("x")).collect()}
    assert got == {c: local(c) for c in cases}
