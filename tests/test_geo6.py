"""IPv6 lookup against the standard library's addresses."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from webtraffic.operators import geo as G
from webtraffic.operators.ingest import derive_visitor_details
from webtraffic.schema import GEO_RANGES_V6, HIT
from webtraffic.operators.ingest import normalize_hits

TEXTS = ["::", "::1", "1::", "2001:db8::1", "2001:DB8:0:0:1::8", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "fe80::1%eth0",
         " 2001:db8::5 ", "1:2:3:4:5:6:1.2.3.4", "1::2::3", ":::", ":1", "1:", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "1.2.3.4", "",
         "::1.2.3.256", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", None]


def _parsed(text):
    try:
        return f"{int(ipaddress.IPv6Address((text or '').strip().split('%')[0])):032x}"
    except ValueError:
        return None


def test_addresses_as_the_standard_library(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "ip string").select("ip", G.ipv6_hex("ip").alias("x"))
    assert {r.ip: r.x for r in df.collect()} == {t: _parsed(t) for t in TEXTS}


def _ranges(seed, n=40):
    """Ranges that do not overlap, of every size, some next to one another, and networks."""
    r = random.Random(seed)
    base = int(ipaddress.IPv6Address("2001:db8::"))
    edges = sorted({base + r.getrandbits(r.choice([4, 17, 40, 64, 90])) for _ in range(n)})
    out = [(a, b - 1) for a, b in zip(edges, edges[1:]) if r.random() < 0.7]
    out += [(int(net[0]), int(net[-1])) for net in map(ipaddress.IPv6Network, ("2a00::/16", "2a01:100::/29", "2a02:1::/64", "2a03::7/128"))]
    return [(str(ipaddress.IPv6Address(a)), str(ipaddress.IPv6Address(b)), f"c{k}", None, "") for k, (a, b) in enumerate(out)]


def _country(ranges, text):
    x = _parsed(text)
    for a, b, c, *_ in ranges:
        if x is not None and _parsed(a) <= x <= _parsed(b):
            return c
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_prefixes_cover_exactly_their_ranges(spark, seed):
    ranges = _ranges(seed)
    rows = G.range_prefixes(spark.createDataFrame(ranges, GEO_RANGES_V6)).collect()
    by = {}
    for r in rows:
        free = 4 * (32 - len(r.prefix))
        a = int(r.prefix or "0", 16) << free
        by.setdefault(r.geo_country, []).append((a, a + (1 << free) - 1))
    for a, b, c, *_ in ranges:
        parts = sorted(by[c])
        assert parts[0][0] == int(_parsed(a), 16) and parts[-1][1] == int(_parsed(b), 16)
        assert all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:]))


def _hits(spark, ranges, seed):
    r = random.Random(seed)
    ips = [*TEXTS, "9.9.9.9"]
    for a, b, *_ in ranges:
        lo, hi = int(_parsed(a), 16), int(_parsed(b), 16)
        for x in (lo, hi, lo - 1, hi + 1, r.randint(lo, hi)):
            ips.append(r.choice([str(ipaddress.IPv6Address(x)), ipaddress.IPv6Address(x).exploded.upper()]))
    ips += [ips[-1]] * 50  # one very common address
    return spark.createDataFrame(
        [(f"v{i}", "s", None, "pageview", ("/", "t", None), ("a", "en"), (1, 1), ip, None, None, None, i) for i, ip in enumerate(ips)], HIT
    ).withColumn("received_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def test_details_get_the_place_of_their_range(spark, broadcast_threshold):
    ranges = _ranges(5)
    valid, _ = normalize_hits(_hits(spark, ranges, 6))
    ips = {r.hit_id: r.ip for r in valid.collect()}
    for size in ("-1", "10MB"):
        broadcast_threshold(size)
        out = derive_visitor_details(valid, geo_ranges6=spark.createDataFrame(ranges, GEO_RANGES_V6))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        got = {r.id: r.country for r in out.collect()}
        assert got == {i: None if ip in ("::1", None) or ip.startswith("::ffff:") else _country(ranges, ip) for i, ip in ips.items() if ip is not None}


def test_a_stream_gets_the_same(spark, tmp_path):
    ranges = _ranges(7, 3)
    hits = _hits(spark, ranges, 8)
    hits.write.parquet(str(tmp_path / "hits"))
    geo = spark.createDataFrame(ranges, GEO_RANGES_V6)
    static, _ = normalize_hits(hits)
    valid, _ = normalize_hits(spark.readStream.schema(hits.schema).parquet(str(tmp_path / "hits")))
    q = (derive_visitor_details(valid, geo_ranges6=geo).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start(str(tmp_path / "out")))
    q.awaitTermination()
    rows = lambda df: sorted((r.id, r.country) for r in df.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(derive_visitor_details(static, geo_ranges6=geo))
