"""IP → country / region / city as a range join against a user-supplied range table.

The collector looked addresses up in a bundled GeoIP database; here the ranges are data
(``GEO_RANGES``: ip_from, ip_to inclusive, non-overlapping). Spark has no range join, so each
range is exploded into the /16 blocks it touches and hits join on (block, address between
bounds): an equi-join plus a residual range test, with no nested loop.

IPv6 ranges (``GEO_RANGES_V6``: addresses as text, inclusive) are cut into prefixes of whole hexadecimal digits, at most
960 for any range and one to eight for a usual network. An address is probed with its own prefixes of the
lengths that occur, by equality; the longest one that is there gives its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enrich import empty_to_null, is_local_ip

IPV4_RE = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
MAPPED_PREFIX = "::ffff:"
LINE_ENDS = "\n\r\u0085\u2028\u2029"
BLOCK_BITS = 16
NULL_KEY_SPREAD = 1024


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unmapped(ip) -> Column:
    """Address text without the spaces around it and the IPv4-mapped prefix."""
    t = F.trim(F.col(ip) if isinstance(ip, str) else ip)
    return F.when(t.startswith(MAPPED_PREFIX), t.substr(F.lit(len(MAPPED_PREFIX) + 1), F.length(t))).otherwise(t)


def _octets(s: Column) -> Column:
    """The four numbers of a dotted address as texts; a line's end behind it, which the pattern lets pass, is cut."""
    return F.when(s.rlike(IPV4_RE), F.split(F.translate(s, LINE_ENDS, ""), "\\."))


def _as_long(octets: Column) -> Column:
    n = [F.get(octets, F.lit(i)).cast("long") for i in range(4)]
    return F.when((F.greatest(*n) <= 255), (n[0] * 16777216) + (n[1] * 65536) + (n[2] * 256) + n[3])


def ipv4_to_long(ip) -> Column:
    """Dotted IPv4 (also in IPv4-mapped IPv6 form) → unsigned long; anything else → NULL."""
    return _let(_let(_unmapped(ip), _octets), _as_long)


def explode_ranges(geo_ranges: DataFrame) -> DataFrame:
    """One row per (range, /16 block it overlaps)."""
    return (geo_ranges
            .withColumn("_block", F.explode(F.sequence(F.shiftright("ip_from", BLOCK_BITS),
                                                       F.shiftright("ip_to", BLOCK_BITS))))
            .select("_block", F.col("ip_from").alias("_ip_from"), F.col("ip_to").alias("_ip_to"),
                    F.col("country").alias("geo_country"), F.col("region").alias("geo_region"),
                    F.col("city").alias("geo_city")))


def with_geo(hits: DataFrame, geo_ranges: DataFrame, ip_col: str = "ip",
             salt_col: str = "hit_id", broadcast: bool | None = None) -> DataFrame:
    """Add ``geo_country``, ``geo_region``, ``geo_city`` (NULL for local or unknown addresses).

    Spark broadcasts the range side if its size allows (``broadcast=True`` asks for it, for a table
    known to be small). Otherwise both sides shuffle on the block; a hot block is split by AQE's skew
    join, and rows with no address (local, IPv6, malformed) get a spread of negative block ids
    that never match, so they do not pile into the single partition of a NULL key.
    """
    ranges = explode_ranges(geo_ranges)
    spread = -1 - F.pmod(F.xxhash64(F.col(salt_col)), F.lit(NULL_KEY_SPREAD))
    # one column a step: each is computed once a row, where one nested expression would repeat its parts
    h = hits.withColumn("_addr", F.when(~is_local_ip(F.col(ip_col)), _unmapped(ip_col)))
    h = h.withColumn("_octets", _octets(F.col("_addr"))).withColumn("_ip_long", _as_long(F.col("_octets"))).drop("_addr", "_octets")
    h = h.withColumn("_blk", F.coalesce(F.shiftright("_ip_long", BLOCK_BITS), spread))
    r = F.broadcast(ranges) if broadcast else ranges
    cond = (F.col("_blk") == F.col("_block")) & F.col("_ip_long").between(F.col("_ip_from"),
                                                                          F.col("_ip_to"))
    out = h.join(r, cond, "left").drop("_blk", "_block", "_ip_from", "_ip_to", "_ip_long")
    return (out.withColumn("geo_country", empty_to_null("geo_country"))
               .withColumn("geo_region", empty_to_null("geo_region"))
               .withColumn("geo_city", empty_to_null("geo_city")))


HEX = 32  #: hexadecimal digits of an IPv6 address


def ipv6_hex(ip) -> Column:
    """IPv6 text (``::``, a dotted tail, a zone and any letter case allowed) -> its 32 hexadecimal digits; else NULL."""
    def dotted(s):
        tail = F.regexp_extract(s, r":(\d+\.\d+\.\d+\.\d+)$", 1)
        return F.when(tail == "", s).otherwise(_let(F.lpad(F.lower(F.hex(ipv4_to_long(tail))), 8, "0"), lambda low: F.concat(
            s.substr(F.lit(1), F.length(s) - F.length(tail)), F.substring(low, 1, 4), F.lit(":"), F.substring(low, 5, 4))))

    def filled(halves):
        groups = lambda part: F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))
        return _let(F.struct(groups(F.get(halves, F.lit(0))).alias("head"), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("rest")), lambda g: _let(
            F.lit(8) - F.size(g["head"]) - F.size(g["rest"]),
            lambda missing: F.when(
                ((F.size(halves) == 1) & (missing == 0)) | ((F.size(halves) == 2) & (missing >= 1)),
                F.concat(g["head"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)).cast("int")), g["rest"]))))

    def text(whole):
        return F.when(F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))

    plain = F.regexp_replace(F.lower(F.trim(F.col(ip) if isinstance(ip, str) else ip)), "%.*$", "")
    return _let(_let(F.split(_let(plain, dotted), "::"), filled), text)


def _digit(text: Column, at) -> Column:
    return F.conv(text.substr(at, F.lit(1)), 16, 10).cast("int")


def range_prefixes(geo_ranges6: DataFrame) -> DataFrame:
    """(prefix, geo_country, geo_region, geo_city): digits that all and only the addresses of a range begin with.

    Behind the digits that both bounds share come the digits between theirs, and along either bound those
    beyond its own digit, down to where the bound goes on with only zeros (or only f).
    """
    r = geo_ranges6.select(
        ipv6_hex("ip_from").alias("f"), ipv6_hex("ip_to").alias("t"), F.col("country").alias("geo_country"),
        F.col("region").alias("geo_region"), F.col("city").alias("geo_city"))
    f, t, p = F.col("f"), F.col("t"), F.col("p")
    places, digits = F.sequence(F.lit(1), F.lit(HEX)), F.sequence(F.lit(0), F.lit(15))
    one = F.lit(1)
    r = r.where(f <= t).withColumn("p", F.size(F.filter(places, lambda i: f.substr(one, i) == t.substr(one, i))))
    f_end, t_end = F.length(F.rtrim(f, F.lit("0"))), F.length(F.rtrim(t, F.lit("f")))
    r = r.withColumns({"k": F.greatest(p + 1, f_end), "l": F.greatest(p + 1, t_end)})
    grow = lambda text, i, d: F.concat(text.substr(one, i - 1), F.substring(F.lit("0123456789abcdef"), d + 1, one))
    between = F.transform(F.filter(digits, lambda d: (d > _digit(f, p + 1)) & (d < _digit(t, p + 1))), lambda d: grow(f, p + 1, d))
    above = F.flatten(F.transform(F.filter(places, lambda i: (i > p + 1) & (i <= F.col("k"))),
                                  lambda i: F.transform(F.filter(digits, lambda d: d > _digit(f, i)), lambda d: grow(f, i, d))))
    below = F.flatten(F.transform(F.filter(places, lambda i: (i > p + 1) & (i <= F.col("l"))),
                                  lambda i: F.transform(F.filter(digits, lambda d: d < _digit(t, i)), lambda d: grow(t, i, d))))
    tips = F.array(f.substr(one, F.col("k")), t.substr(one, F.col("l")))
    cut = F.when((f_end <= p) & (t_end <= p), F.array(f.substr(one, p))).otherwise(F.concat(tips, between, above, below))
    return r.select(F.explode(cut).alias("prefix"), "geo_country", "geo_region", "geo_city")


_GEO = ("geo_country", "geo_region", "geo_city")


def with_geo6(hits: DataFrame, geo_ranges6: DataFrame, ip_col: str = "ip", salt_col: str = "hit_id") -> DataFrame:
    """Fill ``geo_country``, ``geo_region``, ``geo_city`` (columns of ``hits``) for IPv6 addresses; others keep theirs.

    Distinct addresses are probed, so a prefix or an address that many hits share is joined once for each of its
    addresses; hits then join their address by equality, where AQE splits a hot one, and hits without an
    IPv6 address are spread over keys that never match. A stream cannot be made distinct: there each
    hit is joined to the static prefixes once for each length that occurs.
    """
    prefixes = range_prefixes(geo_ranges6)
    mine = F.when(F.col(ip_col).contains(":") & ~is_local_ip(F.col(ip_col)) & ipv4_to_long(ip_col).isNull(), ipv6_hex(ip_col))
    h = hits.withColumn("_hex", mine)
    if hits.isStreaming:
        lengths = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())  # at most 33
        for n in lengths:  # longer ones overrule
            part = prefixes.where(F.length("prefix") == n).select(F.col("prefix").alias("_prefix"), F.struct(*_GEO).alias("_geo"))
            h = h.join(part, F.substring("_hex", 1, n) == F.col("_prefix"), "left")
            h = h.withColumns({c: F.when(F.col("_prefix").isNotNull(), F.col(f"_geo.{c}")).otherwise(F.col(c)) for c in _GEO}).drop("_prefix", "_geo")
        out = h.drop("_hex")
    else:
        lengths = prefixes.agg(F.collect_set(F.length("prefix"))).scalar()
        probes = h.where(F.col("_hex").isNotNull()).select(F.col("_hex").alias("_addr")).distinct().withColumn("_n", F.explode(lengths))
        probes = probes.withColumn("prefix", F.col("_addr").substr(F.lit(1), F.col("_n")))
        found = probes.join(prefixes, "prefix").groupBy("_addr").agg(F.max_by(F.struct(*_GEO), "_n").alias("_geo"))
        spread = F.concat(F.lit("-"), F.pmod(F.xxhash64(F.col(salt_col)), F.lit(NULL_KEY_SPREAD)).cast("string"))
        h = h.withColumn("_hex", F.coalesce("_hex", spread)).join(found, F.col("_hex") == F.col("_addr"), "left")
        h = h.withColumns({c: F.when(F.col("_addr").isNotNull(), F.col(f"_geo.{c}")).otherwise(F.col(c)) for c in _GEO})
        out = h.drop("_hex", "_addr", "_geo")
    return out.withColumns({c: empty_to_null(c) for c in _GEO})
