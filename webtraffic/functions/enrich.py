"""Column-level enrichment (E01-E04, E08, E09): pure built-in expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Referrer source buckets, first match wins (substring tests, ASCII
# case-insensitive like SQLite's LIKE). Twitter/X also matches any domain containing "x.com".
REFERRER_BUCKETS = [
    ("Google", ["google"]),
    ("Bing", ["bing"]),
    ("Yahoo", ["yahoo"]),
    ("Facebook", ["facebook"]),
    ("Twitter/X", ["twitter", "x.com"]),
    ("LinkedIn", ["linkedin"]),
    ("Instagram", ["instagram"]),
]
DIRECT = "Direct"

# Addresses skipped before the geo lookup.
LOCAL_ADDRESSES = ["127.0.0.1", "::1"]
LOCAL_PREFIXES = ["192.168.", "10."]

# Host of an absolute URL: scheme, optional user-info, then a bracketed IPv6 literal or a run
# of host characters that must end at a port, path, query, fragment or the end of the text.
HOST_RE = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@\s]*@)?(\[[0-9a-f:.]+\]|[^/?#:\s\[\]]++)(?![^/?#:])"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A scheme prefix, and the schemes whose URLs must carry a host.
SCHEME_RE = r"^[a-z][a-z0-9+.-]*:"
HOST_REQUIRED_RE = r"^(?:https?|ftp|wss?):"


def referrer_domain(referrer) -> Column:
    """The referrer URL's lower-cased host, as a URL parser reports it.

    Blank or unparsable (no scheme, or a web scheme without a valid host) → NULL; a URL of
    another scheme without an authority (``about:blank``, ``mailto:...``) has an empty host.
    """
    r = F.lower(F.trim(_c(referrer)))
    host = F.regexp_extract(r, HOST_RE, 1)
    return (F.when(host != "", host)
            .when(r.rlike(SCHEME_RE) & ~r.rlike(HOST_REQUIRED_RE) & ~r.contains("//"), F.lit(""))
            .otherwise(F.lit(None)))


def referrer_source(domain) -> Column:
    """The referrer report's bucket for a stored referrer domain."""
    d = _c(domain)
    low = F.lower(d)
    expr = F.when(d.isNull() | (d == ""), F.lit(DIRECT))
    for label, needles in REFERRER_BUCKETS:
        cond = None
        for nd in needles:
            t = low.contains(nd)
            cond = t if cond is None else (cond | t)
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(d)


def device_type(device_family) -> Column:
    """Desktop / mobile / tablet from a device family name.

    Exact ``Spider``/``Other`` → desktop; a family containing mobile or phone → mobile (this
    wins over tablet); containing tablet or ipad → tablet; anything else → desktop.
    """
    fam = _c(device_family)
    low = F.lower(fam)
    return (F.when(fam.isin("Spider", "Other"), F.lit("desktop"))
            .when(low.contains("mobile") | low.contains("phone"), F.lit("mobile"))
            .when(low.contains("tablet") | low.contains("ipad"), F.lit("tablet"))
            .otherwise(F.lit("desktop")))


def is_local_ip(ip) -> Column:
    """Loopback and the two private prefixes the collector skips (not 172.16/12, not
    IPv4-mapped IPv6 forms)."""
    a = _c(ip)
    cond = a.isin(*LOCAL_ADDRESSES)
    for p in LOCAL_PREFIXES:
        cond = cond | a.startswith(p)
    return F.coalesce(cond, F.lit(False))


def empty_to_null(c) -> Column:
    """JavaScript ``s || null`` for a string: the empty string becomes NULL."""
    return F.nullif(_c(c), F.lit(""))


def zero_to_null(c) -> Column:
    """JavaScript ``n || null`` for a number: 0 becomes NULL."""
    return F.nullif(_c(c), F.lit(0))


def client_ip(connection_ip, forwarded_for=None, remote_addr=None) -> Column:
    """First non-empty of the connection address, ``x-forwarded-for``, socket address."""
    parts = [F.nullif(_c(x), F.lit("")) for x in (connection_ip, forwarded_for, remote_addr)
             if x is not None]
    return F.coalesce(*parts)
