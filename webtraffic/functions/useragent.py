"""User-agent string → browser family, OS family, device family.

The collector used a third-party parser whose rule set is not part of the reference; these
ordered rules cover the common families (first match wins) and evaluate as JVM-side
expressions on every row — no UDF, no shuffle, no join back on the (skewed) agent string.
Each rule is a set of literal substrings (any must occur) plus an optional regex that refines
the match; the substring tests run first, so the regex engine only sees candidate rows.
Unknown agents give ``Other``.
"""

from __future__ import annotations

import os.path

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules (family, literal substrings (any), refining regex or None).
# Rules marked case-insensitive match on the lower-cased agent.
BROWSER_RULES = [
    ("Googlebot", ["googlebot"], None, True),
    ("bingbot", ["bingbot"], None, True),
    ("Edge", ["Edg/", "Edge/", "EdgA/", "EdgiOS/"], None, False),
    ("Opera", ["OPR/", "Opera"], None, False),
    ("Samsung Internet", ["SamsungBrowser/"], None, False),
    ("Chrome Mobile iOS", ["CriOS/"], None, False),
    ("Firefox iOS", ["FxiOS/"], None, False),
    ("Firefox Mobile", ["Firefox/"], r"(?:Mobile|Tablet).*Firefox/", False),
    ("Firefox", ["Firefox/"], None, False),
    ("Chrome Mobile WebView", ["; wv)"], r"; wv\).*Chrome/", False),
    ("Chrome Mobile", ["Chrome/"], r"Chrome/[\d.]+ Mobile", False),
    ("Chrome", ["Chrome/", "Chromium/"], None, False),
    ("Mobile Safari", ["iPhone", "iPad", "iPod"], r"(?:iPhone|iPad|iPod).*Version/[\d.]+.*Safari/", False),
    ("Mobile Safari UI/WKWebView", ["iPhone", "iPad", "iPod"], r"(?:iPhone|iPad|iPod).*AppleWebKit", False),
    ("Safari", ["Safari/"], r"Version/[\d.]+.*Safari/", False),
    ("IE", ["MSIE ", "Trident/"], None, False),
    ("curl", ["curl/"], r"^curl/", False),
    ("Wget", ["Wget/"], r"^Wget/", False),
    ("Python Requests", ["python-requests/"], None, False),
]
OS_RULES = [
    ("Windows Phone", ["Windows Phone"], None, False),
    ("Windows", ["Windows"], None, False),
    ("iOS", ["iPhone", "iPad", "iPod"], None, False),
    ("Mac OS X", ["Mac OS X", "Macintosh"], None, False),
    ("Android", ["Android"], None, False),
    ("Chrome OS", ["CrOS"], None, False),
    ("Ubuntu", ["Ubuntu"], None, False),
    ("Linux", ["Linux"], None, False),
]
SPIDER_LITERALS = ["bot", "crawler", "spider", "slurp"]
SPIDER_RE = r"bot\b|crawler|spider|slurp"
SAMSUNG_MODEL_RE = r"Android [^;)]*; (SM-[A-Za-z0-9]+)"
ANDROID_MODEL_RE = r"Android [\d.]+; ([^;)]+?)(?: Build/[^;)]*)?\)"
OTHER = "Other"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(u: Column, literals) -> Column:
    """Whether any of the literals occurs; what they all begin with is looked for first, once for all of them."""
    cond = None
    for lit in literals:
        t = u.contains(lit)
        cond = t if cond is None else (cond | t)
    start = os.path.commonprefix(literals)
    return u.contains(start) & cond if len(literals) > 1 and len(start) > 1 else cond


def _ruled(u: Column, low: Column, rules) -> Column:
    expr = None
    for fam, literals, regex, ci in rules:
        src = low if ci else u
        cond = _any(src, literals)
        if regex:
            cond = cond & src.rlike(regex)
        expr = F.when(cond, F.lit(fam)) if expr is None else expr.when(cond, F.lit(fam))
    return expr.otherwise(F.lit(OTHER))


def _agent(ua):
    u = F.coalesce(_c(ua), F.lit(""))
    return u, F.lower(u)


def browser_family(ua) -> Column:
    u, low = _agent(ua)
    return _ruled(u, low, BROWSER_RULES)


def os_family(ua) -> Column:
    u, low = _agent(ua)
    return _ruled(u, low, OS_RULES)


def device_family(ua) -> Column:
    u, low = _agent(ua)
    android = u.contains("Android")
    model = F.regexp_extract(u, ANDROID_MODEL_RE, 1)
    samsung = android & u.contains("SM-") & u.rlike(SAMSUNG_MODEL_RE)
    return (F.when(_any(low, SPIDER_LITERALS) & low.rlike(SPIDER_RE), F.lit("Spider"))
            .when(u.contains("iPad"), F.lit("iPad"))
            .when(u.contains("iPhone"), F.lit("iPhone"))
            .when(u.contains("iPod"), F.lit("iPod"))
            .when(samsung, F.concat(F.lit("Samsung "), F.regexp_extract(u, SAMSUNG_MODEL_RE, 1)))
            .when(android & u.contains("Tablet") & u.rlike(r"Android.*Tablet"), F.lit("Generic Tablet"))
            .when(android & u.contains("; Mobile;") & u.rlike(r"Android.*; Mobile;"),
                  F.lit("Generic Smartphone"))
            .when(android & (model != "") & (model != "Mobile"), model)
            .when(u.contains("Mobile"), F.lit("Generic Smartphone"))
            .otherwise(F.lit(OTHER)))


def parse_user_agent(ua) -> Column:
    """A struct ``(browser, os, device)`` of families for one user-agent column."""
    return F.struct(browser_family(ua).alias("browser"), os_family(ua).alias("os"),
                    device_family(ua).alias("device"))
