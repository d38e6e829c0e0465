"""Catalog entries: page, acquisition, audience and visitor reports."""

from __future__ import annotations

from ..operators import audience as A
from ..operators import pages as P
from ..operators import people as PE
from .catalog import T, after_sql, oracle, period_sql, register, source_sql

# --- pages ------------------------------------------------------------------------------------


def _top_pages_sql(period):
    return oracle(f"""
SELECT page_path, count(*) AS views FROM page_views WHERE {period_sql('viewed_at', period)}
GROUP BY page_path ORDER BY views DESC, page_path ASC NULLS FIRST LIMIT 10""", "page_views", "params")


def _bounce_sql(period):
    return oracle("""
SELECT page_path, CAST(sum(n) AS BIGINT) AS views, count(DISTINCT session_id) AS sessions,
 coalesce(sum(n) FILTER (WHERE single), 0) * CAST(100.0 AS DOUBLE) / count(DISTINCT session_id) AS bounce_rate
FROM seen GROUP BY page_path ORDER BY views DESC, page_path ASC NULLS FIRST LIMIT 20""",
                  "page_views", "sessions", "params", extra={
        "visits": f"""SELECT session_id, page_path, count(*) AS n FROM page_views
WHERE {period_sql('viewed_at', period)} GROUP BY ALL""",
        "seen": """SELECT visits.*, coalesce(sessions.page_views = 1, FALSE) AS single
FROM sessions JOIN visits USING (session_id)"""})


def _boundary_sql(period, order, out):
    return oracle(f"""
SELECT page_path, count(*) AS {out} FROM edges
GROUP BY page_path ORDER BY {out} DESC, page_path ASC NULLS FIRST LIMIT 10""",
                  "page_views", "params", extra={"edges": f"""
SELECT page_path FROM page_views
WHERE {period_sql('viewed_at', period)} AND session_id IS NOT NULL AND viewed_at IS NOT NULL
QUALIFY rank() OVER (PARTITION BY session_id ORDER BY viewed_at {order}) = 1"""})


for _sfx, _period in (("", "24h"), ("_7d", "7d"), ("_all", "all")):
    register("top_pages" + _sfx, _top_pages_sql(_period))(
        lambda spark, d, p=_period: P.top_pages(T(spark, d).page_views, p, T(spark, d).as_of))
    register("top_pages_bounce" + _sfx, _bounce_sql(_period))(
        lambda spark, d, p=_period: P.top_pages_bounce(
            T(spark, d).page_views, T(spark, d).sessions, p, T(spark, d).as_of))
    register("entry_pages" + _sfx, _boundary_sql(_period, "ASC", "entries"))(
        lambda spark, d, p=_period: P.entry_pages(T(spark, d).page_views, p, T(spark, d).as_of))
    register("exit_pages" + _sfx, _boundary_sql(_period, "DESC", "exits"))(
        lambda spark, d, p=_period: P.exit_pages(T(spark, d).page_views, p, T(spark, d).as_of))

# --- acquisition ------------------------------------------------------------------------------



for _sfx, _period in (("", "24h"), ("_30d", "30d"), ("_all", "all")):
    register("referrers" + _sfx, oracle(f"""
SELECT {source_sql('referrer_domain')} AS source, count(*) AS sessions, count(DISTINCT visitor_id) AS visitors
FROM sessions WHERE {period_sql('started_at', _period)}
GROUP BY source ORDER BY sessions DESC, source ASC NULLS FIRST LIMIT 15""", "sessions", "params"))(
        lambda spark, d, p=_period: A.referrers(T(spark, d).sessions, p, T(spark, d).as_of))
    for _name, _col, _out in (("utm_sources", "utm_source", "source"),
                              ("utm_mediums", "utm_medium", "medium")):
        register(_name + _sfx, oracle(f"""
SELECT COALESCE({_col}, 'none') AS {_out}, count(*) AS sessions
FROM sessions WHERE {period_sql('started_at', _period)}
GROUP BY {_out} ORDER BY sessions DESC, {_out} ASC NULLS FIRST LIMIT 10""", "sessions", "params"))(
            lambda spark, d, p=_period, fn=getattr(A, _name): fn(T(spark, d).sessions, p,
                                                                  T(spark, d).as_of))

def _acquisition_rows_sql(period: str) -> str:
    """The three acquisition lists, each ranked on its own, stacked as (list, rank, key, ...)."""
    where = period_sql("started_at", period)
    parts = []
    for name, key_sql, n, visitors in (
            ("referrers", source_sql("referrer_domain"), 15, "count(DISTINCT visitor_id)"),
            ("utmSources", "COALESCE(utm_source, 'none')", 10, "CAST(NULL AS BIGINT)"),
            ("utmMediums", "COALESCE(utm_medium, 'none')", 10, "CAST(NULL AS BIGINT)")):
        parts.append(f"""SELECT * FROM (
 SELECT '{name}' AS list, row_number() OVER (ORDER BY count(*) DESC, k ASC NULLS FIRST) AS rank,
  k AS key, count(*) AS sessions, {visitors} AS visitors
 FROM (SELECT {key_sql} AS k, visitor_id FROM sessions WHERE {where}) GROUP BY k) WHERE rank <= {n}""")
    return oracle("\nUNION ALL\n".join(parts), "sessions", "params")


for _sfx, _period in (("", "24h"), ("_all", "all")):
    register("enhanced_acquisition_lists" + _sfx, _acquisition_rows_sql(_period))(
        lambda spark, d, p=_period: A.acquisition_list_rows(T(spark, d).sessions, p,
                                                            T(spark, d).as_of))

# --- audience breakdowns ----------------------------------------------------------------------


def _breakdown_sql(keys: dict, not_null: list, n, extra: dict | None = None) -> str:
    sel = ", ".join(f"{expr} AS {k}" for k, expr in keys.items())
    aggs = ", ".join(["count(DISTINCT visitor_id) AS visitors"]
                     + [f"{e} AS {k}" for k, e in (extra or {}).items()])
    where = " AND ".join(f"{c} IS NOT NULL" for c in not_null)
    group = ", ".join(keys)
    tail = ""
    if n is not None:
        order = ", ".join(["visitors DESC"] + [f"{k} ASC NULLS FIRST" for k in keys])
        tail = f" ORDER BY {order} LIMIT {n}"
    return oracle(f"SELECT {sel}, {aggs} FROM visitor_details WHERE {where} GROUP BY {group}{tail}",
                  "visitor_details")


def _k(*names):
    return {n: n for n in names}


BREAKDOWNS = {
    "top_countries_basic": (A.top_countries_basic, _k("country"), ["country"], 10, None),
    "top_countries": (A.top_countries, _k("country", "country_code"), ["country"], 20,
                      {"cities": "count(DISTINCT city)"}),
    "top_cities": (A.top_cities, _k("city", "country"), ["city"], 20, None),
    "top_browsers": (A.top_browsers, _k("browser"), ["browser"], 10, None),
    "browser_versions": (A.browser_versions, _k("browser", "browser_version"),
                         ["browser", "browser_version"], 15, None),
    "device_types": (A.device_types, _k("device_type"), ["device_type"], None, None),
    "device_brands": (A.device_brands, _k("device_brand"), ["device_brand"], 10, None),
    "device_models": (A.device_models, _k("device_brand", "device_model"), ["device_model"], 15,
                      None),
    "os_versions": (A.os_versions, _k("os", "os_version"), ["os", "os_version"], 15, None),
    "screen_resolutions": (
        A.screen_resolutions,
        {"resolution": "CAST(screen_width AS VARCHAR) || 'x' || CAST(screen_height AS VARCHAR)"},
        ["screen_width", "screen_height"], 15, None),
    "languages": (A.languages, _k("language"), ["language"], 15, None),
}

for _name, (_fn, _keys, _nn, _n, _extra) in BREAKDOWNS.items():
    register(_name, _breakdown_sql(_keys, _nn, _n, _extra))(
        lambda spark, d, fn=_fn: fn(T(spark, d).visitor_details))

def _list_rows_sql() -> str:
    """Each enhanced-report breakdown ranked on its own, stacked as (list, rank, keys...)."""
    parts = []
    for name, (keys, not_null, n) in A.ENHANCED_BREAKDOWNS.items():
        if keys == ["screen_width", "screen_height"]:
            shown = ["CAST(screen_width AS VARCHAR) || 'x' || CAST(screen_height AS VARCHAR)"]
        else:
            shown = list(keys)
        k2 = shown[1] if len(shown) > 1 else "CAST(NULL AS VARCHAR)"
        cities = "count(DISTINCT city)" if name == "topCountries" else "CAST(NULL AS BIGINT)"
        order = ", ".join(["count(DISTINCT visitor_id) DESC"]
                          + [f"{k} ASC NULLS FIRST" for k in shown])
        where = " AND ".join(f"{c} IS NOT NULL" for c in not_null)
        parts.append(f"""SELECT * FROM (
 SELECT '{name}' AS list, row_number() OVER (ORDER BY {order}) AS rank,
  {shown[0]} AS key1, {k2} AS key2, count(DISTINCT visitor_id) AS visitors, {cities} AS cities
 FROM visitor_details WHERE {where} GROUP BY {", ".join(keys)}) WHERE rank <= {n}""")
    return oracle("\nUNION ALL\n".join(parts), "visitor_details")


@register("enhanced_audience_lists", _list_rows_sql())
def _audience_lists(spark, d):
    return A.breakdown_list_rows(T(spark, d).visitor_details)


# --- visitor-level reports --------------------------------------------------------------------

_LIVE_SQL = f"""SELECT id, visitor_id, page_path, viewed_at FROM page_views
WHERE {after_sql('viewed_at', '5 MINUTE')} AND visitor_id IN (SELECT visitor_id FROM visitors)"""
_FEED_SQL = """
SELECT live.visitor_id, d.country, d.city, d.browser, d.device_type, live.page_path, live.viewed_at
FROM live LEFT JOIN visitor_details d USING (visitor_id)
ORDER BY live.viewed_at DESC, live.id, d.id ASC NULLS FIRST
LIMIT 50"""
_FEED_CTES = {"live": _LIVE_SQL}
_FEED_NEEDS = ("page_views", "visitors", "visitor_details", "params")


@register("realtime_feed", oracle(_FEED_SQL, *_FEED_NEEDS, extra=_FEED_CTES))
def _feed(spark, d):
    t = T(spark, d)
    return PE.realtime_feed(t.page_views, t.visitors, t.visitor_details, t.as_of)


@register("realtime_count", oracle(f"SELECT count(*) AS count FROM ({_FEED_SQL}) f", *_FEED_NEEDS, extra=_FEED_CTES))
def _feed_count(spark, d):
    return PE.realtime_count(_feed(spark, d))


_LATEST_SQL = """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY visitor_id ORDER BY updated_at DESC NULLS LAST,
                                                               id DESC NULLS LAST) AS rn
  FROM visitor_details) WHERE rn = 1"""


@register("realtime_feed_latest", oracle("""
SELECT live.visitor_id, d.country, d.city, d.browser, d.device_type, live.page_path, live.viewed_at
FROM live LEFT JOIN latest d USING (visitor_id)
ORDER BY live.viewed_at DESC, live.id LIMIT 50""", *_FEED_NEEDS, extra={"latest": _LATEST_SQL, **_FEED_CTES}))
def _feed_latest(spark, d):
    t = T(spark, d)
    return PE.realtime_feed(t.page_views, t.visitors, t.visitor_details, t.as_of, latest=True)


@register("latest_details", oracle(
    "SELECT visitor_id, country, city, browser, device_type, os FROM latest",
    "visitor_details", extra={"latest": _LATEST_SQL}))
def _latest(spark, d):
    return PE.latest_details(T(spark, d).visitor_details,
                             ["country", "city", "browser", "device_type", "os"])


def _recent_sql(limit: int | None, dedupe: bool = False) -> str:
    times = "1" if dedupe else "greatest(coalesce(details, 0), 1)"
    body = f"""
SELECT v.visitor_id, v.ip_address, v.last_seen, l.country, l.city, l.browser, l.device_type, l.os,
 coalesce(starts, 0) AS session_count, CAST(viewed * {times} AS BIGINT) AS total_page_views
FROM visitors v LEFT JOIN of_sessions USING (visitor_id) LEFT JOIN of_details USING (visitor_id)
 LEFT JOIN latest l USING (visitor_id)
ORDER BY v.last_seen DESC NULLS LAST, v.visitor_id ASC"""
    if limit is not None:
        body += f" LIMIT {limit}"
    return oracle(body, "visitors", "visitor_details", "sessions", extra={
        "latest": _LATEST_SQL,
        "of_sessions": "SELECT visitor_id, count(DISTINCT id) AS starts, sum(page_views) AS viewed FROM sessions GROUP BY visitor_id",
        "of_details": "SELECT visitor_id, count(*) AS details FROM visitor_details GROUP BY visitor_id"})


for _sfx, _limit, _n, _dd in (("", None, 50, False), ("_all", "-1", None, False),
                               ("_12abc", "12abc", 12, False), ("_dedupe", None, 50, True)):
    register("recent_visitors" + _sfx, _recent_sql(_n, _dd))(
        lambda spark, d, lim=_limit, dd=_dd: PE.recent_visitors(
            T(spark, d).visitors, T(spark, d).visitor_details, T(spark, d).sessions,
            limit=lim, dedupe=dd))
