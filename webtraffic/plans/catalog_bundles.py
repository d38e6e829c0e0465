"""Catalog entries: the composite reports (Q36, Q37 via Q39), their JSON documents and the basic totals row.

A document's statement builds the same text from the statements of its pieces: DuckDB writes a struct as Spark writes one.
"""

from __future__ import annotations

from ..operators import people as PE
from . import report as R
from .catalog import CATALOG, RANGE_END, RANGE_START, T, oracle, period_sql, range_sql, register, today_sql


@register("basic_totals", oracle(f"""
SELECT (SELECT count(DISTINCT visitor_id) FROM sessions WHERE {period_sql('started_at', '24h')})
   AS total_visitors,
 (SELECT count(*) FROM sessions WHERE {period_sql('started_at', '24h')}) AS total_sessions,
 (SELECT count(*) FROM page_views WHERE {period_sql('viewed_at', '24h')}) AS total_page_views,
 (SELECT count(DISTINCT visitor_id) FROM sessions WHERE {today_sql('started_at')}) AS unique_today""",
                                  "sessions", "page_views", "params"))
def _basic_totals(spark, d):
    t = T(spark, d)
    return R.basic_totals(t.sessions, t.page_views, "24h", t.as_of)


# Document key -> (piece, its columns in order, the order of its rows).
_KEYS = lambda *names: ", ".join(f"{n} ASC NULLS FIRST" for n in names)


def _top(piece: str, measure: str, keys: list[str], more: tuple[str, ...] = ()):
    return piece, [*keys, *([measure] if measure not in more else []), *more], f"{measure} DESC, {_KEYS(*keys)}"


_LISTS = {
    "hourlyTrends": ("hourly_trends", ["hour", "sessions", "visitors"], "hour"),
    "dailyTrends": ("daily_trends", ["date", "sessions", "visitors", "page_views_count"], "date"),
    "topPages": _top("top_pages_bounce", "views", ["page_path"], ("views", "sessions", "bounce_rate")),
    "entryPages": _top("entry_pages", "entries", ["page_path"]),
    "exitPages": _top("exit_pages", "exits", ["page_path"]),
    "referrers": _top("referrers", "sessions", ["source"], ("sessions", "visitors")),
    "utmSources": _top("utm_sources", "sessions", ["source"]),
    "utmMediums": _top("utm_mediums", "sessions", ["medium"]),
    "topCountries": _top("top_countries", "visitors", ["country", "country_code"], ("visitors", "cities")),
    "topCities": _top("top_cities", "visitors", ["city", "country"]),
    "deviceTypes": _top("device_types", "visitors", ["device_type"]),
    "deviceBrands": _top("device_brands", "visitors", ["device_brand"]),
    "deviceModels": _top("device_models", "visitors", ["device_brand", "device_model"]),
    "osVersions": _top("os_versions", "visitors", ["os", "os_version"]),
    "browserVersions": _top("browser_versions", "visitors", ["browser", "browser_version"]),
    "topBrowsers": _top("top_browsers", "visitors", ["browser"]),
    "screenResolutions": _top("screen_resolutions", "visitors", ["resolution"]),
    "languages": _top("languages", "visitors", ["language"]),
    "peakHours": _top("peak_hours", "sessions", ["hour"]),
}
_BASIC_LISTS = _LISTS | {
    "topPages": _top("top_pages", "views", ["page_path"]),
    "topCountries": _top("top_countries_basic", "visitors", ["country"]),
}


def _struct_sql(columns) -> str:
    return "{" + ", ".join(f"'{c}': {c}" for c in columns) + "}"


def _document_sql(keys: list[str], totals: str, lists: dict) -> str:
    scalars = {v: k for k, v in R.SCALAR_KEYS.items()}
    fields = []
    for key in keys:
        if key in scalars:
            fields.append(f"'{key}': t.{scalars[key]}")
            continue
        piece, columns, order = lists[key]
        fields.append(f"'{key}': coalesce((SELECT list({_struct_sql(columns)} ORDER BY {order}) FROM ({CATALOG[piece].sql}) p), [])")
    return f"SELECT CAST(to_json({{{', '.join(fields)}}}) AS VARCHAR) AS json FROM ({CATALOG[totals].sql}) t"


@register("basic_report_json", _document_sql(R.BASIC_KEYS, "basic_totals", _BASIC_LISTS))
def _basic_json(spark, d):
    t = T(spark, d)
    return R.report_json(R.basic_stats(t, "24h"), R.BASIC_KEYS)


@register("enhanced_report_json", _document_sql(R.ENHANCED_KEYS, "kpi_row", _LISTS))
def _enhanced_json(spark, d):
    return R.report_json(R.enhanced_stats(T(spark, d), "24h"))


def _ranged(sql: str) -> str:
    """A document's statement over the absolute range in place of the last day."""
    for col in ("started_at", "viewed_at"):
        sql = sql.replace(period_sql(col, "24h"), range_sql(col, RANGE_START, RANGE_END))
    return sql


@register("enhanced_report_json_range", _ranged(_document_sql(R.ENHANCED_KEYS, "kpi_row_range", _LISTS)))
def _enhanced_json_range(spark, d):
    return R.report_json(R.enhanced_stats(T(spark, d), start=RANGE_START, end=RANGE_END))


@register("enhanced_report_json_all", _document_sql(R.ENHANCED_KEYS, "kpi_row_all", _LISTS | {
    k: (f"{piece}_all", *rest) for k, (piece, *rest) in _LISTS.items() if f"{piece}_all" in CATALOG}))
def _enhanced_json_all(spark, d):
    return R.report_json(R.enhanced_stats(T(spark, d), "all"))


_STAMP = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g') AS {0}"


@register("realtime_json", f"""
SELECT CAST(to_json({{'count': count(*), 'visitors': coalesce(list({_struct_sql(PE.FEED_COLUMNS)} ORDER BY place), [])}}) AS VARCHAR) AS json
FROM (SELECT * REPLACE ({_STAMP.format('viewed_at')}), row_number() OVER () AS place FROM ({CATALOG['realtime_feed'].sql}) f)""")
def _realtime_json(spark, d):
    t = T(spark, d)
    return R.realtime_json(PE.realtime_feed(t.page_views, t.visitors, t.visitor_details, t.as_of, ranked=True))


_VISITOR_KEYS = ["visitor_id", "ip_address", "last_seen", *PE.RECENT_DETAIL_COLUMNS, "session_count", "total_page_views"]


@register("visitors_json", f"""
SELECT CAST(to_json({_struct_sql(_VISITOR_KEYS)}) AS VARCHAR) AS json
FROM (SELECT * REPLACE ({_STAMP.format('last_seen')}) FROM ({CATALOG['recent_visitors'].sql}) v)""")
def _visitors_json(spark, d):
    t = T(spark, d)
    return R.visitors_json_lines(PE.recent_visitors(t.visitors, t.visitor_details, t.sessions))
