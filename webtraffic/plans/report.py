"""Composite reports (Q36, Q37), their JSON document (Q39) and the report sink.

A bundle is a dict of lazy DataFrames; nothing runs until a piece (or the JSON document) is
collected or written. The JSON document folds every piece into one row: each list is gathered
with ``collect_list`` — every list is a bounded top-k or a small closed domain (hours, the
days of one window, device classes), so no unbounded group reaches one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.period import DEFAULT_PERIOD, on_day, pcol, period_filter
from ..operators import audience as A
from ..operators import metrics as M
from ..operators import pages as P
from ..sources.tables import Tables

# The report documents' key names, in the order the service emits them.
BASIC_KEYS = ["totalVisitors", "totalSessions", "totalPageViews", "uniqueToday", "topPages",
              "topCountries", "topBrowsers", "deviceTypes"]
ENHANCED_KEYS = ["totalVisitors", "totalSessions", "totalPageViews", "uniqueToday",
                 "bounceRate", "avgSessionDuration", "avgPagesPerSession", "returnVisitors",
                 "newVisitors", "hourlyTrends", "dailyTrends", "topPages", "entryPages",
                 "exitPages", "referrers", "utmSources", "utmMediums", "topCountries",
                 "topCities", "deviceTypes", "deviceBrands", "deviceModels", "osVersions",
                 "browserVersions", "topBrowsers", "screenResolutions", "languages",
                 "activeSessions", "peakHours"]

SCALAR_KEYS = {
    "total_visitors": "totalVisitors", "total_sessions": "totalSessions",
    "total_page_views": "totalPageViews", "unique_today": "uniqueToday",
    "bounce_rate": "bounceRate", "avg_session_duration": "avgSessionDuration",
    "avg_pages_per_session": "avgPagesPerSession", "return_visitors": "returnVisitors",
    "new_visitors": "newVisitors", "active_sessions": "activeSessions",
}

def basic_totals(sessions: DataFrame, page_views: DataFrame, period=DEFAULT_PERIOD,
                 as_of=None) -> DataFrame:
    """Q01-Q04 of the basic report in one row: one sessions pass (period OR today pushed to
    the scan), grouped per visitor, and one page-view pass; folded without a join."""
    in_p = period_filter("started_at", period, as_of)
    today = on_day("started_at", as_of)
    pc = pcol(sessions)
    scan = period_filter("started_at", period, as_of, pc) | on_day("started_at", as_of, pc)
    per_v = (sessions.where(scan)
             .groupBy("visitor_id")
             .agg(F.count_if(in_p).alias("n"), F.count_if(today).alias("n_today")))
    known = F.col("visitor_id").isNotNull()
    srow = per_v.agg(F.count_if(known & (F.col("n") > 0)).alias("total_visitors"),
                     F.coalesce(F.sum("n"), F.lit(0)).alias("total_sessions"),
                     F.count_if(known & (F.col("n_today") > 0)).alias("unique_today"))
    prow = (page_views.where(period_filter("viewed_at", period, as_of, pcol(page_views)))
            .agg(F.count(F.lit(1)).alias("total_page_views")))
    return _fold([srow, prow], ["total_visitors", "total_sessions", "total_page_views",
                                "unique_today"])


def _fold(rows: list[DataFrame], order: list[str]) -> DataFrame:
    """Combine one-row frames with disjoint columns into one row (union + first non-NULL)."""
    types = {}
    for r in rows:
        types.update(dict(r.dtypes))
    stacked = None
    for r in rows:
        part = r.select(*[(F.col(c) if c in r.columns else F.lit(None).cast(t)).alias(c)
                          for c, t in types.items()])
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in order])


def _resolved(t: Tables, as_of):
    """The report's reference instant: given, or that of the tables; a clock is never read."""
    as_of = as_of or t.as_of
    if as_of is None:
        raise ValueError("a report needs as_of: pass it, or load the tables with it (load_tables(..., as_of=...))")
    return as_of


def basic_stats(t: Tables, period=DEFAULT_PERIOD, as_of=None,
                fuse_audience: bool = True) -> dict[str, DataFrame]:
    """Q36: the basic report as named DataFrames.

    With ``fuse_audience`` the bundle also holds ``_lists``: top countries and top browsers
    from one pass over the detail table, which the JSON document uses.
    """
    as_of = _resolved(t, as_of)
    d = t.visitor_details
    extra = {}
    if fuse_audience:
        extra = {"_lists": A.breakdown_lists(d, A.BASIC_BREAKDOWNS, cities_for=None)}
    return extra | {
        "totals": basic_totals(t.sessions, t.page_views, period, as_of),
        "topPages": P.top_pages(t.page_views, period, as_of),
        "topCountries": A.top_countries_basic(d),
        "topBrowsers": A.top_browsers(d),
        "deviceTypes": A.device_types(d),
    }


def enhanced_stats(t: Tables, period=DEFAULT_PERIOD, start=None, end=None, as_of=None,
                   fuse_audience: bool = True) -> dict[str, DataFrame]:
    """Q37: the enhanced report as named DataFrames (``totals`` is the Q38 KPI row).

    With ``fuse_audience`` the bundle also holds ``_lists`` (every top-k audience breakdown
    from one pass over the detail table, :func:`breakdown_lists`) and ``_acquisition`` (the
    three acquisition lists from one pass over the period's sessions). The JSON document
    takes those lists from them; the separate pieces stay for callers that want one list.
    """
    as_of = _resolved(t, as_of)
    s, pv = t.sessions, t.page_views
    d = t.visitor_details
    kw = dict(period=period, as_of=as_of, start=start, end=end)
    extra = {}
    if fuse_audience:
        extra = {"_lists": A.breakdown_lists(d), "_acquisition": A.acquisition_lists(s, **kw)}
    return extra | {
        "totals": M.kpi_row(s, pv, first_touch=t.first_touch, **kw),
        "hourlyTrends": M.hourly_trends(s, as_of),
        "dailyTrends": M.daily_trends(s, pv, as_of),
        "topPages": P.top_pages_bounce(pv, s, **kw),
        "entryPages": P.entry_pages(pv, **kw),
        "exitPages": P.exit_pages(pv, **kw),
        "referrers": A.referrers(s, **kw),
        "utmSources": A.utm_sources(s, **kw),
        "utmMediums": A.utm_mediums(s, **kw),
        "topCountries": A.top_countries(d),
        "topCities": A.top_cities(d),
        "deviceTypes": A.device_types(d),
        "deviceBrands": A.device_brands(d),
        "deviceModels": A.device_models(d),
        "osVersions": A.os_versions(d),
        "browserVersions": A.browser_versions(d),
        "topBrowsers": A.top_browsers(d),
        "screenResolutions": A.screen_resolutions(d),
        "languages": A.languages(d),
        "peakHours": M.peak_hours(s),
    }


# How each list is ordered inside the document: (column, descending?) pairs.
LIST_ORDER = {
    "hourlyTrends": [("hour", False)],
    "dailyTrends": [("date", False)],
    "deviceTypes": [("visitors", True), ("device_type", False)],
}


def _as_list(name: str, df: DataFrame) -> DataFrame:
    """One row, one column ``name``: the frame's rows as an ordered array of structs."""
    order = LIST_ORDER.get(name)
    if order is None:
        measure = [c for c in df.columns if c in ("views", "entries", "exits", "sessions",
                                                  "visitors")][0]
        keys = [c for c, t in df.dtypes if t == "string"]
        order = [(measure, True)] + [(k, False) for k in keys]
    sort_keys = []
    for i, (c, desc) in enumerate(order):
        k = F.col(c)
        if desc:
            k = -k.cast("double")
        sort_keys.append(k.alias(f"_k{i}"))
    row = F.struct(*sort_keys, F.struct(*df.columns).alias("_v"))
    # Sorting the collected structs orders by the keys first; ``arr._v`` keeps the payloads.
    return df.agg(F.sort_array(F.collect_list(row)).getField("_v").alias(name))


def report_json(bundle: dict[str, DataFrame], keys: list[str] = ENHANCED_KEYS) -> DataFrame:
    """Q39: the whole report as a one-row ``json`` string with the service's key names.

    Every piece enters as a scalar subquery (one row, one value), so the pieces plan
    independently and Spark runs them concurrently; the outer query only assembles the row.
    """
    spark = next(iter(bundle.values())).sparkSession
    inner, outer = [], {}
    # One-row pieces (``totals``: scalars; ``_…``: ready-made ordered lists) enter as one
    # struct each and are unpacked one level up, so each subquery appears in the plan once.
    packed = [n for n in bundle if n == "totals" or n.startswith("_")]
    for name in packed:
        rename = SCALAR_KEYS if name == "totals" else {}
        row = bundle[name]
        inner.append(row.select(F.struct(*row.columns).alias("k")).scalar().alias(name))
        for c in row.columns:
            outer[rename.get(c, c)] = F.col(name).getField(c)
    for name, df in bundle.items():
        if name not in outer and name not in packed and name in keys:
            inner.append(_as_list(name, df).scalar().alias(name))
            outer[name] = F.col(name)
    doc = F.struct(*[outer[k].alias(k) for k in keys if k in outer])
    return spark.range(1).select(*inner).select(_json(doc).alias("json"))


def _json(doc) -> Column:
    """A JSON object that keeps NULL fields as ``null``, as the service's documents do."""
    return F.to_json(doc, {"ignoreNullFields": "false"})


def realtime_json(feed: DataFrame) -> DataFrame:
    """Q39: the realtime document of a feed (at most its limit of rows), in the order of its ``feed_rank``
    (``realtime_feed(..., ranked=True)``); of a feed without one, newest first."""
    place = F.col("feed_rank") if "feed_rank" in feed.columns else -F.unix_micros(F.col("viewed_at").cast("timestamp"))
    shown = [c for c in feed.columns if c != "feed_rank"]
    rows = F.sort_array(F.collect_list(F.struct(place.alias("_k"), F.struct(*shown).alias("_v"))))
    doc = F.struct(F.count(F.lit(1)).alias("count"), rows.getField("_v").alias("visitors"))
    return feed.agg(_json(doc).alias("json"))


def visitors_json_lines(recent: DataFrame) -> DataFrame:
    """Q39: the visitors document as JSON lines, one per visitor in the listing's order.

    The listing has no upper bound, so it is not folded into one row.
    """
    return recent.select(_json(F.struct(*recent.columns)).alias("json"))


def write_report(bundle: dict[str, DataFrame], out_dir: str, keys: list[str] = ENHANCED_KEYS,
                 mode: str = "overwrite") -> None:
    """Each piece as Parquet, and the JSON document of what was written beside them.

    The document reads the written pieces, so the tables behind the report are scanned once.
    """
    stored = {}
    for name, df in bundle.items():
        df.write.mode(mode).parquet(f"{out_dir}/{name.lstrip('_')}")
        stored[name] = df.sparkSession.read.schema(df.schema).parquet(f"{out_dir}/{name.lstrip('_')}")
    report_json(stored, keys).coalesce(1).write.mode(mode).text(f"{out_dir}/report.json")
