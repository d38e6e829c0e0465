"""Catalog entries: scalar metrics, trends and the KPI row (Q01-Q13, Q38)."""

from __future__ import annotations

from ..operators import metrics as M
from .catalog import (RANGE_END, RANGE_START, T, after_sql, oracle, period_sql, range_sql,
                      register, today_sql)

S_NEEDS = ("sessions", "params")
PV_NEEDS = ("page_views", "params")


def _flagged(f: str) -> dict[str, str]:
    """Sessions with their visitor's first start, and whether they are in the period or of today."""
    return {"marked": f"""SELECT *, ({f}) AS inside, ({today_sql('started_at')}) AS of_today,
 min(started_at) OVER (PARTITION BY visitor_id) AS first_start FROM sessions"""}


# One aggregate over ``marked`` for each session scalar.
_SESSION_SCALARS = {
    "total_visitors": "count(DISTINCT visitor_id) FILTER (WHERE inside)",
    "total_sessions": "count(*) FILTER (WHERE inside)",
    "unique_today": "count(DISTINCT visitor_id) FILTER (WHERE of_today)",
    "bounce_rate": "coalesce(count(*) FILTER (WHERE inside AND page_views = 1) * CAST(100.0 AS DOUBLE) "
                   "/ nullif(count(*) FILTER (WHERE inside), 0), 0.0)",
    "avg_session_duration": "coalesce(avg(duration) FILTER (WHERE inside), 0.0)",
    "avg_pages_per_session": "coalesce(avg(page_views) FILTER (WHERE inside), 0.0)",
    "return_visitors": "count(DISTINCT visitor_id) FILTER (WHERE inside AND first_start < started_at)",
    "new_visitors": "count(DISTINCT visitor_id) FILTER (WHERE inside) "
                    "- count(DISTINCT visitor_id) FILTER (WHERE inside AND first_start < started_at)",
}


def _kpi_sql(f: str, fv: str) -> str:
    scalars = ",\n ".join(f"{e} AS {k}" for k, e in _SESSION_SCALARS.items())
    return oracle(f"""
SELECT s.*, v.* FROM (SELECT {scalars} FROM marked) s,
 (SELECT count(*) FILTER (WHERE inside) AS total_page_views,
   count(DISTINCT session_id) FILTER (WHERE live) AS active_sessions FROM views) v""",
                  *S_NEEDS, "page_views", extra=_flagged(f) | {
        "views": f"SELECT session_id, ({fv}) AS inside, ({after_sql('viewed_at', '5 MINUTE')}) AS live FROM page_views"})


def _scalar_sqls(f: str, fv: str) -> dict[str, str]:
    out = {k: oracle(f"SELECT {e} AS {k} FROM marked", *S_NEEDS, extra=_flagged(f))
           for k, e in _SESSION_SCALARS.items() if k != "unique_today"}
    out["total_page_views"] = oracle(
        f"SELECT count(*) AS total_page_views FROM page_views WHERE {fv}", *PV_NEEDS)
    return out


# Period variants: the default (24h), the other named periods, "all", and an absolute range.
VARIANTS = {
    "": dict(period="24h"),
    "_7d": dict(period="7d"),
    "_30d": dict(period="30d"),
    "_all": dict(period="all"),
    "_range": dict(start=RANGE_START, end=RANGE_END),
}


def _filters(kw):
    if "start" in kw:
        return (range_sql("started_at", kw["start"], kw["end"]),
                range_sql("viewed_at", kw["start"], kw["end"]))
    return period_sql("started_at", kw["period"]), period_sql("viewed_at", kw["period"])


def _register_variants():
    for suffix, kw in VARIANTS.items():
        f, fv = _filters(kw)

        def kpi(spark, d, kw=kw):
            t = T(spark, d)
            return M.kpi_row(t.sessions, t.page_views, as_of=t.as_of, **kw)
        register("kpi_row" + suffix, _kpi_sql(f, fv))(kpi)

        sqls = _scalar_sqls(f, fv)
        for name, sql in sqls.items():
            if suffix not in ("", "_all", "_range") and name not in ("total_visitors",
                                                                      "return_visitors"):
                continue
            fn = getattr(M, name)
            table = "page_views" if name == "total_page_views" else "sessions"

            def run(spark, d, fn=fn, table=table, kw=kw):
                t = T(spark, d)
                return fn(getattr(t, table), as_of=t.as_of, **kw)
            register(name + suffix, sql)(run)


_register_variants()


@register("unique_today", oracle(
    f"SELECT count(DISTINCT visitor_id) AS unique_today FROM sessions WHERE {today_sql('started_at')}",
    *S_NEEDS))
def _unique_today(spark, d):
    t = T(spark, d)
    return M.unique_today(t.sessions, t.as_of)


@register("active_sessions", oracle(
    f"SELECT count(DISTINCT session_id) AS active_sessions FROM page_views "
    f"WHERE {after_sql('viewed_at', '5 MINUTE')}", *PV_NEEDS))
def _active_sessions(spark, d):
    t = T(spark, d)
    return M.active_sessions(t.page_views, t.as_of)


@register("hourly_trends", oracle(
    f"SELECT strftime(started_at, '%H') AS hour, count(*) AS sessions, "
    f"count(DISTINCT visitor_id) AS visitors FROM sessions "
    f"WHERE {after_sql('started_at', '24 HOUR')} GROUP BY hour ORDER BY hour", *S_NEEDS))
def _hourly(spark, d):
    t = T(spark, d)
    return M.hourly_trends(t.sessions, t.as_of)


@register("daily_trends", oracle("""
SELECT day AS date, sessions, visitors, coalesce(n, 0) AS page_views_count
FROM starts LEFT JOIN views USING (day) ORDER BY day""", *S_NEEDS, "page_views", extra={
    "starts": f"""SELECT CAST(started_at AS DATE) AS day, count(*) AS sessions, count(DISTINCT visitor_id) AS visitors
FROM sessions WHERE {after_sql('started_at', '30 DAY')} GROUP BY day""",
    "views": "SELECT CAST(viewed_at AS DATE) AS day, count(*) AS n FROM page_views GROUP BY day"}))
def _daily(spark, d):
    t = T(spark, d)
    return M.daily_trends(t.sessions, t.page_views, t.as_of)


@register("peak_hours", oracle(
    "SELECT strftime(started_at, '%H') AS hour, count(*) AS sessions FROM sessions "
    "GROUP BY hour ORDER BY sessions DESC, hour ASC NULLS FIRST LIMIT 5", "sessions"))
def _peak(spark, d):
    return M.peak_hours(T(spark, d).sessions)
