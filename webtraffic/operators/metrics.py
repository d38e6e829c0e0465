"""Scalar metrics and trends (Q01-Q13) and the fused KPI row (Q38).

Each scalar is a one-row DataFrame with a named column. ``period``/``start``/``end`` follow
the enhanced report's rule (:func:`time_filter`); ``as_of`` stands for SQLite's ``'now'``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.period import (DAILY_WINDOW, DEFAULT_PERIOD, HOURLY_WINDOW, LIVE_WINDOW, after,
                                before_period, day_start, on_day, pcol, time_filter, ts_lit)

HUNDRED = 100.0  # a double: the SQL literal 100.0 would be a decimal in Spark


def _sessions_in(sessions: DataFrame, period, start, end, as_of) -> DataFrame:
    return sessions.where(time_filter("started_at", period, start, end, as_of, pcol(sessions)))


def _views_in(page_views: DataFrame, period, start, end, as_of) -> DataFrame:
    return page_views.where(time_filter("viewed_at", period, start, end, as_of, pcol(page_views)))


def total_visitors(sessions, period=DEFAULT_PERIOD, as_of=None, start=None, end=None) -> DataFrame:
    """Q01: distinct visitors with a session in the period."""
    return _sessions_in(sessions, period, start, end, as_of).agg(
        F.count_distinct("visitor_id").alias("total_visitors"))


def total_sessions(sessions, period=DEFAULT_PERIOD, as_of=None, start=None, end=None) -> DataFrame:
    """Q02: sessions started in the period."""
    return _sessions_in(sessions, period, start, end, as_of).agg(
        F.count(F.lit(1)).alias("total_sessions"))


def total_page_views(page_views, period=DEFAULT_PERIOD, as_of=None, start=None,
                     end=None) -> DataFrame:
    """Q03: page views in the period (by ``viewed_at``)."""
    return _views_in(page_views, period, start, end, as_of).agg(
        F.count(F.lit(1)).alias("total_page_views"))


def unique_today(sessions, as_of) -> DataFrame:
    """Q04: distinct visitors with a session started on ``as_of``'s calendar day."""
    return sessions.where(on_day("started_at", as_of, pcol(sessions))).agg(
        F.count_distinct("visitor_id").alias("unique_today"))


def _rate(num, den):
    return F.coalesce(F.try_divide(num * F.lit(HUNDRED), den), F.lit(0.0))


def _mean(total, n):
    return F.coalesce(F.try_divide(total.cast("double"), n), F.lit(0.0))


def bounce_rate(sessions, period=DEFAULT_PERIOD, as_of=None, start=None, end=None) -> DataFrame:
    """Q05: percent of sessions with ``page_views = 1``; 0 when there are none."""
    return _sessions_in(sessions, period, start, end, as_of).agg(
        _rate(F.count_if(F.col("page_views") == 1), F.count(F.lit(1))).alias("bounce_rate"))


def avg_session_duration(sessions, period=DEFAULT_PERIOD, as_of=None, start=None,
                         end=None) -> DataFrame:
    """Q06: mean of the non-NULL durations; 0 when there are none."""
    return _sessions_in(sessions, period, start, end, as_of).agg(
        _mean(F.sum("duration"), F.count("duration")).alias("avg_session_duration"))


def avg_pages_per_session(sessions, period=DEFAULT_PERIOD, as_of=None, start=None,
                          end=None) -> DataFrame:
    """Q07: mean ``page_views`` per session; 0 when there are none."""
    return _sessions_in(sessions, period, start, end, as_of).agg(
        _mean(F.sum("page_views"), F.count("page_views")).alias("avg_pages_per_session"))


def _with_earlier(per_v: DataFrame, sessions: DataFrame, period, start, end, as_of, first_touch=None) -> DataFrame:
    """Add ``_earlier`` to a per-visitor in-period aggregate (with ``n`` = in-period sessions):
    does the visitor have a session before the period's lower bound?

    Only the period's sessions are aggregated per visitor; older history is read for one column,
    reduced to its semi-join with the period's session scan and then to one row per visitor. No
    job runs while the plan is built: Spark broadcasts the period's side if its size allows, as
    measured at run time, and otherwise can prune history by a runtime bloom filter of it.

    With ``first_touch`` (:mod:`first_touch`) the history is that view's rows of before the period, and
    no older session is read.
    """
    if first_touch is None:
        before = before_period("started_at", period, start, end, as_of, pcol(sessions))
    else:
        before = before_period("first_started", period, start, end, as_of)
    if before is None:
        return per_v.withColumn("_earlier", F.lit(False))
    known = F.col("visitor_id").isNotNull()
    hist = (sessions if first_touch is None else first_touch).where(before & known).select("visitor_id")
    in_p = sessions.where(time_filter("started_at", period, start, end, as_of, pcol(sessions)) & known)
    seen = hist.join(in_p.select("visitor_id"), "visitor_id", "left_semi").distinct()
    return (per_v.join(seen.withColumn("_earlier", F.lit(True)), "visitor_id", "left")
            .withColumn("_earlier", F.coalesce(F.col("_earlier"), F.lit(False))))


def _returning(c=F.col) -> Column:
    """A visitor returns iff an in-period session has any earlier session: two distinct
    in-period start times, or a session before the period (EXISTS ... s2 < s1)."""
    return (c("last_in") > c("first_in")) | c("_earlier")


def _per_visitor(sessions: DataFrame, period, start, end, as_of, first_touch=None) -> DataFrame:
    """One row per visitor with an in-period session: count, first and last in-period start,
    and whether an earlier session exists. Partially aggregated before its shuffle, so a
    visitor with millions of sessions costs one row per map task."""
    per_v = (_sessions_in(sessions, period, start, end, as_of)
             .where(F.col("visitor_id").isNotNull())
             .groupBy("visitor_id")
             .agg(F.count(F.lit(1)).alias("n"),
                  F.min("started_at").alias("first_in"),
                  F.max("started_at").alias("last_in")))
    return _with_earlier(per_v, sessions, period, start, end, as_of, first_touch)


def return_visitors(sessions, period=DEFAULT_PERIOD, as_of=None, start=None, end=None, first_touch=None) -> DataFrame:
    """Q08: visitors with an in-period session that has any earlier session (in or out of
    the period)."""
    return _per_visitor(sessions, period, start, end, as_of, first_touch).agg(
        F.count_if(_returning()).alias("return_visitors"))


def new_visitors(sessions, period=DEFAULT_PERIOD, as_of=None, start=None, end=None, first_touch=None) -> DataFrame:
    """Q09: total visitors minus returning visitors, from the same per-visitor pass."""
    return _per_visitor(sessions, period, start, end, as_of, first_touch).agg(
        (F.count(F.lit(1)) - F.count_if(_returning())).alias("new_visitors"))


def active_sessions(page_views, as_of) -> DataFrame:
    """Q10: distinct sessions with a page view in the last five minutes."""
    return page_views.where(after("viewed_at", as_of, LIVE_WINDOW, pcol(page_views))).agg(
        F.count_distinct("session_id").alias("active_sessions"))


def hourly_trends(sessions, as_of) -> DataFrame:
    """Q11: sessions and visitors per hour label over the last 24 hours, by label."""
    return (sessions.where(after("started_at", as_of, HOURLY_WINDOW, pcol(sessions)))
            .groupBy(F.date_format("started_at", "HH").alias("hour"))
            .agg(F.count(F.lit(1)).alias("sessions"),
                 F.count_distinct("visitor_id").alias("visitors"))
            .orderBy("hour"))


def daily_trends(sessions, page_views, as_of) -> DataFrame:
    """Q12: per date of the last 30 days: sessions, visitors, and all page views of that date.

    The correlated count becomes a pre-aggregate joined on date. Only dates a session can have
    (from the window's first midnight on) are counted, so the page-view scan is pruned too; a
    date with no page views gets 0.
    """
    s = (sessions.where(after("started_at", as_of, DAILY_WINDOW, pcol(sessions)))
         .groupBy(F.to_date("started_at").alias("date"))
         .agg(F.count(F.lit(1)).alias("sessions"),
              F.count_distinct("visitor_id").alias("visitors")))
    first_day = day_start(as_of, DAILY_WINDOW)
    pv_pred = F.col("viewed_at") >= ts_lit(first_day)
    if pcol(page_views):
        pv_pred = pv_pred & (F.col("dt") >= F.lit(first_day.date()))
    pv = (page_views.where(pv_pred)
          .groupBy(F.to_date("viewed_at").alias("date"))
          .agg(F.count(F.lit(1)).alias("page_views_count")))
    return (s.join(pv, "date", "left")
            .select("date", "sessions", "visitors",
                    F.coalesce("page_views_count", F.lit(0)).cast("long").alias("page_views_count"))
            .orderBy("date"))


def peak_hours(sessions, n: int = 5) -> DataFrame:
    """Q13: the busiest hour labels of all time (ties by label; NULL start is its own label)."""
    return (sessions.groupBy(F.date_format("started_at", "HH").alias("hour"))
            .agg(F.count(F.lit(1)).alias("sessions"))
            .orderBy(F.desc("sessions"), F.asc_nulls_first("hour"))
            .limit(n))


KPI_COLUMNS = ("total_visitors", "total_sessions", "total_page_views", "unique_today",
               "bounce_rate", "avg_session_duration", "avg_pages_per_session",
               "return_visitors", "new_visitors", "active_sessions")


def kpi_row(sessions, page_views, period=DEFAULT_PERIOD, as_of=None, start=None,
            end=None, first_touch=None) -> DataFrame:
    """Q38: the enhanced report's ten scalars in one row.

    Four scans: the period's sessions twice (measures, and the semi-join of history), older
    sessions for one column (the first touches instead, where given), and the period's page views.

    Sessions: one pass over the period's (and today's) sessions, grouped by visitor with
    partial aggregation map-side, carries every session scalar; the returning-visitor test
    adds a one-column check for earlier sessions (:func:`_with_earlier`) instead of
    aggregating all history. A global aggregate sums the per-visitor rows.
    Page views: one filtered pass (period OR last five minutes, pushed to the scan).
    The two one-row results are stacked and folded, so no join is needed.
    """
    in_p = time_filter("started_at", period, start, end, as_of)
    today = on_day("started_at", as_of)
    c = F.col
    ps = pcol(sessions)
    scan = sessions.where(time_filter("started_at", period, start, end, as_of, ps)
                          | on_day("started_at", as_of, ps))
    per_v = scan.groupBy("visitor_id").agg(
        F.count_if(in_p).alias("n"),
        F.count_if(in_p & (c("page_views") == 1)).alias("n_bounce"),
        F.sum(F.when(in_p, c("duration"))).alias("dur_sum"),
        F.count(F.when(in_p, c("duration"))).alias("dur_n"),
        F.sum(F.when(in_p, c("page_views"))).alias("pv_sum"),
        F.count(F.when(in_p, c("page_views"))).alias("pv_n"),
        F.min(F.when(in_p, c("started_at"))).alias("first_in"),
        F.max(F.when(in_p, c("started_at"))).alias("last_in"),
        F.count_if(today).alias("n_today"))
    per_v = _with_earlier(per_v, sessions, period, start, end, as_of, first_touch)
    known = c("visitor_id").isNotNull()
    returning = F.count_if(known & (c("n") > 0) & _returning())
    visitors = F.count_if(known & (c("n") > 0))
    srow = per_v.agg(
        visitors.alias("total_visitors"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_sessions"),
        F.count_if(known & (c("n_today") > 0)).alias("unique_today"),
        _rate(F.sum("n_bounce"), F.sum("n")).alias("bounce_rate"),
        _mean(F.sum("dur_sum"), F.sum("dur_n")).alias("avg_session_duration"),
        _mean(F.sum("pv_sum"), F.sum("pv_n")).alias("avg_pages_per_session"),
        returning.alias("return_visitors"),
        (visitors - returning).alias("new_visitors"))

    v_in = time_filter("viewed_at", period, start, end, as_of)
    live = after("viewed_at", as_of, LIVE_WINDOW)
    pc = pcol(page_views)
    # Scan only what either measure needs; with a dt partition the OR also prunes dates.
    pv_scan = page_views.where(time_filter("viewed_at", period, start, end, as_of, pc)
                               | after("viewed_at", as_of, LIVE_WINDOW, pc))
    prow = pv_scan.agg(F.count_if(v_in).alias("total_page_views"),
                       F.count_distinct(F.when(live, c("session_id"))).alias("active_sessions"))

    s_cols = srow.columns
    p_cols = prow.columns
    stacked = (srow.select(*s_cols, *[F.lit(None).cast("long").alias(x) for x in p_cols])
               .unionByName(prow.select(*[F.lit(None).cast(t).alias(n) for n, t in srow.dtypes],
                                        *p_cols)))
    return stacked.agg(*[F.max(x).alias(x) for x in KPI_COLUMNS])
