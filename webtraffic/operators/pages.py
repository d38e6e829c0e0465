"""Page reports (Q14-Q17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.period import DEFAULT_PERIOD, pcol, period_filter, time_filter
from .topk import top_k


def top_pages(page_views: DataFrame, period=DEFAULT_PERIOD, as_of=None, n: int = 10) -> DataFrame:
    """Q14 (basic report): views per path in the period, top ``n``."""
    pv = page_views.where(period_filter("viewed_at", period, as_of, pcol(page_views)))
    return top_k(pv.groupBy("page_path").agg(F.count(F.lit(1)).alias("views")),
                 "views", ["page_path"], n)


def top_pages_bounce(page_views: DataFrame, sessions: DataFrame, period=DEFAULT_PERIOD,
                     as_of=None, start=None, end=None, n: int = 20) -> DataFrame:
    """Q15: views, distinct sessions and bounce rate per path; inner join to sessions.

    ``bounce_rate = 100 * (joined rows whose session has page_views = 1) / distinct sessions``
    — the numerator counts rows, as the reference does, so it can exceed 100.

    The page-view side stays a filtered scan (not pre-aggregated) so that Spark can build a
    runtime bloom filter from it and prune the all-history sessions scan before the shuffle;
    a hot session on that side is split by AQE's skew join, and the distinct count is
    partially aggregated on (path, session).
    """
    pv = (page_views.where(time_filter("viewed_at", period, start, end, as_of, pcol(page_views)))
          .select("page_path", "session_id"))
    s = sessions.select("session_id", F.col("page_views").alias("s_page_views"))
    j = pv.join(s, "session_id")
    sess = F.count_distinct("session_id")
    agg = j.groupBy("page_path").agg(
        F.count(F.lit(1)).alias("views"),
        sess.alias("sessions"),
        F.try_divide(F.count_if(F.col("s_page_views") == 1) * F.lit(100.0), sess).alias("bounce_rate"))
    return top_k(agg, "views", ["page_path"], n)


def _boundary_pages(page_views: DataFrame, period, as_of, start, end, n: int, first: bool,
                    out: str) -> DataFrame:
    """Entry (first) / exit (last) pages: per session the earliest/latest in-period view time,
    then every view of that session at that instant (ties all count).

    One scan: views are ranked within their session, and only rank 1 is kept. Spark cuts each
    task's rows to rank 1 before the shuffle (a window group limit), so a session with millions of
    views sends only the ties of each task's extreme.
    """
    pv = (page_views.where(time_filter("viewed_at", period, start, end, as_of, pcol(page_views)))
          .where(F.col("session_id").isNotNull() & F.col("viewed_at").isNotNull())
          .select("session_id", "page_path", "viewed_at"))
    edge = F.asc("viewed_at") if first else F.desc("viewed_at")
    rank = F.rank().over(Window.partitionBy("session_id").orderBy(edge))
    hits = pv.withColumn("_rank", rank).where(F.col("_rank") == 1)
    return top_k(hits.groupBy("page_path").agg(F.count(F.lit(1)).alias(out)), out, ["page_path"], n)


def entry_pages(page_views, period=DEFAULT_PERIOD, as_of=None, start=None, end=None,
                n: int = 10) -> DataFrame:
    """Q16: where sessions begin (within the period)."""
    return _boundary_pages(page_views, period, as_of, start, end, n, True, "entries")


def exit_pages(page_views, period=DEFAULT_PERIOD, as_of=None, start=None, end=None,
               n: int = 10) -> DataFrame:
    """Q17: where sessions end (within the period)."""
    return _boundary_pages(page_views, period, as_of, start, end, n, False, "exits")
