"""Visitor-level reports (Q32-Q35) and the latest-details view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.period import LIVE_WINDOW, after, pcol
from .profiles import PROFILE_ROWS, combine_profiles, profiles_of
from .topk import parse_limit

FEED_COLUMNS = ["visitor_id", "country", "city", "browser", "device_type", "page_path",
                "viewed_at"]
RECENT_DETAIL_COLUMNS = ["country", "city", "browser", "device_type", "os"]


def latest_details(details: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per visitor — its detail row with the greatest (updated_at, id).

    A ``max_by`` aggregate, so it is combined map-side: a visitor with millions of detail rows
    never has to be gathered into one task the way a row_number window would.
    """
    cols = columns or [c for c in details.columns if c not in ("visitor_id", "dt")]
    return (details.groupBy("visitor_id")
            .agg(F.max_by(F.struct(*cols), F.struct("updated_at", "id")).alias("_d"))
            .select("visitor_id", *[F.col(f"_d.{c}").alias(c) for c in cols]))


def realtime_feed(page_views: DataFrame, visitors: DataFrame, details: DataFrame, as_of,
                  n: int = 50, latest: bool = False, ranked: bool = False) -> DataFrame:
    """Q32: page views of the last five minutes with visitor details, newest first, ``n`` rows.

    Reference semantics: inner join to visitors, left join to *every* detail row of the visitor
    (one output row per pair), ``ORDER BY viewed_at DESC LIMIT n``; ties are broken by page
    view id, then detail id. Every page view yields at least one row, so only the newest ``n``
    page views can appear; for their (at most ``n``) visitors only the first ``n`` detail rows
    by id can appear. Both cuts are exact. Up to Spark's window group limit threshold (1000) the
    per-visitor cut also runs before the shuffle, so a visitor with millions of detail rows sends at
    most ``n`` per map task; with a larger ``n`` all of the visitor's rows are shuffled. No
    visitor × detail product is ever built.
    ``latest=True`` joins the single latest detail row per visitor (E07) instead; ``ranked=True`` adds each
    row's place (``feed_rank``, from 1), as the rows of one page view tie in every shown time.
    """
    top = _newest_views(page_views, visitors, as_of, n)
    dcols = ["country", "city", "browser", "device_type"]
    # The key set is the output of a limit-n query; Spark broadcasts it if its measured size allows.
    mine = details.join(top.select("visitor_id").distinct(), "visitor_id", "left_semi")
    if latest:
        d = latest_details(mine, dcols).withColumn("_rk", F.lit(1))
    else:
        w = Window.partitionBy("visitor_id").orderBy(F.asc("id"))
        d = (mine.select("visitor_id", "id", *dcols)
             .withColumn("_rk", F.row_number().over(w))
             .where(F.col("_rk") <= n))
    return _feed(top, d, n, ranked)


def realtime_feed_maintained(page_views: DataFrame, visitors: DataFrame, profiles: DataFrame, as_of,
                             n: int = 50) -> DataFrame:
    """Q32 from the maintained profiles (:mod:`.profiles`) of the newest page views' visitors; no detail row is
    read. A feed of more rows than a profile keeps needs :func:`realtime_feed`."""
    if n > PROFILE_ROWS:
        raise ValueError(f"profiles keep {PROFILE_ROWS} detail rows")
    top = _newest_views(page_views, visitors, as_of, n)
    mine = profiles_of(profiles, top)
    d = mine.select("visitor_id", F.posexplode("first").alias("_rk", "_d")).select("visitor_id", "_rk", "_d.*")
    return _feed(top, d, n)


def _newest_views(page_views: DataFrame, visitors: DataFrame, as_of, n: int) -> DataFrame:
    recent = (page_views.where(after("viewed_at", as_of, LIVE_WINDOW, pcol(page_views)))
              .select(F.col("id").alias("_pv_id"), "visitor_id", "page_path", "viewed_at"))
    known = recent.join(visitors.select("visitor_id"), "visitor_id", "left_semi")
    return known.orderBy(F.desc("viewed_at"), F.asc("_pv_id")).limit(n)


def _feed(top: DataFrame, details: DataFrame, n: int, ranked: bool = False) -> DataFrame:
    order = (F.desc("viewed_at"), F.asc("_pv_id"), F.asc_nulls_first("_rk"))
    rows = top.join(details, "visitor_id", "left").orderBy(*order).limit(n)
    # at most n rows are numbered
    place = [F.row_number().over(Window.orderBy(*order)).alias("feed_rank")] if ranked else []
    return rows.select(*FEED_COLUMNS, *place)


def realtime_count(feed: DataFrame) -> DataFrame:
    """Q33: rows in the realtime feed (at most its limit; not distinct visitors)."""
    return feed.agg(F.count(F.lit(1)).alias("count"))


def recent_visitors(visitors: DataFrame, details: DataFrame, sessions: DataFrame,
                    limit=None, dedupe: bool = False) -> DataFrame:
    """Q34/Q35: most recently seen visitors with session count and page-view total.

    The reference joins visitors × details × sessions and groups by visitor; the page-view sum
    is therefore multiplied by the visitor's number of detail rows. Here each side is first
    aggregated per visitor (one partially-aggregated shuffle each) and joined 1:1, and the
    multiplication is applied explicitly (``dedupe=True`` leaves it out). The shown detail
    columns are the visitor's latest detail row (the reference takes an arbitrary one).
    ``limit`` follows ``parseInt(limit) || 50``; negative means all visitors.

    With a limit, the ``n`` most recent visitors are chosen first (a top-k over the visitors
    table), and only their sessions and details are aggregated, through semi-joins whose side
    Spark broadcasts if its measured size allows.
    """
    n = parse_limit(limit)
    v = _last_seen(visitors, n)
    if n is not None:
        details = details.join(v.select("visitor_id"), "visitor_id", "left_semi")
    d = (details.groupBy("visitor_id")
         .agg(F.count(F.lit(1)).alias("_n_details"),
              F.max_by(F.struct(*RECENT_DETAIL_COLUMNS), F.struct("updated_at", "id")).alias("_d")))
    return _recent(v, d, sessions, n, dedupe)


def recent_visitors_maintained(visitors: DataFrame, profiles: DataFrame, sessions: DataFrame,
                               limit=None, dedupe: bool = False) -> DataFrame:
    """Q34/Q35 from the maintained profiles (:mod:`.profiles`); no detail row is read."""
    n = parse_limit(limit)
    v = _last_seen(visitors, n)
    mine = combine_profiles(profiles) if n is None else profiles_of(profiles, v)
    d = mine.select("visitor_id", F.col("n_details").alias("_n_details"), F.col("latest").alias("_d"))
    return _recent(v, d, sessions, n, dedupe)


def _recent_order() -> list:
    return [F.desc_nulls_last("last_seen"), F.asc("visitor_id")]


def _last_seen(visitors: DataFrame, n: int | None) -> DataFrame:
    v = visitors.select("visitor_id", "ip_address", "last_seen")
    return v if n is None else v.orderBy(*_recent_order()).limit(n)


def _recent(v: DataFrame, d: DataFrame, sessions: DataFrame, n: int | None, dedupe: bool) -> DataFrame:
    """The visitors ``v`` with their session sums and details (visitor_id, _n_details, _d)."""
    if n is not None:
        sessions = sessions.join(v.select("visitor_id"), "visitor_id", "left_semi")
    s = (sessions.where(F.col("visitor_id").isNotNull()).groupBy("visitor_id")
         .agg(F.count_distinct("id").alias("session_count"),
              F.sum("page_views").alias("_pv_sum")))
    factor = F.lit(1) if dedupe else F.greatest(F.coalesce("_n_details", F.lit(0)), F.lit(1))
    out = (v.join(d, "visitor_id", "left")
           .join(s, "visitor_id", "left")
           .select("visitor_id", "ip_address", "last_seen",
                   *[F.col(f"_d.{c}").alias(c) for c in RECENT_DETAIL_COLUMNS],
                   F.coalesce("session_count", F.lit(0)).alias("session_count"),
                   (F.col("_pv_sum") * factor).alias("total_page_views")))
    return out.orderBy(*_recent_order())
