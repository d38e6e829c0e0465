"""Ingest (I01-I07): raw hits → visitors, sessions, page views, visitor details, events.

The collector mutated rows one request at a time; the same end state is a set of
aggregations over the hit log. "First hit" means the lowest (received_at, hit_id): first-hit
attributes come from ``min_by`` over a struct, an aggregate that Spark combines map-side, so
a visitor or session with a huge number of hits costs one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.enrich import client_ip, device_type, empty_to_null, referrer_domain, zero_to_null
from ..functions.useragent import parse_user_agent
from ..schema import EVENTS, PAGE_VIEWS, SESSIONS, VISITOR_DETAILS, VISITORS, conform
from ..sources.tables import Tables
from .geo import with_geo, with_geo6

PAGEVIEW = "pageview"
# The collector's rejection messages.
VISITOR_REQUIRED = "visitorId is required"
SESSION_REQUIRED = "sessionId is required"
# Our own: a hit without a readable arrival time would drop out of every time-bounded report.
TIME_REQUIRED = "received_at cannot be read"


def _first(*cols):
    return F.min_by(F.struct(*cols), F.struct("received_at", "hit_id"))


def normalize_hits(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validate and flatten payloads (E08 defaults, E09 client address).

    Returns ``(valid, rejected)``; a rejected row keeps its hit id and the first failing
    reason (visitor id, session id, arrival time).
    """
    def missing(c):
        return F.col(c).isNull() | (F.col(c) == "")

    reason = (F.when(missing("visitorId"), F.lit(VISITOR_REQUIRED))
              .when(missing("sessionId"), F.lit(SESSION_REQUIRED))
              .when(F.col("received_at").isNull(), F.lit(TIME_REQUIRED)))
    h = raw.withColumn("reject_reason", reason)
    valid = h.where(F.col("reject_reason").isNull()).select(
        "hit_id", "received_at",
        F.col("visitorId").alias("visitor_id"),
        F.col("sessionId").alias("session_id"),
        "type",
        F.coalesce(empty_to_null("page.path"), F.lit("/")).alias("page_path"),
        F.coalesce(F.col("page.title"), F.lit("")).alias("page_title"),
        empty_to_null("page.referrer").alias("referrer"),
        F.coalesce(F.col("browser.userAgent"), F.lit("")).alias("user_agent"),
        empty_to_null("browser.language").alias("language"),
        zero_to_null("screen.width").alias("screen_width"),
        zero_to_null("screen.height").alias("screen_height"),
        client_ip("ip", "forwarded_for", "remote_addr").alias("ip"),
        *[c for c in ("event_time",) if c in raw.columns],  # streaming event time, if any
    )
    rejected = h.where(F.col("reject_reason").isNotNull()).select(
        "hit_id", "received_at", "reject_reason")
    return valid, rejected


def derive_visitors(valid: DataFrame) -> DataFrame:
    """One row per visitor; address and agent of its first hit, last_seen of its last."""
    return conform(valid.groupBy("visitor_id").agg(
        _first(F.col("hit_id").alias("id"), F.col("ip").alias("ip_address"),
               "user_agent").alias("f"),
        F.min("received_at").alias("created_at"),
        F.max("received_at").alias("last_seen"))
        .select("f.id", "visitor_id", "f.ip_address", "f.user_agent", "created_at", "last_seen"),
        VISITORS)


def derive_sessions(valid: DataFrame, count_from: int = 1) -> DataFrame:
    """One row per session; visitor, start and referrer of its first hit.

    ``page_views = count_from + number of pageview hits``; the collector's column starts at 1
    and every page view adds one, so the default reproduces its stored value.
    """
    s = valid.groupBy("session_id").agg(
        _first(F.col("hit_id").alias("id"), "visitor_id", F.col("received_at").alias("started_at"),
               "referrer").alias("f"),
        F.count_if(F.col("type") == PAGEVIEW).alias("_n_pv"))
    return conform(s.select(
        "f.id", "f.visitor_id", "session_id", "f.started_at",
        (F.lit(count_from) + F.col("_n_pv")).cast("long").alias("page_views"),
        "f.referrer", referrer_domain(F.col("f.referrer")).alias("referrer_domain")), SESSIONS)


def derive_page_views(valid: DataFrame) -> DataFrame:
    """A row per hit whose type is exactly ``pageview``."""
    return conform(valid.where(F.col("type") == PAGEVIEW).select(
        F.col("hit_id").alias("id"), "session_id", "visitor_id", "page_path", "page_title",
        F.col("received_at").alias("viewed_at"), F.lit(False).alias("is_bounce")), PAGE_VIEWS)


def derive_visitor_details(valid: DataFrame, geo_ranges: DataFrame | None = None,
                           broadcast_geo: bool | None = None, geo_ranges6: DataFrame | None = None) -> DataFrame:
    """A row per valid hit (append-only, as the collector's insert never conflicts).

    Geo (E05) through the range join, browser / OS / device families from the agent (E06),
    device class from the device family (E02); country_code repeats country, as stored by the
    collector. A hit without any client address gets no row (the collector's lookup failed on
    it and skipped the insert).
    """
    h = valid.where(F.col("ip").isNotNull())
    if geo_ranges is not None:
        h = with_geo(h, geo_ranges, "ip", broadcast=broadcast_geo)
    else:
        h = (h.withColumn("geo_country", F.lit(None).cast("string"))
              .withColumn("geo_region", F.lit(None).cast("string"))
              .withColumn("geo_city", F.lit(None).cast("string")))
    if geo_ranges6 is not None:
        h = with_geo6(h, geo_ranges6, "ip")
    ua = parse_user_agent(F.col("user_agent"))
    return conform(h.withColumn("_ua", ua).select(
        F.col("hit_id").alias("id"), "visitor_id",
        F.col("geo_country").alias("country"), F.col("geo_country").alias("country_code"),
        F.col("geo_city").alias("city"), F.col("geo_region").alias("region"),
        empty_to_null("_ua.browser").alias("browser"),
        device_type(F.col("_ua.device")).alias("device_type"),
        empty_to_null("_ua.os").alias("os"),
        "screen_width", "screen_height", "language",
        F.col("received_at").alias("updated_at")), VISITOR_DETAILS)


def derive_events(valid: DataFrame) -> DataFrame:
    """Hits of any other type, in the events table's shape."""
    return conform(valid.where(F.col("type").isNull() | (F.col("type") != PAGEVIEW)).select(
        F.col("hit_id").alias("id"), "session_id", "visitor_id",
        F.col("type").alias("event_type"), "page_path",
        F.col("received_at").alias("created_at")), EVENTS)


def stage_hits(valid: DataFrame, path: str | None = None) -> DataFrame:
    """Write validated hits once as date-partitioned Parquet and read them back.

    The five tables are derived from the same hits; on a raw JSON source each derivation
    would parse the whole log again. Staged, the log is parsed once, each table reads only
    its columns, and lineage is cut at a written table in the shared checkpoint folder (so a
    lost executor recomputes from it, not from the raw payloads).
    """
    from ..session import scratch_path

    spark = valid.sparkSession
    out = path or scratch_path(spark, "staged_hits")
    dated = valid.withColumn("dt", F.to_date("received_at"))
    dated.write.mode("overwrite").partitionBy("dt").parquet(out)
    return spark.read.schema(dated.schema).parquet(out).drop("dt")  # a load may hold no valid hit


def ingest(raw: DataFrame, geo_ranges: DataFrame | None = None,
           stage: bool | str = False, geo_ranges6: DataFrame | None = None) -> tuple[Tables, DataFrame]:
    """All of I01-I07: the five tables (lazy) and the rejected hits.

    ``stage=True`` first writes the validated hits once (:func:`stage_hits`), which is what a
    large raw log wants, and a path writes them there; the default keeps everything lazy.
    """
    valid, rejected = normalize_hits(raw)
    if stage:
        valid = stage_hits(valid, stage if isinstance(stage, str) else None)
    tables = Tables(visitors=derive_visitors(valid), sessions=derive_sessions(valid),
                    page_views=derive_page_views(valid),
                    visitor_details=derive_visitor_details(valid, geo_ranges, geo_ranges6=geo_ranges6),
                    events=derive_events(valid))
    return tables, rejected
