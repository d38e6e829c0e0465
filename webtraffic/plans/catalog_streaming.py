"""Catalog entries: the streaming pipelines (T02-T06), each run to completion over the
``events`` table read as a stream, then compared with the batch answer's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import PAGE_VIEWS, SESSIONS, VISITORS
from ..session import scratch_path
from ..sources.fixtures import fixture_hits, hits_from_events
from ..sources.hits import fixture_geo_ranges, raw_hits_from_events
from ..streaming import live as L
from .catalog import CATALOG, T, oracle, register
from .catalog_ingest import _DETAIL_COLS, ingest_sql, json_hits
from .catalog_reports import _FEED_CTES, _FEED_NEEDS, _FEED_SQL


def events_stream(spark, sf_dir):
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .parquet(sf_dir.rstrip("/")))


def _valid_stream(spark, sf_dir):
    raw = L.with_event_time(raw_hits_from_events(events_stream(spark, sf_dir)))
    return L.ingest_stream(raw)


def _run(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@register("stream_sessions", ingest_sql("SELECT * FROM sessions_i", "sessions_i"))
def _stream_sessions(spark, d):
    out, ck = scratch_path(spark, "stream", "sessions"), scratch_path(spark, "stream", "ck")
    _run(L.versioned_sink(L.stream_sessions(_valid_stream(spark, d)), out, ck,
                          key="session_id", compact_every=L.COMPACT_EVERY))
    return L.read_latest(spark, out, "session_id", SESSIONS)


@register("stream_visitors", ingest_sql("""
SELECT f.hit_id AS id, f.visitor_id, f.ip AS ip_address, f.user_agent, a.created_at, a.last_seen
FROM (SELECT *, row_number() OVER (PARTITION BY visitor_id ORDER BY received_at, hit_id) AS rn
      FROM valid) f
JOIN (SELECT visitor_id, min(received_at) AS created_at, max(received_at) AS last_seen
      FROM valid GROUP BY visitor_id) a ON f.visitor_id = a.visitor_id
WHERE f.rn = 1"""))
def _stream_visitors(spark, d):
    out, ck = scratch_path(spark, "stream", "visitors"), scratch_path(spark, "stream", "ck")
    _run(L.versioned_sink(L.stream_visitors(_valid_stream(spark, d)), out, ck,
                          key="visitor_id", compact_every=L.COMPACT_EVERY))
    return L.read_latest(spark, out, "visitor_id", VISITORS)


@register("stream_page_views", ingest_sql("""
SELECT hit_id AS id, session_id, visitor_id, page_path, page_title, received_at AS viewed_at,
 FALSE AS is_bounce
FROM valid WHERE type = 'pageview'"""))
def _stream_page_views(spark, d):
    out, ck = scratch_path(spark, "stream", "append"), scratch_path(spark, "stream", "ck")
    # The events file is a single split, so each micro-batch is spread over the cores.
    for q in L.stream_append(_valid_stream(spark, d), out, ck, fixture_geo_ranges(spark, d),
                             spread_partitions=spark.sparkContext.defaultParallelism):
        _run(q)
    return spark.read.parquet(f"{out}/page_views").select(*PAGE_VIEWS.fieldNames())


def _appended(spark, d, valid, table):
    out, ck = scratch_path(spark, "stream", "append"), scratch_path(spark, "stream", "ck")
    for q in L.stream_append(valid, out, ck, fixture_geo_ranges(spark, d)):
        _run(q)
    return spark.read.parquet(f"{out}/{table}")


def _json_stream(spark, d, files=2):
    """JSON payloads, two (or other) files a micro-batch."""
    return L.read_hits_stream(spark, json_hits(spark, d), max_files_per_trigger=files)


@register("stream_visitor_details", CATALOG["ingest_visitor_details"].sql)
def _stream_details(spark, d):
    return _appended(spark, d, _valid_stream(spark, d), "visitor_details").select(*_DETAIL_COLS)


@register("stream_json_page_views", CATALOG["stream_page_views"].sql)
def _stream_json_page_views(spark, d):
    valid = L.ingest_stream(_json_stream(spark, d))
    return _appended(spark, d, valid, "page_views").select(*PAGE_VIEWS.fieldNames())


@register("stream_json_sessions", CATALOG["stream_sessions"].sql)
def _stream_json_sessions(spark, d):
    out, ck = scratch_path(spark, "stream", "sessions"), scratch_path(spark, "stream", "ck")
    valid = L.ingest_stream(_json_stream(spark, d))
    _run(L.versioned_sink(L.stream_sessions(valid), out, ck, key="session_id", compact_every=2))
    return L.read_latest(spark, out, "session_id", SESSIONS)


@register("stream_dedupe", CATALOG["stream_page_views"].sql)
def _stream_dedupe(spark, d):
    raw = L.read_hits_stream(spark, json_hits(spark, d))  # one micro-batch: no hit is late
    valid = L.ingest_stream(L.dedupe_hits(raw.unionByName(raw)))
    return _appended(spark, d, valid, "page_views").select(*PAGE_VIEWS.fieldNames())


@register("stream_active_sessions", oracle("""
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end,
 count(DISTINCT session_id) AS active_sessions
FROM (SELECT session_id, date_trunc('minute', viewed_at) - to_minutes(k) AS window_start
      FROM (SELECT session_id, viewed_at, unnest([0, 1, 2, 3, 4]) AS k FROM page_views))
GROUP BY window_start""", "page_views"))
def _stream_active(spark, d):
    hits = L.with_event_time(hits_from_events(events_stream(spark, d)))
    pv = hits.where(F.col("type") == "pageview")
    out, ck = scratch_path(spark, "stream", "live"), scratch_path(spark, "stream", "ck")
    _run(L.versioned_sink(L.stream_active_sessions(pv), out, ck))
    res = L.active_sessions_by_window(spark, out)
    return res.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                      "active_sessions")


# A window closes once the newest page view is the watermark's delay past its end.
@register("stream_closed_windows", oracle("""
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end,
 count(DISTINCT session_id) AS active_sessions
FROM (SELECT session_id, date_trunc('minute', viewed_at) - to_minutes(k) AS window_start
      FROM (SELECT session_id, viewed_at, unnest([0, 1, 2, 3, 4]) AS k FROM page_views))
WHERE window_start + INTERVAL 5 MINUTE <= (SELECT date_trunc('milliseconds', max(viewed_at)) FROM page_views) - INTERVAL 10 MINUTE
GROUP BY window_start""", "page_views"))
def _stream_closed(spark, d):
    """The log arrives in three files in order of time, one a micro-batch; the stream is restarted before the last."""
    views = fixture_hits(spark, d).where(F.col("type") == "pageview").select("session_id", "received_at")
    cuts = views.select(F.percentile_approx(F.unix_micros(F.col("received_at").cast("timestamp")), [0.4, 0.8])).first()[0]
    at = F.unix_micros(F.col("received_at").cast("timestamp"))
    log, out, ck = (scratch_path(spark, "stream", x) for x in ("log", "closed", "ck"))
    parts = (at <= cuts[0], (at > cuts[0]) & (at <= cuts[1]), at > cuts[1])
    for done, part in enumerate(parts):
        views.where(part).coalesce(1).write.mode("append").parquet(log)
        if done:
            hits = L.with_event_time(spark.readStream.schema(views.schema).option("maxFilesPerTrigger", 1).parquet(log))
            _run(L.append_sink(L.stream_closed_windows(hits), out, ck))
    res = spark.read.parquet(out)
    return res.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "active_sessions")


def events_page_views(spark, d):
    hits = hits_from_events(events_stream(spark, d))
    return hits.where(F.col("type") == "pageview").select(
        F.col("hit_id").alias("id"), "session_id", "visitor_id", "page_path",
        F.col("received_at").alias("viewed_at"))


@register("stream_realtime_feed", oracle(_FEED_SQL, *_FEED_NEEDS, extra=_FEED_CTES))
def _stream_feed(spark, d):
    t = T(spark, d)
    pv = events_page_views(spark, d)
    out, ck = scratch_path(spark, "stream", "feed"), scratch_path(spark, "stream", "ck")
    _run(L.realtime_sink(pv, t.visitors, t.visitor_details, out, ck))
    return L.read_feed(spark, out)
