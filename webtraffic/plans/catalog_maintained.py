"""Catalog entries answered from maintained views instead of the detail rows or older sessions."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import people as PE
from ..operators import profiles as P
from ..operators import rollups as RU
from ..operators.merge import merge_tables
from ..session import scratch_path
from ..schema import TABLE_SCHEMAS
from ..sources.hits import fixture_geo_ranges
from ..sources.tables import Tables, load_tables
from ..streaming import commits
from ..streaming import live as L
from .catalog import CATALOG, T, register
from .catalog_ingest import _DETAIL_COLS
from .catalog_metrics import VARIANTS
from .catalog_streaming import _json_stream, _run, events_page_views

_CACHE: dict = {}
_LOCK = threading.Lock()


def profiles(spark, sf_dir):
    """Profiles of the fixture's detail rows as three loads leave them, the latest first; one load is repeated."""
    key = (spark.sparkContext.applicationId, sf_dir)
    details = T(spark, sf_dir).visitor_details
    with _LOCK:
        if key not in _CACHE:
            out = scratch_path(spark, "profiles")
            for part in (2, 0, 0, 1):
                P.keep_profiles(spark, out, details.where(F.col("id") % 3 == part), f"part {part}")
            _CACHE[key] = out
    return P.stored_profiles(spark, _CACHE[key])


@register("realtime_feed_maintained", CATALOG["realtime_feed"].sql)
def _feed(spark, d):
    t = T(spark, d)
    return PE.realtime_feed_maintained(t.page_views, t.visitors, profiles(spark, d), t.as_of)


@register("recent_visitors_maintained", CATALOG["recent_visitors"].sql)
def _recent(spark, d):
    t = T(spark, d)
    return PE.recent_visitors_maintained(t.visitors, profiles(spark, d), t.sessions)


@register("recent_visitors_all_maintained", CATALOG["recent_visitors_all"].sql)
def _recent_all(spark, d):
    t = T(spark, d)
    return PE.recent_visitors_maintained(t.visitors, profiles(spark, d), t.sessions, limit=-1)


@register("stream_realtime_feed_maintained", CATALOG["stream_realtime_feed"].sql)
def _stream_feed(spark, d):
    out, ck = scratch_path(spark, "stream", "feed"), scratch_path(spark, "stream", "ck")
    _run(L.realtime_sink(events_page_views(spark, d), T(spark, d).visitors, profiles(spark, d), out, ck, maintained=True))
    return L.read_feed(spark, out)


def merged_sessions(spark, sf_dir) -> Tables:
    """The fixture's sessions as three loads leave them in a ledger, the latest first; one load is repeated."""
    return load_tables(spark, _merged_dir(spark, sf_dir), as_of=T(spark, sf_dir).as_of, names=("sessions",))


def _merged_dir(spark, sf_dir) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, "sessions")
    sessions = T(spark, sf_dir).sessions
    with _LOCK:
        if key not in _CACHE:
            out = scratch_path(spark, "sessions")
            for part in (2, 0, 0, 1):
                merge_tables(spark, Tables(sessions=sessions.where(F.col("id") % 3 == part)), out)
            _CACHE[key] = out
    return _CACHE[key]


def _register_first_touch():
    for suffix, kw in VARIANTS.items():
        def kpi(spark, d, kw=kw):
            t = merged_sessions(spark, d)
            return M.kpi_row(t.sessions, T(spark, d).page_views, as_of=t.as_of, first_touch=t.first_touch, **kw)
        register(f"kpi_row{suffix}_first_touch", CATALOG[f"kpi_row{suffix}"].sql)(kpi)

        for name in ("return_visitors", "new_visitors"):
            if f"{name}{suffix}" not in CATALOG:
                continue

            def run(spark, d, fn=getattr(M, name), kw=kw):
                t = merged_sessions(spark, d)
                return fn(t.sessions, as_of=t.as_of, first_touch=t.first_touch, **kw)
            register(f"{name}{suffix}_first_touch", CATALOG[f"{name}{suffix}"].sql)(run)


_register_first_touch()


def _register_rolled():
    """Totals from the hourly roll-up: the exact measures, and whether the estimated visitors are within their bound."""
    exact = ("total_sessions", "bounce_rate", "avg_session_duration", "avg_pages_per_session")
    for suffix, kw in VARIANTS.items():
        def run(spark, d, kw=kw):
            t = merged_sessions(spark, d)
            rolled = RU.rolled_totals(RU.stored_rollup(spark, _merged_dir(spark, d)), t.sessions, as_of=t.as_of, **kw)
            visitors = M.total_visitors(t.sessions, as_of=t.as_of, **kw).scalar()
            rows = rolled.withColumn("exact", visitors)
            near = F.abs(F.col("total_visitors") - F.col("exact")) <= F.lit(RU.BOUND) * F.col("exact")
            return rows.select(F.col("exact").alias("total_visitors"), near.alias("within_bound"), *exact)
        register(f"session_totals_rolled{suffix}", f"""
SELECT total_visitors, true AS within_bound, {', '.join(exact)} FROM ({CATALOG["kpi_row" + suffix].sql}) t""")(run)


_register_rolled()


def streamed_tables(spark, sf_dir) -> Tables:
    """The tables that a stream of the fixture's JSON payloads commits to a ledger, four files a micro-batch."""
    key = (spark.sparkContext.applicationId, sf_dir, "streamed")
    with _LOCK:
        if key not in _CACHE:
            out, ck = scratch_path(spark, "stream", "ledger"), scratch_path(spark, "stream", "ck")
            _run(commits.ledger_sink(_json_stream(spark, sf_dir, 4), out, ck, fixture_geo_ranges(spark, sf_dir)))
            _CACHE[key] = out
    return load_tables(spark, _CACHE[key])


def _register_streamed():
    for name in TABLE_SCHEMAS:
        columns = _DETAIL_COLS if name == "visitor_details" else TABLE_SCHEMAS[name].fieldNames()

        def run(spark, d, name=name, columns=columns):
            return streamed_tables(spark, d).frames()[name].select(*columns)
        register(f"stream_ledger_{name}", CATALOG[f"ingest_{name}"].sql)(run)


_register_streamed()
