"""Ingest equivalence: the aggregate derivation of visitors, sessions, page views,
details and events equals replaying the hits one request at a time, as the collector does."""

from conftest import SF_SMALL
from webtraffic.operators.ingest import (derive_events, derive_page_views, derive_sessions,
                                         derive_visitor_details, derive_visitors, normalize_hits)
from webtraffic.sources.hits import fixture_raw_hits


def _fold(hits):
    """Row-at-a-time replay in arrival order: get-or-create visitor and session, bump the
    session counter on a page view, append page views and detail rows."""
    visitors, sessions, page_views, details, events = {}, {}, [], [], []
    for h in sorted(hits, key=lambda r: (r["received_at"], r["hit_id"])):
        v = visitors.get(h["visitor_id"])
        if v is None:
            visitors[h["visitor_id"]] = {"ip_address": h["ip"], "user_agent": h["user_agent"],
                                         "created_at": h["received_at"],
                                         "last_seen": h["received_at"]}
        else:
            v["last_seen"] = h["received_at"]
        s = sessions.get(h["session_id"])
        if s is None:
            s = sessions[h["session_id"]] = {"visitor_id": h["visitor_id"],
                                             "started_at": h["received_at"],
                                             "referrer": h["referrer"], "page_views": 1}
        if h["type"] == "pageview":
            page_views.append((h["hit_id"], h["session_id"], h["page_path"]))
            s["page_views"] += 1
        else:
            events.append(h["hit_id"])
        if h["ip"] is not None:
            details.append(h["hit_id"])
    return visitors, sessions, page_views, details, events


def test_derivation_equals_row_at_a_time_fold(spark):
    valid, _ = normalize_hits(fixture_raw_hits(spark, SF_SMALL))
    hits = [r.asDict() for r in valid.collect()]  # a small fixture: the test's own replay
    visitors, sessions, page_views, details, events = _fold(hits)

    got_v = {r["visitor_id"]: {k: r[k] for k in ("ip_address", "user_agent", "created_at",
                                                 "last_seen")}
             for r in derive_visitors(valid).collect()}
    assert got_v == visitors
    got_s = {r["session_id"]: {k: r[k] for k in ("visitor_id", "started_at", "referrer",
                                                 "page_views")}
             for r in derive_sessions(valid).collect()}
    assert got_s == sessions
    got_pv = sorted((r["id"], r["session_id"], r["page_path"])
                    for r in derive_page_views(valid).collect())
    assert got_pv == sorted(page_views)
    assert sorted(r["id"] for r in derive_visitor_details(valid).collect()) == sorted(details)
    assert sorted(r["id"] for r in derive_events(valid).collect()) == sorted(events)
    assert len(sessions) > 10 and len(page_views) > 10 and events  # the fixture is not trivial
