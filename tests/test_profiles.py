"""Maintained profiles against the detail rows themselves."""

import random
from datetime import datetime, timedelta

import pytest
from test_merge import _hits

from webtraffic.operators import people as PE
from webtraffic.operators import profiles as P
from webtraffic.operators.ingest import ingest
from webtraffic.operators.merge import merge_tables
from webtraffic.schema import HIT, VISITOR_DETAILS, conform
from webtraffic.sources import ledger as L
from webtraffic.sources.tables import load_tables


def _details(spark, n=900):
    r = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 == 0 else f"v{r.randrange(30)}", r.choice([None, "A", "B"]), f"c{i}", "Chrome", "mobile", "iOS",
             start + timedelta(minutes=r.randrange(50))) for i in r.sample(range(n * 2), n)]
    names = "id long, visitor_id string, country string, city string, browser string, device_type string, os string, updated_at timestamp_ntz"
    return conform(spark.createDataFrame(rows, names), VISITOR_DETAILS)


def _expected(details):
    out = {}
    for r in sorted(details.collect(), key=lambda r: r.id):
        out.setdefault(r.visitor_id, []).append(r)
    return {
        v: (len(rs), max((r.updated_at, r.id) for r in rs), [r.id for r in rs[: P.PROFILE_ROWS]]) for v, rs in out.items()
    }


def _got(profiles):
    return {r.visitor_id: (r.n_details, (r.latest.updated_at, r.latest.id), [x.id for x in r.first]) for r in profiles.collect()}


def test_loads_in_any_grouping_give_the_same_profiles(spark, tmp_path):
    details, out = _details(spark), str(tmp_path)
    want = _expected(details)
    for k in (3, 1, 1, 0, 2):
        P.keep_profiles(spark, out, details.where(f"id % 4 = {k}"), f"load {k}")
    assert _got(P.combine_profiles(P.stored_profiles(spark, out))) == want
    state = P.compact_profiles(spark, out)
    assert all(len(p) == 1 for p in state.dirs[P.TABLE].values())
    rows = P.stored_profiles(spark, out)
    assert rows.count() == len(want) and _got(rows) == want


def test_a_load_publishes_its_rows_and_profiles_together(spark, tmp_path, monkeypatch):
    hits, out = _hits(90, 3), str(tmp_path)
    parts = [ingest(spark.createDataFrame(hits[k::2], HIT))[0] for k in range(2)]
    merge_tables(spark, parts[0], out)
    with monkeypatch.context() as m:
        m.setattr(L, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            merge_tables(spark, parts[1], out)
    for part in (None, parts[1], parts[1]):
        if part is not None:
            merge_tables(spark, part, out)
        t = load_tables(spark, out)
        assert _got(P.combine_profiles(P.stored_profiles(spark, out))) == _expected(t.visitor_details)


def test_listings_do_not_read_details(spark, tmp_path):
    hits, out = _hits(90, 3), str(tmp_path)
    merge_tables(spark, ingest(spark.createDataFrame(hits, HIT))[0], out)
    t, profiles = load_tables(spark, out), P.stored_profiles(spark, out)
    now = max(h[10] for h in hits)
    pairs = [
        (PE.recent_visitors_maintained(t.visitors, profiles, t.sessions, limit=7), PE.recent_visitors(t.visitors, t.visitor_details, t.sessions, limit=7)),
        (PE.recent_visitors_maintained(t.visitors, profiles, t.sessions, limit=-1), PE.recent_visitors(t.visitors, t.visitor_details, t.sessions, limit=-1)),
        (PE.realtime_feed_maintained(t.page_views, t.visitors, profiles, now), PE.realtime_feed(t.page_views, t.visitors, t.visitor_details, now)),
    ]
    for mine, plain in pairs:
        assert mine.collect() == plain.collect()
        read = {f.removeprefix(f"file://{out}/").split("/")[0] for f in mine.inputFiles()}
        assert "visitor_details" not in read and "visitor_profiles" in read
    with pytest.raises(ValueError, match="50"):
        PE.realtime_feed_maintained(t.page_views, t.visitors, profiles, now, n=51)
