"""Maintained first touches against the stored sessions themselves."""

import random
from datetime import datetime, timedelta

import pytest
from test_merge import _hits

from webtraffic.operators import first_touch as FT
from webtraffic.operators import metrics as M
from webtraffic.operators.ingest import ingest
from webtraffic.operators.merge import merge_tables
from webtraffic.schema import HIT, SESSIONS, conform
from webtraffic.sources import ledger as L
from webtraffic.sources.tables import Tables, load_tables, write_tables

START = datetime(2024, 1, 1)


def _sessions(spark, rows):
    return conform(spark.createDataFrame(rows, "id long, visitor_id string, session_id string, started_at timestamp_ntz, page_views long"), SESSIONS)


def _expected(sessions):
    out = {}
    for r in sessions.collect():
        if r.visitor_id is not None and r.started_at is not None:
            out[r.visitor_id] = min(out.get(r.visitor_id, r.started_at), r.started_at)
    return out


def _got(touches):
    rows = FT.combine_touches(touches).collect()
    assert len({r.visitor_id for r in rows}) == len(rows)
    return {r.visitor_id: r.first_started for r in rows}


def _check(spark, out):
    t = load_tables(spark, out)
    assert _got(t.first_touch) == _expected(t.sessions)
    return t


def test_loads_in_any_order_keep_the_first_touches(spark, tmp_path):
    hits, out = _hits(200), str(tmp_path)
    random.Random(7).shuffle(hits)
    for k in (2, 0, 0, 1):
        merge_tables(spark, ingest(spark.createDataFrame(hits[k::3], HIT))[0], out)
        _check(spark, out)
    before = _got(FT.stored_first_touch(spark, out))
    state = FT.compact_touches(spark, out)
    assert all(len(p) == 1 for p in state.dirs[FT.TABLE].values())
    assert FT.stored_first_touch(spark, out).count() == len(before) and _got(FT.stored_first_touch(spark, out)) == before


def test_a_session_that_goes_over_to_another_visitor(spark, tmp_path):
    out, at = str(tmp_path), lambda h: START + timedelta(hours=h)
    loads = [
        [(1, "a", "s1", at(5), 1), (2, "a", "s2", at(9), 1), (3, "b", "s3", at(7), 1), (4, None, "s4", at(1), 1), (5, "c", "s5", None, 1)],
        [(6, "b", "s1", at(2), 1)],  # s1 was b's all along: a starts at 9, b at 2
        [(7, "d", "s2", at(8), 1)],  # a has no session any more
        [(8, "c", "s4", at(0), 1)],
    ]
    for rows in loads:
        merge_tables(spark, Tables(sessions=_sessions(spark, rows)), out)
        t = load_tables(spark, out, names=("sessions",))
        assert _got(t.first_touch) == _expected(t.sessions)
    assert _got(t.first_touch) == {"b": at(2), "d": at(8), "c": at(0)}


def test_interrupted_loads_publish_neither(spark, tmp_path, monkeypatch):
    hits, out = _hits(90, 3), str(tmp_path)
    parts = [ingest(spark.createDataFrame(hits[k::2], HIT))[0] for k in range(2)]
    merge_tables(spark, parts[0], out)
    before = _got(_check(spark, out).first_touch)
    with monkeypatch.context() as m:
        m.setattr(L, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            merge_tables(spark, parts[1], out)
    assert _got(_check(spark, out).first_touch) == before
    merge_tables(spark, parts[1], out)
    _check(spark, out)


def test_tables_without_touches_get_them_with_their_next_load(spark, tmp_path):
    hits, out = _hits(90, 3), str(tmp_path)
    parts = [ingest(spark.createDataFrame(hits[k::2], HIT))[0] for k in range(2)]
    write_tables(parts[0], out)
    merge_tables(spark, parts[1], out)
    _check(spark, out)
    # a ledger of before the view
    state = L.read_state(spark, out)
    L.commit(spark, out, L.State(state.version + 1, state.loads, {t: d for t, d in state.dirs.items() if t != FT.TABLE}))
    assert load_tables(spark, out).first_touch is None
    merge_tables(spark, ingest(spark.createDataFrame(_hits(40, 20), HIT))[0], out, load_id="again")
    _check(spark, out)


def test_empty_load(spark, tmp_path):
    merge_tables(spark, Tables(sessions=_sessions(spark, [])), str(tmp_path), load_id="none")
    t = load_tables(spark, str(tmp_path), names=("sessions",))
    assert M.return_visitors(t.sessions, "all", as_of=START, first_touch=t.first_touch).first()[0] == 0


def test_returning_visitors_read_no_older_sessions(spark, tmp_path):
    hits, out = _hits(300), str(tmp_path)
    for k in range(2):
        merge_tables(spark, ingest(spark.createDataFrame(hits[k::2], HIT))[0], out)
    t = load_tables(spark, out)
    now = max(h[10] for h in hits)
    for kw in (dict(period="24h"), dict(period="7d"), dict(period="all"), dict(start="2024-01-04", end="2024-01-06 12:00:00")):
        for fn in (M.return_visitors, M.new_visitors):
            mine = fn(t.sessions, as_of=now, first_touch=t.first_touch, **kw)
            assert mine.collect() == fn(t.sessions, as_of=now, **kw).collect(), kw
        mine = M.kpi_row(t.sessions, t.page_views, as_of=now, first_touch=t.first_touch, **kw)
        assert mine.collect() == M.kpi_row(t.sessions, t.page_views, as_of=now, **kw).collect(), kw
    plan = M.return_visitors(t.sessions, "24h", as_of=now, first_touch=t.first_touch)._jdf.queryExecution().executedPlan().toString()
    scans = [s for s in plan.splitlines() if "FileScan parquet" in s]
    assert any("LessThan(first_started" in s for s in scans)
    sessions = [s for s in scans if "first_started" not in s]
    assert sessions and all("dt#" in s.split("PartitionFilters")[1] and ">=" in s.split("PartitionFilters")[1] for s in sessions)
