"""The hourly roll-up against the stored sessions themselves."""

from datetime import datetime, timedelta

import pytest
from test_first_touch import _sessions

from webtraffic.operators import metrics as M
from webtraffic.operators import rollups as RU
from webtraffic.operators.merge import merge_tables
from webtraffic.sources.tables import Tables, load_tables

START = datetime(2024, 1, 1)
EXACT = ("total_sessions", "bounce_rate", "avg_session_duration", "avg_pages_per_session")


def _kpis(sessions, **kw):
    return [getattr(M, n)(sessions, **kw).first()[0] for n in EXACT]


def test_totals_from_the_rollup(spark, tmp_path):
    out = str(tmp_path)
    at = lambda i: START + timedelta(minutes=17 * i, seconds=i % 60)
    rows = [(i, None if i % 11 == 0 else f"v{i % 90}", f"s{i}", None if i == 5 else at(i), i % 4) for i in range(400)]
    merge_tables(spark, Tables(sessions=_sessions(spark, rows[:250])), out)
    # later hits of stored sessions, one of them an earlier start under another visitor
    late = [(900, "w", "s7", at(0), 2), (901, "v3", "s3", at(399), 1)]
    merge_tables(spark, Tables(sessions=_sessions(spark, rows[250:] + late)), out)
    t, rolled = load_tables(spark, out, names=("sessions",)), RU.stored_rollup(spark, out)
    assert rolled.agg({"sessions": "sum"}).first()[0] == 400
    now = at(399)
    for kw in (dict(period="24h"), dict(period="all"), dict(start="2024-01-02 03:10:20", end="2024-01-03 05:00:00"),
               dict(start="2024-01-02 03:10:20", end="2024-01-02 03:40:00"), dict(start="2024-01-02 03:00:00", end="2024-01-02 03:59:59"),
               dict(start="bad", end="2024-01-02"), dict(start="2024-01-03", end="2024-01-02")):
        got = RU.rolled_totals(rolled, t.sessions, as_of=now, **kw)
        row = got.first()
        assert [row[n] for n in EXACT] == pytest.approx(_kpis(t.sessions, as_of=now, **kw)), kw
        visitors = M.total_visitors(t.sessions, as_of=now, **kw).first()[0]
        assert abs(row.total_visitors - visitors) <= RU.BOUND * visitors, kw
        if kw.get("period") == "all":
            assert all("/session_rollup/" in f for f in got.inputFiles())


def test_estimates_of_many_visitors_stay_within_the_bound(spark):
    s = spark.range(60000).selectExpr("concat('v', id % 50000) visitor_id", "id % 3 page_views", "id % 7 duration",
                                      "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, int(id % 3000)) started_at")
    n = RU.rolled_totals(RU.session_rollup(s), s, "all").first().total_visitors
    assert abs(n - 50000) <= RU.BOUND * 50000
    assert tuple(RU.rolled_totals(RU.session_rollup(s.limit(0)), s.limit(0), "all").first()) == (0, 0, 0.0, 0.0, 0.0)
