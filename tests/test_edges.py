"""Hand-made edge tables (FIXTURES.md §4) for cases the generated data cannot reach."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtraffic.functions import enrich as E
from webtraffic.functions.period import (before_period, date_range_filter, period_filter,
                                         time_filter)
from webtraffic.functions.useragent import parse_user_agent
from webtraffic.operators import audience as A
from webtraffic.operators import metrics as M
from webtraffic.operators import pages as P
from webtraffic.operators import people as PE
from webtraffic.operators.geo import ipv4_to_long, with_geo
from webtraffic.operators.ingest import derive_sessions, derive_visitors, normalize_hits
from webtraffic.operators.topk import parse_limit
from webtraffic.schema import GEO_RANGES, HIT

AS_OF = datetime(2024, 1, 31, 12, 0, 0)


def ts(s):
    return None if s is None else datetime.fromisoformat(s)


def sessions_df(spark, rows):
    schema = "id long, visitor_id string, session_id string, started_at timestamp_ntz, " \
             "duration long, page_views long, referrer_domain string, utm_source string, " \
             "utm_medium string"
    return spark.createDataFrame(rows, schema)


def pv_df(spark, rows):
    return spark.createDataFrame(
        rows, "id long, session_id string, visitor_id string, page_path string, viewed_at timestamp_ntz")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- period predicates ------------------------------------------------------------------------

def test_period_rules(spark):
    df = spark.createDataFrame(
        [(ts("2024-01-30 12:00:00"),), (ts("2024-01-30 12:00:00.5"),), (ts("2024-01-30 12:00:01"),),
         (ts("2024-01-20 00:00:00"),), (None,)], "t timestamp_ntz")

    def n(pred):
        return df.where(pred).count()

    # 24h: datetime(t) > datetime(now,-1 day), whole seconds on both sides.
    assert n(period_filter("t", "24h", AS_OF)) == 1
    assert n(period_filter("t", "", AS_OF)) == 1          # empty → 24h
    assert n(period_filter("t", None, AS_OF)) == 1        # missing → 24h
    assert n(period_filter("t", "bogus", AS_OF)) == 5     # unknown → no filter, NULL kept
    assert n(period_filter("t", "all", AS_OF)) == 5
    assert n(period_filter("t", "30d", AS_OF)) == 4
    # Absolute range: inclusive at second granularity; date-only end is midnight.
    assert n(date_range_filter("t", "2024-01-20", "2024-01-30 12:00:00")) == 3
    assert n(date_range_filter("t", "2024-01-20", "2024-01-30")) == 1
    assert n(date_range_filter("t", "not a date", "2024-01-30")) == 0
    # Only one end given → falls back to the period.
    assert n(time_filter("t", "24h", "2024-01-01", None, AS_OF)) == 1
    # Strictly before the period: the complement of the kept rows that lie below the bound.
    assert n(before_period("t", "24h", None, None, AS_OF)) == 3   # NULL is neither
    assert n(before_period("t", "30d", None, None, AS_OF)) == 0
    assert n(before_period("t", None, "2024-01-30 12:00:00.5", "2024-02-01", AS_OF)) == 1
    assert before_period("t", "all", None, None, AS_OF) is None
    assert before_period("t", "bogus", None, None, AS_OF) is None
    assert before_period("t", "24h", "not a date", "2024-01-30", AS_OF) is None


# --- scalar metrics ---------------------------------------------------------------------------

def test_empty_sessions_give_zero_rates(spark):
    s = sessions_df(spark, [])
    pv = pv_df(spark, [])
    r = one(M.kpi_row(s, pv, "24h", AS_OF))
    assert r["total_sessions"] == 0 and r["total_visitors"] == 0
    assert r["bounce_rate"] == 0.0 and r["avg_session_duration"] == 0.0
    assert r["avg_pages_per_session"] == 0.0 and r["active_sessions"] == 0
    assert one(M.bounce_rate(s, "24h", AS_OF))["bounce_rate"] == 0.0


def test_returning_visitor_with_earlier_session_outside_period(spark):
    s = sessions_df(spark, [
        (1, "a", "s1", ts("2024-01-01 10:00:00"), None, 1, None, None, None),
        (2, "a", "s2", ts("2024-01-31 10:00:00"), 60, 3, None, None, None),
        (3, "b", "s3", ts("2024-01-31 11:00:00"), None, 1, None, None, None),
        (4, "c", "s4", ts("2024-01-31 11:00:00"), None, 1, None, None, None),
        (5, "c", "s5", ts("2024-01-31 11:00:00"), None, 1, None, None, None),  # same instant
    ])
    assert one(M.return_visitors(s, "24h", AS_OF))["return_visitors"] == 1
    assert one(M.new_visitors(s, "24h", AS_OF))["new_visitors"] == 2
    r = one(M.kpi_row(s, pv_df(spark, []), "24h", AS_OF))
    assert (r["total_visitors"], r["return_visitors"], r["new_visitors"]) == (3, 1, 2)
    assert r["avg_session_duration"] == 60.0
    assert r["bounce_rate"] == pytest.approx(75.0)


@pytest.mark.parametrize("threshold", ["10m", "-1"])  # broadcast and shuffled history check
def test_return_visitors_equals_exists(spark, broadcast_threshold, threshold):
    """Rewrite equivalence on a random table with ties and NULLs: per-visitor form vs EXISTS."""
    import random

    broadcast_threshold(threshold)

    rnd = random.Random(7)
    rows = []
    for i in range(400):
        v = f"v{rnd.randrange(40)}" if rnd.random() > 0.05 else None
        t = None if rnd.random() < 0.05 else datetime(2024, 1, rnd.randrange(20, 32),
                                                      rnd.randrange(0, 24), rnd.choice([0, 30]))
        rows.append((i, v, f"s{i}", t, None, 1, None, None, None))
    s = sessions_df(spark, rows)
    s.createOrReplaceTempView("s_rand")
    for period in ("24h", "7d", "all", ("2024-01-25", "2024-01-28 12:00:00")):
        start, end = period if isinstance(period, tuple) else (None, None)
        pred = time_filter("started_at", period, start, end, AS_OF)
        ref = (spark.table("s_rand").alias("s1").where(pred)
               .join(spark.table("s_rand").alias("s2"),
                     (F.col("s1.visitor_id") == F.col("s2.visitor_id"))
                     & (F.col("s2.started_at") < F.col("s1.started_at")), "left_semi")
               .agg(F.count_distinct("visitor_id").alias("n")))
        n = one(ref)["n"]
        assert one(M.return_visitors(s, period, AS_OF, start, end))["return_visitors"] == n
        kpi = one(M.kpi_row(s, pv_df(spark, []), period, AS_OF, start, end))
        assert kpi["return_visitors"] == n
        total = one(M.total_visitors(s, period, AS_OF, start, end))["total_visitors"]
        assert kpi["total_visitors"] == total
        assert one(M.new_visitors(s, period, AS_OF, start, end))["new_visitors"] == total - n


def test_daily_trends_dates_and_zero(spark):
    s = sessions_df(spark, [(1, "a", "s1", ts("2024-01-30 10:00:00"), None, 1, None, None, None),
                            (2, "a", "s2", ts("2024-01-31 10:00:00"), None, 1, None, None, None)])
    pv = pv_df(spark, [(1, "s1", "a", "/", ts("2024-01-30 09:00:00")),   # before the session
                       (2, "x", "a", "/", ts("2024-01-29 09:00:00"))])  # date without a session
    rows = {r["date"].isoformat(): r["page_views_count"] for r in
            M.daily_trends(s, pv, AS_OF).collect()}
    assert rows == {"2024-01-30": 1, "2024-01-31": 0}


# --- pages ------------------------------------------------------------------------------------

def test_entry_exit_ties_and_nulls(spark):
    pv = pv_df(spark, [
        (1, "s1", "a", "/a", ts("2024-01-31 10:00:00")),
        (2, "s1", "a", "/b", ts("2024-01-31 10:00:00")),   # tied first view
        (3, "s1", "a", "/c", ts("2024-01-31 10:05:00")),
        (4, "s2", "b", "/a", None),                        # NULL time
    ])
    entries = {r["page_path"]: r["entries"] for r in P.entry_pages(pv, "all", AS_OF).collect()}
    exits = {r["page_path"]: r["exits"] for r in P.exit_pages(pv, "all", AS_OF).collect()}
    assert entries == {"/a": 1, "/b": 1}
    assert exits == {"/c": 1}
    assert one(M.total_page_views(pv, "all", AS_OF))["total_page_views"] == 4


def test_bounce_rate_over_100_and_orphans(spark):
    s = sessions_df(spark, [(1, "a", "s1", ts("2024-01-31 10:00:00"), None, 1, None, None, None)])
    pv = pv_df(spark, [(1, "s1", "a", "/a", ts("2024-01-31 10:00:00")),
                       (2, "s1", "a", "/a", ts("2024-01-31 10:01:00")),
                       (3, "gone", "a", "/a", ts("2024-01-31 10:02:00"))])  # no such session
    r = one(P.top_pages_bounce(pv, s, "all", AS_OF))
    assert (r["views"], r["sessions"], r["bounce_rate"]) == (2, 1, 200.0)


# --- visitor reports --------------------------------------------------------------------------

DET_SCHEMA = "id long, visitor_id string, country string, city string, browser string, " \
             "device_type string, os string, updated_at timestamp_ntz"


def test_recent_visitors_fanout(spark):
    v = spark.createDataFrame([("a", "1.1.1.1", ts("2024-01-31 10:00:00")),
                               ("b", "1.1.1.2", ts("2024-01-31 11:00:00")),
                               ("c", "1.1.1.3", ts("2024-01-31 09:00:00"))],
                              "visitor_id string, ip_address string, last_seen timestamp_ntz")
    d = spark.createDataFrame([(1, "a", "FR", "Paris", "Chrome", "desktop", "Windows", ts("2024-01-30 00:00:00")),
                               (2, "a", "DE", "Berlin", "Chrome", "desktop", "Windows", ts("2024-01-31 00:00:00")),
                               (3, "a", "DE", "Bonn", "Chrome", "desktop", "Windows", ts("2024-01-31 00:00:00")),
                               (4, "b", "US", None, "Safari", "mobile", "iOS", ts("2024-01-31 00:00:00"))],
                              DET_SCHEMA)
    s = sessions_df(spark, [(1, "a", "s1", ts("2024-01-31 10:00:00"), None, 2, None, None, None),
                            (2, "a", "s2", ts("2024-01-31 10:30:00"), None, 3, None, None, None),
                            (3, "c", "s3", ts("2024-01-31 08:00:00"), None, 1, None, None, None)])
    rows = {r["visitor_id"]: r for r in PE.recent_visitors(v, d, s).collect()}
    assert rows["a"]["session_count"] == 2 and rows["a"]["total_page_views"] == 15  # (2+3) × 3
    assert rows["a"]["city"] == "Bonn"  # latest by (updated_at, id)
    assert rows["b"]["session_count"] == 0 and rows["b"]["total_page_views"] is None
    assert rows["c"]["country"] is None and rows["c"]["total_page_views"] == 1
    deduped = {r["visitor_id"]: r for r in PE.recent_visitors(v, d, s, dedupe=True).collect()}
    assert deduped["a"]["total_page_views"] == 5
    order = [r["visitor_id"] for r in PE.recent_visitors(v, d, s, limit="2").collect()]
    assert order == ["b", "a"]


def test_realtime_feed_equals_plain_join(spark):
    """Exact fan-out cut vs the plain three-way join, including a visitor with many details
    and a page view whose visitor is unknown."""
    import random

    rnd = random.Random(3)
    pv_rows = [(i, f"s{i % 5}", f"v{rnd.randrange(6)}", f"/p{i % 4}",
                datetime(2024, 1, 31, 11, 56 + rnd.randrange(4), rnd.randrange(60)))
               for i in range(60)]
    pv = pv_df(spark, pv_rows)
    v = spark.createDataFrame([(f"v{k}",) for k in range(5)], "visitor_id string")  # no v5
    det_rows = [(j, f"v{rnd.randrange(5)}", "C", "X", "B", "desktop", "O", ts("2024-01-31 00:00:00"))
                for j in range(300)]
    d = spark.createDataFrame(det_rows, DET_SCHEMA)
    for n in (5, 50, 500):
        got = [tuple(r) for r in PE.realtime_feed(pv, v, d, AS_OF, n=n).collect()]
        pv.createOrReplaceTempView("p")
        v.createOrReplaceTempView("v")
        d.createOrReplaceTempView("d")
        want = [tuple(r) for r in spark.sql(f"""
            SELECT v.visitor_id, d.country, d.city, d.browser, d.device_type, p.page_path, p.viewed_at
            FROM p JOIN v ON p.visitor_id = v.visitor_id LEFT JOIN d ON v.visitor_id = d.visitor_id
            WHERE p.viewed_at >= TIMESTAMP_NTZ '2024-01-31 11:55:01'
            ORDER BY p.viewed_at DESC, p.id, d.id NULLS FIRST LIMIT {n}""").collect()]
        assert got == want


def test_parse_limit():
    assert parse_limit(None) == 50
    assert parse_limit("0") == 50
    assert parse_limit("abc") == 50
    assert parse_limit("12abc") == 12
    assert parse_limit(" 7") == 7
    assert parse_limit("-1") is None
    assert parse_limit("0x10") == 16


# --- enrichment -------------------------------------------------------------------------------

def _eval(spark, col_fn, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(col_fn(F.col("x"))).collect()]


def test_referrer_domain(spark):
    cases = {
        "": None, "   ": None, "not a url": None, "about:blank": "", "//host.com/x": None,
        "https://Example.COM:8080/p?q=1": "example.com", "http://u:p@h.org/": "h.org",
        "https://[2001:DB8::1]/": "[2001:db8::1]", "https://a.b/c d|e": "a.b",
        "https://exa mple.com/": None, "HTTPS://WWW.GOOGLE.COM": "www.google.com",
    }
    got = _eval(spark, E.referrer_domain, list(cases))
    assert dict(zip(cases, got)) == cases


def test_referrer_source(spark):
    cases = {"netflix.com": "Twitter/X", "x.com": "Twitter/X", "t.co": "t.co",
             "WWW.GOOGLE.COM": "Google", "": "Direct", None: "Direct",
             "www.LinkedIn.com": "LinkedIn", "example.org": "example.org"}
    got = _eval(spark, E.referrer_source, list(cases))
    assert dict(zip(cases, got)) == cases


def test_device_type_and_local_ip(spark):
    fams = {"Spider": "desktop", "Other": "desktop", "iPhone": "mobile",
            "Generic Smartphone": "mobile", "iPad": "tablet", "Samsung SM-G991B": "desktop",
            "Mobile Tablet": "mobile"}
    assert dict(zip(fams, _eval(spark, E.device_type, list(fams)))) == fams
    ips = {"127.0.0.1": True, "::1": True, "10.1.2.3": True, "192.168.0.1": True,
           "172.16.0.1": False, "::ffff:10.0.0.1": False}
    assert dict(zip(ips, _eval(spark, E.is_local_ip, list(ips)))) == ips


def test_user_agent_families(spark):
    from webtraffic.sources.hits import USER_AGENT_EXPECTED, USER_AGENTS

    df = spark.createDataFrame([(u,) for u in USER_AGENTS], "ua string")
    got = [(r["p"]["browser"], r["p"]["os"], r["d"]) for r in df.select(
        parse_user_agent(F.col("ua")).alias("p"),
        E.device_type(parse_user_agent(F.col("ua"))["device"]).alias("d")).collect()]
    assert got == USER_AGENT_EXPECTED


@pytest.mark.parametrize("broadcast", [True, False])
def test_geo_range_across_blocks(spark, broadcast):
    ranges = spark.createDataFrame([(1 * 16777216 + 65000, 1 * 16777216 + 70000, "AA", "R", "C")],
                                   GEO_RANGES)
    ips = ["1.0.253.232", "1.1.17.112", "1.1.17.113", "1.0.253.231", "127.0.0.1", "bad", None]
    hits = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "hit_id long, ip string")
    got = {r["ip"]: r["geo_country"] for r in with_geo(hits, ranges, broadcast=broadcast).collect()}
    assert got == {"1.0.253.232": "AA", "1.1.17.112": "AA", "1.1.17.113": None,
                   "1.0.253.231": None, "127.0.0.1": None, "bad": None, None: None}
    assert _eval(spark, ipv4_to_long, ["0.0.0.1", "256.1.1.1", "::ffff:1.2.3.4"]) == [1, None, 16909060]


def test_odd_addresses(spark):
    odd = [" 1.2.3.4 ", "1.2.3.4\n", "1.2.3.4\r\n", "1.2.3.4\n\n", "1.2\n.3.4", "1.2.3", "1.2.3.4.5", "::ffff:::ffff:1.2.3.4", "::ffff:", "001.2.3.004", "1.2.3.1000", ""]
    four = 16909060
    assert _eval(spark, ipv4_to_long, odd) == [four, four, four, None, None, None, None, None, None, four, None, None]


# --- ingest -----------------------------------------------------------------------------------

def _hit(i, v, s, t, typ="pageview", path="/x", ref=None, width=1, lang="en", ip="8.8.8.8"):
    return (v, s, None, typ, (path, "T", ref), ("UA", lang), (width, 2), ip, None, None,
            ts(t), i)


def test_validation_and_defaults(spark):
    raw = spark.createDataFrame([
        _hit(1, None, "s", "2024-01-31 10:00:00"),
        _hit(2, "", "s", "2024-01-31 10:00:00"),
        _hit(3, "v", None, "2024-01-31 10:00:00"),
        _hit(4, "v", "", "2024-01-31 10:00:00"),
        _hit(5, "v", "s", "2024-01-31 10:00:00", path="", width=0, lang=""),
    ], HIT)
    valid, rejected = normalize_hits(raw)
    reasons = {r["hit_id"]: r["reject_reason"] for r in rejected.collect()}
    assert reasons == {1: "visitorId is required", 2: "visitorId is required",
                       3: "sessionId is required", 4: "sessionId is required"}
    r = one(valid)
    assert (r["page_path"], r["screen_width"], r["language"]) == ("/", None, None)


def test_first_hit_wins(spark):
    raw = spark.createDataFrame([
        _hit(2, "v1", "s", "2024-01-31 10:00:00", ref=None, ip="1.1.1.1"),
        _hit(1, "v2", "s", "2024-01-31 10:00:00", ref="https://b.com/", ip="2.2.2.2"),  # tie → id 1
        _hit(3, "v1", "s", "2024-01-31 09:00:00", typ="click", ref="https://a.com/", ip="3.3.3.3"),
        _hit(4, "v1", "s", "2024-01-31 11:00:00", ref="https://c.com/"),
    ], HIT)
    valid, _ = normalize_hits(raw)
    s = one(derive_sessions(valid))
    assert (s["visitor_id"], s["referrer_domain"], s["page_views"]) == ("v1", "a.com", 4)
    v = {r["visitor_id"]: r for r in derive_visitors(valid).collect()}
    assert v["v1"]["ip_address"] == "3.3.3.3"
    assert v["v1"]["last_seen"] == ts("2024-01-31 11:00:00")
    # A NULL first referrer is kept, not skipped for a later one.
    raw2 = spark.createDataFrame([_hit(1, "v", "s", "2024-01-31 10:00:00", ref=None),
                                  _hit(2, "v", "s", "2024-01-31 10:01:00", ref="https://a.com/")],
                                 HIT)
    assert one(derive_sessions(normalize_hits(raw2)[0]))["referrer"] is None


def test_breakdown_ignores_nulls_and_counts_distinct(spark):
    d = spark.createDataFrame([(1, "a", "FR", None, "Chrome", "desktop", "Windows", None),
                               (2, "a", "FR", None, "Chrome", "desktop", "Windows", None),
                               (3, "b", None, None, "Chrome", "mobile", "iOS", None)], DET_SCHEMA)
    assert [tuple(r) for r in A.top_countries_basic(d).collect()] == [("FR", 1)]
    assert [tuple(r) for r in A.top_browsers(d).collect()] == [("Chrome", 2)]
