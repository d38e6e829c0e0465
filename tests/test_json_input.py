"""JSON payloads as browsers and collectors send them, and documents as the service returns them."""

import json
from datetime import datetime, timedelta, timezone

import pytest

from webtraffic.functions.period import to_datetime
from webtraffic.operators.ingest import TIME_REQUIRED, ingest, normalize_hits
from webtraffic.plans import report as R
from webtraffic.schema import TABLE_SCHEMAS
from webtraffic.sources.hits import instant, read_hits
from webtraffic.sources.tables import Tables, load_tables, write_tables
from webtraffic.streaming.live import ingest_stream, read_hits_stream, stream_append

TIMES = [
    ("2024-01-10T10:00:00.000Z", datetime(2024, 1, 10, 10)),
    ("2024-01-10T10:00:00+02:00", datetime(2024, 1, 10, 8)),
    ("2024-01-10 10:00:00.5-0530", datetime(2024, 1, 10, 15, 30, 0, 500000)),
    ("2024-01-10T10:00", datetime(2024, 1, 10, 10)),
    ("2024-01-10", datetime(2024, 1, 10)),
    ("2024-02-30T00:00:00Z", None),
    ("1704880800000", None),
    ("soon", None),
    (None, None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_instants_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TIMES)], "i int, t string")
        got = {r.i: r.u for r in rows.select("i", instant("t").alias("u")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {i: u for i, (_, u) in enumerate(TIMES)}


def _hits(tmp_path):
    hit = lambda i, **kw: {"visitorId": "v", "sessionId": "s", "type": "pageview", "hit_id": i, "received_at": "2024-01-10T10:00:00Z", "ip": "1.2.3.4"} | kw
    rows = [
        hit(1, screen={"width": 1536.0, "height": 864}), hit(2, received_at="2024-01-10T12:30:00+02:00"),
        hit(3, received_at="later"), hit(4, visitorId=0), hit(5, visitorId="0"), hit(6, sessionId=12),
        hit(7, visitorId=""), hit(8, sessionId=None), hit(9, received_at=None),
    ]
    path = tmp_path / "hits"
    path.mkdir()
    (path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    return str(path)


def test_no_hit_without_a_time_is_taken(spark, tmp_path):
    valid, rejected = normalize_hits(read_hits(spark, _hits(tmp_path)))
    got = {r.hit_id: r for r in valid.collect()}
    assert set(got) == {1, 2, 5, 6}
    assert got[1].screen_width == 1536 and got[2].received_at == datetime(2024, 1, 10, 10, 30)
    why = {r.hit_id: r.reject_reason for r in rejected.collect()}
    assert why[3] == why[9] == TIME_REQUIRED and set(why) == {3, 4, 7, 8, 9}


def test_the_stream_reads_the_same_hits(spark, tmp_path):
    out = str(tmp_path / "out")
    valid = ingest_stream(read_hits_stream(spark, _hits(tmp_path)))
    for q in stream_append(valid, out, str(tmp_path / "ck")):
        q.awaitTermination()
    got = spark.read.parquet(f"{out}/page_views").collect()
    assert {r.id for r in got} == {1, 2, 5, 6} and all(r.viewed_at for r in got)


def test_a_site_without_events_loads(spark, tmp_path):
    tables, _ = ingest(read_hits(spark, _hits(tmp_path)))
    out = str(tmp_path / "tables")
    write_tables(tables, out)
    t = load_tables(spark, out, as_of="2024-01-10T23:00:00Z")
    assert t.events.count() == 0 and t.page_views.count() == 4
    doc = json.loads(R.report_json(R.enhanced_stats(t, period="7d")).first().json)
    assert doc["totalSessions"] == 2
    R.write_report(R.enhanced_stats(t, period="7d"), str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report" / "report.json")).first().value) == doc


def test_a_report_needs_its_instant(spark):
    with pytest.raises(ValueError, match="as_of"):
        R.enhanced_stats(Tables())


def test_documents_keep_null_fields(spark):
    details = spark.createDataFrame(
        [(1, "v", None, None, "Paris", datetime(2024, 1, 10))],
        "id long, visitor_id string, country string, country_code string, city string, updated_at timestamp_ntz",
    )
    from webtraffic.operators import audience as A
    from webtraffic.schema import conform

    d = conform(details, TABLE_SCHEMAS["visitor_details"])
    doc = json.loads(R.report_json({"topCities": A.top_cities(d)}, ["topCities"]).first().json)
    assert doc == {"topCities": [{"city": "Paris", "country": None, "visitors": 1}]}


def test_realtime_and_visitors_documents(spark):
    feed = spark.createDataFrame(
        [("a", None, datetime(2024, 1, 1, 1)), ("b", "x", datetime(2024, 1, 1, 2))],
        "visitor_id string, country string, viewed_at timestamp_ntz",
    )
    doc = json.loads(R.realtime_json(feed).first().json)
    assert doc["count"] == 2 and [v["visitor_id"] for v in doc["visitors"]] == ["b", "a"]
    assert doc["visitors"][1]["country"] is None
    assert json.loads(R.realtime_json(feed.limit(0)).first().json) == {"count": 0, "visitors": []}
    lines = [json.loads(r.json) for r in R.visitors_json_lines(feed).collect()]
    assert [x["visitor_id"] for x in lines] == ["a", "b"] and lines[0]["country"] is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-01-10T00:00:00+02:00", datetime(2024, 1, 9, 22)), ("2024-01-10 00:00-05:30", datetime(2024, 1, 10, 5, 30)),
        ("2024-01-10T00:00:00Z", datetime(2024, 1, 10)), ("2024-02-30", datetime(2024, 3, 1)),
        ("2024-01-10 24:00", datetime(2024, 1, 11)), ("20240110", None), ("now", None), ("2460320.5", None),
        ("2024-13-01", None), ("2024-01-10 10:00:00.25", datetime(2024, 1, 10, 10, 0, 0, 250000)),
    ],
)
def test_bounds(text, want):
    assert to_datetime(text) == want


def test_aware_bounds_become_utc():
    assert to_datetime(datetime(2024, 1, 10, tzinfo=timezone(timedelta(hours=2)))) == datetime(2024, 1, 9, 22)


def test_realtime_document_keeps_the_feeds_order_on_ties(spark):
    from webtraffic.operators import people as PE

    now = datetime(2024, 1, 1, 12)
    views = spark.createDataFrame([(2, "v", "/b", now), (1, "v", "/a", now)], "id long, visitor_id string, page_path string, viewed_at timestamp_ntz")
    details = spark.createDataFrame(
        [(1, "v", "Z", now), (2, "v", "A", now)], "id long, visitor_id string, country string, updated_at timestamp_ntz")
    from webtraffic.schema import conform

    views, details = conform(views, TABLE_SCHEMAS["page_views"]), conform(details, TABLE_SCHEMAS["visitor_details"])
    feed = PE.realtime_feed(views, views.select("visitor_id").distinct(), details, now, ranked=True)
    doc = json.loads(R.realtime_json(feed).first().json)
    assert [(v["page_path"], v["country"]) for v in doc["visitors"]] == [("/a", "Z"), ("/a", "A"), ("/b", "Z"), ("/b", "A")]
    assert doc["count"] == 4 and "feed_rank" not in doc["visitors"][0]
