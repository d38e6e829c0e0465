"""Streaming: many micro-batches and a restart end in the batch state; duplicates and late
hits follow the watermark."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from conftest import SF_SMALL
from webtraffic.operators.ingest import derive_sessions, derive_visitors, normalize_hits
from webtraffic.schema import HIT, SESSIONS, VISITORS
from webtraffic.sources.hits import fixture_raw_hits
from webtraffic.streaming import live as L


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _write_parts(raw, out, parts):
    """Split the hits into ``parts`` JSON files, oldest first."""
    raw = raw.withColumn("_part", F.ntile(parts).over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("received_at", "hit_id")))
    for k in range(1, parts + 1):
        raw.where(F.col("_part") == k).drop("_part").coalesce(1).write.json(f"{out}/part{k:02d}")


def test_sessions_and_visitors_over_batches_and_restart(spark, tmp_dir):
    raw = fixture_raw_hits(spark, SF_SMALL)
    src = os.path.join(tmp_dir, "src")
    _write_parts(raw, src, 4)
    incoming = os.path.join(tmp_dir, "incoming")
    os.makedirs(incoming)
    ck_s, ck_v = os.path.join(tmp_dir, "ck_s"), os.path.join(tmp_dir, "ck_v")
    out_s, out_v = os.path.join(tmp_dir, "sessions"), os.path.join(tmp_dir, "visitors")

    def run():
        hits = L.read_hits_stream(spark, incoming, max_files_per_trigger=1)
        valid = L.ingest_stream(hits)
        # Sessions fold a snapshot every second batch; visitors keep every batch.
        for q in (L.versioned_sink(L.stream_sessions(valid), out_s, ck_s,
                                   key="session_id", compact_every=2),
                  L.versioned_sink(L.stream_visitors(valid), out_v, ck_v)):
            q.awaitTermination()
            assert q.exception() is None

    def move(k):  # make part k visible to the stream
        part = os.path.join(src, f"part{k:02d}")
        for f in os.listdir(part):
            if f.endswith(".json"):
                os.link(os.path.join(part, f), os.path.join(incoming, f"{k:02d}-{f}"))

    move(1)
    move(2)
    run()                       # two micro-batches
    move(3)
    move(4)
    run()                       # restart from the checkpoints: two more
    assert len(os.listdir(out_s)) >= 4
    assert (L._latest_snapshot(spark, out_s) or 0) >= 2  # state read from a snapshot

    valid, _ = normalize_hits(spark.read.schema(HIT).json(incoming))
    cols_s = SESSIONS.fieldNames()
    cols_v = VISITORS.fieldNames()
    assert _rows(L.read_latest(spark, out_s, "session_id", SESSIONS), cols_s) == \
        _rows(derive_sessions(valid), cols_s)
    assert _rows(L.read_latest(spark, out_v, "visitor_id", VISITORS), cols_v) == \
        _rows(derive_visitors(valid), cols_v)


def _hit_rows(spark, rows):
    return spark.createDataFrame(
        [("v", f"s{sid}", None, "pageview", ("/", "", None), ("", None), (1, 1), "1.1.1.1", None,
          None, datetime.fromisoformat(t), hid) for hid, sid, t in rows], HIT)


def test_dedupe_and_late_hits(spark, tmp_dir):
    inc = os.path.join(tmp_dir, "in")
    # Batch 0: hits 1-3 (the watermark moves to 10:30); batch 1: hit 2 re-sent and an on-time
    # hit; batch 2: a hit 35 minutes behind. Spark judges lateness by the previous batch's
    # watermark, so the late hit is dropped from batch 2 on.
    parts = {"a": [(1, 1, "2024-01-31 10:00:00"), (2, 1, "2024-01-31 10:01:00"),
                   (3, 2, "2024-01-31 10:40:00")],
             "b": [(2, 1, "2024-01-31 10:01:00"), (5, 2, "2024-01-31 10:41:00")],
             "c": [(4, 3, "2024-01-31 10:05:00")]}
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    for sub, rows in parts.items():
        _hit_rows(spark, rows).coalesce(1).write.json(f"{inc}/{sub}")
        for f in os.listdir(f"{inc}/{sub}"):
            if f.endswith(".json"):
                os.link(f"{inc}/{sub}/{f}", f"{src}/{sub}-{f}")

    hits = L.read_hits_stream(spark, src, max_files_per_trigger=1)
    valid = L.ingest_stream(L.dedupe_hits(hits))
    pv = valid.where(F.col("type") == "pageview")
    out, ck = os.path.join(tmp_dir, "pairs"), os.path.join(tmp_dir, "ck")
    q = L.versioned_sink(L.stream_active_sessions(pv), out, ck)
    q.awaitTermination()
    assert q.exception() is None
    res = L.active_sessions_by_window(spark, out)
    sessions = {r["session_id"] for r in spark.read.parquet(out).collect()}
    # The re-sent hit 2 is not counted twice; the late hit (session s3) is dropped.
    assert sessions == {"s1", "s2"}
    views = spark.read.parquet(out).groupBy("session_id").agg(F.max("views").alias("v"))
    assert {r["session_id"]: r["v"] for r in views.collect()}["s1"] == 2
    assert res.count() > 0


def test_realtime_feed_over_batches_out_of_order(spark, tmp_dir):
    """The live feed after several micro-batches equals the batch feed at the newest view,
    also when a later batch carries older views than an earlier one (other dates included)."""
    from webtraffic.operators.people import realtime_feed

    pv_schema = "id long, session_id string, visitor_id string, page_path string, " \
                "viewed_at timestamp_ntz"
    views = [  # batch order: newest day first, then an older day, then more of the newest
        [(1, "s1", "v1", "/a", "2024-01-31 11:58:00"), (2, "s2", "v2", "/b", "2024-01-31 11:59:30")],
        [(3, "s3", "v1", "/c", "2024-01-30 23:59:00"), (4, "s4", "v3", "/d", "2024-01-31 11:56:00")],
        [(5, "s1", "v1", "/e", "2024-01-31 11:57:00"), (6, "s5", "v4", "/f", "2024-01-31 11:50:00")],
    ]
    src = os.path.join(tmp_dir, "pv")
    for k, rows in enumerate(views):
        df = spark.createDataFrame([(i, s, v, p, datetime.fromisoformat(t)) for i, s, v, p, t in rows],
                                   pv_schema)
        df.coalesce(1).write.parquet(f"{src}/part{k}")
    visitors = spark.createDataFrame([(f"v{i}",) for i in range(1, 5)], "visitor_id string")
    details = spark.createDataFrame(
        [(10, "v1", "FR", "Paris", "Chrome", "desktop"), (11, "v1", "FR", "Lyon", "Chrome", "mobile"),
         (12, "v2", "DE", None, "Firefox", "desktop")],
        "id long, visitor_id string, country string, city string, browser string, device_type string")
    stream = (spark.readStream.schema(pv_schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out, ck = os.path.join(tmp_dir, "feed"), os.path.join(tmp_dir, "ck")
    q = L.realtime_sink(stream, visitors, details, out, ck)
    q.awaitTermination()
    assert q.exception() is None
    got = L.read_feed(spark, out)
    allv = spark.createDataFrame(
        [(i, s, v, p, datetime.fromisoformat(t)) for rows in views for i, s, v, p, t in rows], pv_schema)
    exp = realtime_feed(allv, visitors, details, datetime(2024, 1, 31, 11, 59, 30))
    cols = ["visitor_id", "country", "city", "browser", "device_type", "page_path", "viewed_at"]
    assert _rows(got, cols) == _rows(exp, cols)
    assert got.count() == 6  # views within five minutes of 11:59:30, with v1's two detail rows


def test_read_latest_skips_incomplete_snapshot(spark, tmp_dir):
    out = os.path.join(tmp_dir, "versions")
    rows = {0: [("a", 1), ("b", 1)], 1: [("a", 2)], 2: [("b", 3)], 3: [("c", 4)]}
    for b, rs in rows.items():
        spark.createDataFrame(rs, "k string, v long").write.parquet(f"{out}/batch_id={b}")
    # A complete snapshot at batch 1, and one at batch 2 whose write never finished.
    spark.createDataFrame([("a", 2), ("b", 1)], "k string, v long") \
        .write.parquet(f"{out}/{L.SNAPSHOTS}/batch_id=1")
    spark.createDataFrame([("a", 99)], "k string, v long") \
        .write.parquet(f"{out}/{L.SNAPSHOTS}/batch_id=2")
    os.remove(os.path.join(out, L.SNAPSHOTS, "batch_id=2", "_SUCCESS"))
    assert L._latest_snapshot(spark, out) == 1
    got = sorted(tuple(r) for r in L.read_latest(spark, out, "k").select("k", "v").collect())
    assert got == [("a", 2), ("b", 3), ("c", 4)]


def test_snapshots_do_not_rewrite_the_state_over_and_over(spark, tmp_dir):
    """Folds wait until the batches after the last one hold as much; a replay of a folded batch changes nothing."""
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("src", "out", "ck"))

    def add(*parts):
        for k in parts:
            keys = spark.range(k * 5000, (k + 1) * 5000, numPartitions=1).select(F.md5(F.col("id").cast("string")).alias("k"))
            keys.write.mode("append").parquet(src)

    def run():
        rows = spark.readStream.schema("k string").option("maxFilesPerTrigger", 1).parquet(src)
        q = L.versioned_sink(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), out, ck, key="k", compact_every=2)
        q.awaitTermination()
        assert q.exception() is None

    def snapshots():
        return sorted(int(n.split("=")[1]) for n in os.listdir(os.path.join(out, L.SNAPSHOTS)) if n.startswith("batch_id="))

    add(*range(7))
    run()
    assert snapshots() == [2, 6]
    for name in ("6", ".6.crc"):  # the stream ended after the last batch's snapshot and before its commit
        if os.path.exists(os.path.join(ck, "commits", name)):
            os.remove(os.path.join(ck, "commits", name))
    run()
    add(7, 8)
    run()
    assert snapshots() == [2, 6]
    got = L.read_latest(spark, out, "k")
    assert (got.count(), got.distinct().count(), got.agg(F.sum("n")).first()[0]) == (45000, 45000, 45000)
