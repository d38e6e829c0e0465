"""Structured Streaming forms of ingest and the live views.

Time is the collector's arrival time, so ``received_at`` is the event time; it is cast to
``timestamp`` for the watermark (a watermark on ``timestamp_ntz`` is refused). Keyed state:

* visitors / sessions (T03/T04) are get-or-create aggregates with no time key, so their state
  lives as long as the keys do — use the RocksDB state store provider at scale;
* the live window (T05) and the duplicate guard (T07) are bounded by the watermark.

Sinks are exactly-once: the Parquet file sink keeps its own commit log, and every
``foreachBatch`` writer overwrites a ``batch_id=N`` directory, so a replayed batch after a
failure rewrites the same output. Readers take the latest version per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import (derive_page_views, derive_sessions, derive_visitor_details,
                                derive_visitors, normalize_hits)
from ..operators.people import realtime_feed, realtime_feed_maintained
from ..schema import HIT, JSON_HIT, SESSIONS, VISITORS, conform
from ..sources.hits import from_payload

EVENT_TIME = "event_time"
WATERMARK = "10 minutes"
LIVE_WINDOW = "5 minutes"
LIVE_SLIDE = "1 minute"
BATCH_COL = "batch_id"
COMPACT_EVERY = 10  # batches between state snapshots of the keyed update sinks


def with_event_time(hits: DataFrame, watermark: str | None = WATERMARK) -> DataFrame:
    df = hits.withColumn(EVENT_TIME, F.col("received_at").cast("timestamp"))
    return df.withWatermark(EVENT_TIME, watermark) if watermark else df


def read_hits_stream(spark: SparkSession, path: str, fmt: str = "json", schema=None,
                     max_files_per_trigger: int | None = None,
                     watermark: str | None = WATERMARK) -> DataFrame:
    """A streaming hit source with a declared schema and an event-time watermark.

    JSON payloads are read like :func:`webtraffic.sources.hits.read_hits` reads them; other formats
    hold typed hits (``schema``, by default ``HIT``).
    """
    payload = fmt == "json" and schema is None
    r = spark.readStream.schema(JSON_HIT if payload else schema or HIT).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    hits = r.load(path)
    return with_event_time(from_payload(hits) if payload else hits, watermark)


def dedupe_hits(hits: DataFrame, key: str = "hit_id") -> DataFrame:
    """Drop a re-sent hit (same id) seen again within the watermark delay."""
    return hits.dropDuplicatesWithinWatermark([key])


def stream_visitors(valid: DataFrame) -> DataFrame:
    """Per-visitor get-or-create aggregate (emit in update mode), as in batch."""
    return derive_visitors(valid)


def stream_sessions(valid: DataFrame, count_from: int = 1) -> DataFrame:
    """Per-session get-or-create aggregate and page-view counter (update mode), as in batch."""
    return derive_sessions(valid, count_from)


SNAPSHOTS = "_snapshots"


def versioned_sink(agg: DataFrame, out_dir: str, checkpoint: str,
                   trigger: dict | None = None, key: str | None = None,
                   compact_every: int | None = None) -> StreamingQuery:
    """Update-mode aggregate → ``out_dir/batch_id=N`` per micro-batch (idempotent overwrite).

    With ``key`` and ``compact_every``, every ``compact_every``-th batch may also fold the state
    so far into ``out_dir/_snapshots/batch_id=N``, so :func:`read_latest` reads one snapshot
    plus the batches after it instead of every batch since the stream began (older batch
    directories can then be removed by housekeeping). It does so once the batches after the last
    snapshot hold as much as that one: all snapshots together then come to at most twice what
    the batches wrote, however many there are, and a reader reads at most about twice the state.
    A replayed batch rewrites its snapshot if that is not complete.
    """
    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out_dir}/{BATCH_COL}={batch_id}")
        due = key and compact_every and batch_id > 0 and batch_id % compact_every == 0
        if due and _worth_folding(batch.sparkSession, out_dir, batch_id):
            state = read_latest(batch.sparkSession, out_dir, key)
            state.write.mode("overwrite").parquet(f"{out_dir}/{SNAPSHOTS}/{BATCH_COL}={batch_id}")

    return (agg.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _worth_folding(spark: SparkSession, out_dir: str, batch_id: int) -> bool:
    """Whether the batches after the newest snapshot, up to this one, hold as many bytes as it does."""
    snap = _latest_snapshot(spark, out_dir)
    if snap is None or snap >= batch_id:
        return snap is None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(out_dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = lambda p: fs.getContentSummary(p).getLength()
    least, later = size(path(f"{out_dir}/{SNAPSHOTS}/{BATCH_COL}={snap}")), 0
    for st in fs.listStatus(path(out_dir)):
        name = st.getPath().getName()
        if name.startswith(f"{BATCH_COL}=") and snap < int(name.split("=", 1)[1]) <= batch_id:
            later += size(st.getPath())
    return later >= least


def _latest_snapshot(spark: SparkSession, out_dir: str) -> int | None:
    """The newest complete snapshot's batch id (its write committed a ``_SUCCESS`` marker).

    A directory listing on the driver through the cluster's file system API, as Spark's own
    file index does; no data is read.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{out_dir}/{SNAPSHOTS}")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    best = None
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if not (st.isDirectory() and name.startswith(f"{BATCH_COL}=")):
            continue
        n = int(name.split("=", 1)[1])
        done = fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))
        if done and (best is None or n > best):
            best = n
    return best


def read_latest(spark: SparkSession, out_dir: str, key: str, schema=None) -> DataFrame:
    """Current state of a versioned sink: each key's row from its newest batch.

    Starts from the newest complete snapshot, if any, and reads only later batches (pruned
    on ``batch_id``). ``max_by`` per key is combined map-side, so a key updated in every
    batch costs one partial row per map task.
    """
    df = spark.read.parquet(out_dir)
    snap = _latest_snapshot(spark, out_dir)
    if snap is not None:
        base = (spark.read.parquet(f"{out_dir}/{SNAPSHOTS}/{BATCH_COL}={snap}")
                .withColumn(BATCH_COL, F.lit(snap).cast(dict(df.dtypes)[BATCH_COL])))
        df = df.where(F.col(BATCH_COL) > snap).unionByName(base)
    cols = [c for c in df.columns if c not in (key, BATCH_COL)]
    latest = (df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(BATCH_COL)).alias("_r"))
              .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]))
    return conform(latest, schema) if schema is not None else latest


def stream_append(valid: DataFrame, out_dir: str, checkpoint: str, geo_ranges=None,
                  trigger: dict | None = None,
                  spread_partitions: int | None = None) -> list[StreamingQuery]:
    """Append page views and visitor details as they arrive (stateless; the geo ranges
    join is a stream-static join against a broadcast, size-checked range table).

    ``spread_partitions`` round-robins each micro-batch before the per-row enrichment, for a
    source whose batches arrive in fewer splits than there are cores (a source with many
    partitions, such as a partitioned topic, needs no extra shuffle)."""
    trig = trigger or {"availableNow": True}
    pv = derive_page_views(valid).withColumn("dt", F.to_date("viewed_at"))
    enrich_in = valid.repartition(spread_partitions) if spread_partitions else valid
    det = derive_visitor_details(enrich_in, geo_ranges).withColumn("dt", F.to_date("updated_at"))
    out = []
    for name, df in (("page_views", pv), ("visitor_details", det)):
        out.append(df.writeStream.format("parquet").outputMode("append")
                   .partitionBy("dt")
                   .option("checkpointLocation", f"{checkpoint}/{name}")
                   .trigger(**trig).start(f"{out_dir}/{name}"))
    return out


def stream_active_sessions(page_view_hits: DataFrame, window: str = LIVE_WINDOW,
                           slide: str = LIVE_SLIDE) -> DataFrame:
    """T05, first stage: (window, session) pairs of page views, a 5-minute window sliding
    by one minute; state is dropped once the watermark passes the window."""
    return (page_view_hits
            .groupBy(F.window(EVENT_TIME, window, slide).alias("w"), "session_id")
            .agg(F.count(F.lit(1)).alias("views"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "session_id", "views"))


def stream_closed_windows(page_view_hits: DataFrame, window: str = LIVE_WINDOW, slide: str = LIVE_SLIDE) -> DataFrame:
    """T05 as one stream in append mode: each window's distinct sessions, given out once, when the watermark has passed it.

    Two stateful aggregations in a row: views of (window, session) first, then sessions of the window. Both drop a
    window's state as it closes, and nothing written before is read again. Windows that are still open
    have no row; :func:`stream_active_sessions` has them.
    """
    pairs = (page_view_hits.groupBy(F.window(EVENT_TIME, window, slide).alias("w"), "session_id")
             .agg(F.count(F.lit(1)).alias("views")))
    return (pairs.groupBy("w").agg(F.count(F.lit(1)).alias("active_sessions"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "active_sessions"))


def append_sink(rows: DataFrame, out_dir: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append-mode rows as Parquet, through the file sink's own commit log."""
    return (rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start(out_dir))


def active_sessions_by_window(spark: SparkSession, out_dir: str) -> DataFrame:
    """T05, second stage: distinct sessions per window from the versioned pairs."""
    pairs = spark.read.parquet(out_dir).select("window_start", "window_end", "session_id").distinct()
    return (pairs.groupBy("window_start", "window_end")
            .agg(F.count(F.lit(1)).alias("active_sessions")))


def realtime_sink(page_views: DataFrame, visitors: DataFrame, details: DataFrame,
                  out_dir: str, checkpoint: str, n: int = 50,
                  trigger: dict | None = None, maintained: bool = False) -> StreamingQuery:
    """Per micro-batch, append the batch's page views, then recompute the live feed
    (Q32) over stored page views at the newest view time — the five-minute window spans
    several micro-batches, so one batch alone is not enough. With ``maintained``, ``details`` are
    maintained profiles (:mod:`webtraffic.operators.profiles`), and no detail rows are read."""
    feed_of = realtime_feed_maintained if maintained else realtime_feed
    store = f"{out_dir}/page_views"

    def write(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        newest = batch.agg(F.max("viewed_at").alias("m")).first()["m"]
        if newest is None:  # nothing new: the feed's reference time cannot have moved
            return
        (batch.withColumn("dt", F.to_date("viewed_at"))
         .write.mode("overwrite").partitionBy("dt").parquet(f"{store}/{BATCH_COL}={batch_id}"))
        stored = spark.read.parquet(store)
        # The store's newest view is at least this batch's, so it lies in this batch's date or a
        # later one: only those date partitions are read, not the whole history.
        recent = stored.where(F.col("dt") >= F.lit(newest.date()))
        as_of = recent.agg(F.max("viewed_at").alias("m")).first()["m"]
        feed = feed_of(stored, visitors, details, as_of, n=n)
        feed.write.mode("overwrite").parquet(f"{out_dir}/feed/{BATCH_COL}={batch_id}")

    return (page_views.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_feed(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest feed snapshot written by :func:`realtime_sink`."""
    feeds = spark.read.parquet(f"{out_dir}/feed")
    last = feeds.agg(F.max(BATCH_COL).alias("b"))
    return feeds.join(last, feeds[BATCH_COL] == last["b"], "left_semi").drop(BATCH_COL)


def ingest_stream(raw: DataFrame) -> DataFrame:
    """Validated hits of a stream (I01 applied to a streaming payload)."""
    valid, _ = normalize_hits(raw)
    return valid


__all__ = ["read_hits_stream", "with_event_time", "dedupe_hits", "stream_visitors",
           "stream_sessions", "versioned_sink", "read_latest", "stream_append",
           "stream_active_sessions", "stream_closed_windows", "append_sink", "active_sessions_by_window", "realtime_sink", "read_feed",
           "ingest_stream", "SESSIONS", "VISITORS"]
