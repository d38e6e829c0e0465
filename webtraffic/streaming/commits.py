"""A stream that commits to the ledger: T02-T04 and T06 over the tables that batch loads keep.

Each micro-batch is one load of :func:`webtraffic.operators.merge.merge_tables`, numbered by its batch id under the query's
id. A batch that is replayed after a failure, in whatever state it was, changes nothing or is published once; a
reader sees whole batches of all tables at one version, never a write that has not finished; batch loads and
other streams may commit to the same tables meanwhile.

Visitors and sessions are brought up to date in the tables, so the stream holds no keyed state: nothing has to
expire, a hit may be late by any time, and no snapshots are written. A batch looks its keys up in the key
columns of all stored dates, so its interval should be minutes, not seconds, where many are stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import first_touch as FT
from ..operators import profiles as P
from ..operators.ingest import ingest
from ..operators.merge import KEY, merge_tables
from ..operators.people import realtime_feed_maintained
from ..schema import PAGE_VIEWS, TABLE_SCHEMAS
from ..session import drop_scratch, scratch_path
from ..sources import ledger as L
from ..sources.tables import load_tables
from .live import EVENT_TIME

FOLD_EVERY = 20  # batches between foldings of the directories that batches append


def ledger_sink(raw: DataFrame, out_dir: str, checkpoint: str, geo_ranges: DataFrame | None = None,
                geo_ranges6: DataFrame | None = None, trigger: dict | None = None,
                fold_every: int | None = FOLD_EVERY) -> StreamingQuery:
    """Hits as they arrive, in all five tables and their maintained views under ``out_dir``.

    Hits that validation rejects are left out. ``fold_every`` batches, dates and buckets that several batches
    wrote are folded into one directory each; :func:`webtraffic.sources.ledger.vacuum` removes the old ones.
    """
    def write(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        load = (L.stream_id(spark, checkpoint), batch_id)
        if (L.read_state(spark, out_dir) or L.State()).holds(load):
            return
        staged = scratch_path(spark, "stream", "hits")
        try:
            tables, _ = ingest(batch.drop(EVENT_TIME), geo_ranges, stage=staged, geo_ranges6=geo_ranges6)
            merge_tables(spark, tables, out_dir, load_id=load)
        finally:
            drop_scratch(spark, staged)
        if fold_every and batch_id % fold_every == fold_every - 1:
            fold(spark, out_dir)

    return (raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def fold(spark: SparkSession, out_dir: str) -> L.State:
    """Write what many loads appended to one date or bucket into one directory."""
    for name in TABLE_SCHEMAS:
        if name not in KEY:  # a date of a keyed table has one directory
            L.compact(spark, out_dir, name, TABLE_SCHEMAS[name])
    P.compact_profiles(spark, out_dir)
    return FT.compact_touches(spark, out_dir)


def newest_view(spark: SparkSession, out_dir: str, state: L.State):
    """Time of the newest page view, from the newest date alone; None without any."""
    listed = state.dirs.get("page_views", {})
    dated = [d for d in listed if d != L.NO_DATE]
    if not dated:
        return None
    last = {max(dated): listed[max(dated)]}
    return L.read_dirs(spark, out_dir, "page_views", last, PAGE_VIEWS).agg(F.max("viewed_at")).first()[0]


def live_feed(spark: SparkSession, out_dir: str, as_of=None, n: int = 50) -> DataFrame:
    """The realtime feed (Q32) of the newest committed version, by default at its newest page view. Page views of the
    last dates and the profiles are read, no detail rows."""
    state = L.read_state(spark, out_dir) or L.State()
    t = load_tables(spark, out_dir, names=("page_views", "visitors"), state=state)
    at = as_of if as_of is not None else newest_view(spark, out_dir, state)
    return realtime_feed_maintained(t.page_views, t.visitors, P.stored_profiles(spark, out_dir, state), at or "1970-01-01", n=n)
