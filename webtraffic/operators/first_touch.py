"""Maintained first touch of each visitor (Q08, Q09, Q38): when their earliest stored session started, kept by ingest.

A visitor returns in a period iff a session of the period has an earlier one, in or before it. With first touches the
second half is a lookup of one small row a visitor instead of a scan of all older sessions.

A load appends the earliest start of each of its visitors; readers take the least, so late and repeated loads need no
order. One change does not combine that way: a session goes over to another visitor when a late hit turns out to be its
first one. The visitors that lose a session are found while the load is merged, and their buckets are written anew from
their remaining sessions, in the same commit. Sessions without a visitor or a start give no touch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SESSIONS
from ..sources import ledger as L

TABLE = "visitor_first_touch"
BUCKETS = 64
BY = ("bucket", T.IntegerType())
FIRST_TOUCH = T.StructType([
    T.StructField("visitor_id", T.StringType(), True),
    T.StructField("first_started", SESSIONS["started_at"].dataType, True),
])


def first_touches(sessions: DataFrame) -> DataFrame:
    """Earliest start of each visitor with one; combined map-side, so a hot visitor costs a task one row."""
    known = F.col("visitor_id").isNotNull() & F.col("started_at").isNotNull()
    return sessions.where(known).groupBy("visitor_id").agg(F.min("started_at").alias("first_started"))


def combine_touches(touches: DataFrame) -> DataFrame:
    """One row for each visitor."""
    return touches.groupBy("visitor_id").agg(F.min("first_started").alias("first_started"))


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("visitor_id"), F.lit(BUCKETS)).cast("int"))


def write_touches(touches: DataFrame, root: str, attempt: str) -> dict[str, list[str]]:
    """Write one row for each visitor, unpublished; the directories by bucket."""
    return L.write_dirs(_bucketed(touches), root, TABLE, attempt, by="bucket")


def stored_first_touch(spark: SparkSession, root: str, state: L.State | None = None) -> DataFrame:
    """Touches of the newest (or the given) version: visitor_id, first_started, bucket; several for a visitor."""
    state = state or L.read_state(spark, root) or L.State()
    return L.read_dirs(spark, root, TABLE, state.dirs.get(TABLE, {}), FIRST_TOUCH, by=BY)


def losing_visitors(known: DataFrame, merged: DataFrame) -> DataFrame:
    """Visitors of stored sessions (``known``) that the merged rows give to another visitor, or start later."""
    now = merged.select("session_id", F.col("visitor_id").alias("_v"), F.col("started_at").alias("_s"))
    before = known.where(F.col("visitor_id").isNotNull() & F.col("started_at").isNotNull())
    kept = F.col("_v").eqNullSafe(F.col("visitor_id")) & F.coalesce(F.col("_s") <= F.col("started_at"), F.lit(False))
    return before.join(now.hint("merge"), "session_id").where(~kept).select("visitor_id").distinct()


def merged_touches(spark: SparkSession, root: str, state: L.State, known: DataFrame, merged: DataFrame,
                   untouched: DataFrame) -> dict[str, list[str]]:
    """Listing changes that bring the touches up to ``merged``, the new rows of the sessions ``known``; ``untouched`` are
    the other stored sessions, read only where a visitor lost one or no touches are stored yet."""
    listed, attempt = state.dirs.get(TABLE, {}), uuid.uuid4().hex
    if not listed:
        return write_touches(first_touches(untouched.select("visitor_id", "started_at")
                                           .unionByName(merged.select("visitor_id", "started_at"))), root, attempt)
    fresh = write_touches(first_touches(merged), root, attempt)
    lost = _bucketed(losing_visitors(known, merged))
    # at most BUCKETS values
    hit = {str(r.bucket) for r in lost.select("bucket").distinct().collect()}
    appended = {b: [*listed.get(b, []), *p] for b, p in fresh.items()}
    if not hit:
        return appended
    stored = {b: p for b, p in appended.items() if b in hit} | {b: listed[b] for b in hit - set(appended) if b in listed}
    rows = L.read_dirs(spark, root, TABLE, stored, FIRST_TOUCH, by=BY).drop("bucket")
    theirs = untouched.select("visitor_id", "started_at").unionByName(merged.select("visitor_id", "started_at"))
    gone = lost.select("visitor_id").hint("merge")
    again = first_touches(theirs.join(gone, "visitor_id", "left_semi"))
    rows = combine_touches(rows.join(gone, "visitor_id", "left_anti")).unionByName(again)
    written = write_touches(rows, root, uuid.uuid4().hex)
    return appended | {b: written.get(b, []) for b in hit}


def compact_touches(spark: SparkSession, root: str, least: int = 2) -> L.State:
    """Fold the buckets that ``least`` or more loads wrote into one row a visitor."""
    return L.compact(spark, root, TABLE, FIRST_TOUCH, least, by=BY, fold=lambda df: _bucketed(combine_touches(df)))
