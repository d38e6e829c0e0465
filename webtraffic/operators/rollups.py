"""Hourly roll-up of the sessions with mergeable visitor sketches (Q01's approximate form; Q02, Q05-Q07, Q11, Q13 exactly).

A row stands for the sessions of one hour: how many, bounces, duration and page-view sums, and a HyperLogLog sketch of
their visitors (2^``LG_K`` registers, at most some 4 KB). Sums add up and sketches unite, so a period is answered from its
whole hours and, at both ends, from the sessions of at most one partial hour; all time needs the roll-up only. Counts and
means are exact. The number of visitors has a relative standard error of 1.04 / sqrt(2^LG_K), 1.6 %; ``BOUND`` is three
of them.

Ingest keeps the roll-up: a load writes the hours of the dates that it touches anew from their sessions, in the commit that
publishes these, as sketches cannot give up a visitor when a session moves. Sessions without a start have the hour NULL
and count for all time only; those without a visitor are in no sketch.
"""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.period import DEFAULT_PERIOD, PERIODS, pcol, time_filter, to_datetime, ts_lit
from ..schema import SESSIONS
from ..sources import ledger as L

TABLE = "session_rollup"
LG_K = 12
BOUND = 3 * 1.04 / 2 ** (LG_K / 2)
_SUMS = ("sessions", "bounces", "duration_sum", "duration_n", "views_sum", "views_n")
ROLLUP = T.StructType([T.StructField("hour", T.TimestampNTZType(), True), *[T.StructField(n, T.LongType(), True) for n in _SUMS],
                       T.StructField("visitors", T.BinaryType(), True)])


def session_rollup(sessions: DataFrame) -> DataFrame:
    """One row for each hour, combined map-side."""
    hour = F.date_trunc("hour", "started_at").cast("timestamp_ntz")
    return sessions.groupBy(hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("page_views") == 1).alias("bounces"),
        F.sum("duration").cast("long").alias("duration_sum"), F.count("duration").alias("duration_n"),
        F.sum("page_views").cast("long").alias("views_sum"), F.count("page_views").alias("views_n"),
        F.hll_sketch_agg("visitor_id", LG_K).alias("visitors"))


def merged_rollup(spark: SparkSession, root: str, state: L.State, changes: dict[str, list[str]]) -> dict[str, list[str]]:
    """Listing changes of the roll-up that go with those of the sessions; of all dates where none is stored yet."""
    after = state.after(None, {"sessions": changes}).dirs["sessions"]
    dates = set(changes) if TABLE in state.dirs else set(after)
    rows = L.read_dirs(spark, root, "sessions", {d: after[d] for d in sorted(dates) if d in after}, SESSIONS)
    rolled = session_rollup(rows).withColumn("dt", F.to_date("hour"))
    return {d: [] for d in dates} | L.write_dirs(rolled, root, TABLE, uuid.uuid4().hex)


def stored_rollup(spark: SparkSession, root: str, state: L.State | None = None) -> DataFrame:
    """The roll-up of the newest (or the given) version, with ``dt``."""
    state = state or L.read_state(spark, root) or L.State()
    return L.read_dirs(spark, root, TABLE, state.dirs.get(TABLE, {}), ROLLUP)


def _bounds(period, start, end, as_of):
    """First instant of the period and first one after it, None where it is open; False if nothing is in it."""
    second = lambda t: t.replace(microsecond=0)
    if start and end:
        s, e = to_datetime(start), to_datetime(end)
        return False if s is None or e is None else (second(s), second(e) + timedelta(seconds=1))
    p = period or DEFAULT_PERIOD
    if p not in PERIODS:
        return None, None
    a = to_datetime(as_of)
    if a is None:
        raise ValueError(f"as_of is not a date-time: {as_of!r}")
    return second(a) - PERIODS[p] + timedelta(seconds=1), None


def rolled_totals(rollup: DataFrame, sessions: DataFrame, period=DEFAULT_PERIOD, as_of=None, start=None, end=None) -> DataFrame:
    """One row: total_visitors (estimated), total_sessions, bounce_rate, avg_session_duration, avg_pages_per_session."""
    bounds = _bounds(period, start, end, as_of)
    hour, whole, edges = timedelta(hours=1), F.lit(bounds is not False), []
    lo, hi = bounds or (None, None)
    if lo is not None:
        up = lo.replace(minute=0, second=0)
        up = up if up == lo else up + hour
        whole = whole & (F.col("hour") >= ts_lit(up))
        edges.append((up - hour, up))
    if hi is not None:
        down = hi.replace(minute=0, second=0)
        whole = whole & (F.col("hour") < ts_lit(down))
        edges.append((down, down + hour))
    if pcol(rollup):
        if lo is not None:
            whole = whole & (F.col("dt") >= F.lit(lo.date()))
        if hi is not None:
            whole = whole & (F.col("dt") <= F.lit(hi.date()))
    rows = rollup.where(whole).select(*ROLLUP.fieldNames())
    if edges:
        part = F.lit(False)
        for a, b in edges:
            here = (F.col("started_at") >= ts_lit(a)) & (F.col("started_at") < ts_lit(b))
            part = part | ((here & (F.col("dt") == F.lit(a.date()))) if pcol(sessions) else here)
        cut = sessions.where(part & time_filter("started_at", period, start, end, as_of, pcol(sessions)))
        rows = rows.unionByName(session_rollup(cut))
    total = rows.agg(*[F.sum(n).alias(n) for n in _SUMS], F.hll_union_agg("visitors").alias("visitors"))
    mean = lambda x, n: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(n)), F.lit(0.0))
    return total.select(
        F.coalesce(F.hll_sketch_estimate("visitors"), F.lit(0)).alias("total_visitors"),
        F.coalesce("sessions", F.lit(0)).alias("total_sessions"),
        F.coalesce(F.try_divide(F.col("bounces") * F.lit(100.0), F.col("sessions")), F.lit(0.0)).alias("bounce_rate"),
        mean("duration_sum", "duration_n").alias("avg_session_duration"), mean("views_sum", "views_n").alias("avg_pages_per_session"))
