"""I02/I03 over stored tables: a further load updates the visitors and sessions that are there.

The collector looked a visitor or session up and updated its row; a batch load has to give the
same rows whatever parts the log arrives in, in whatever order. Rows of one key combine by the
first-hit rules of :mod:`ingest`: attributes of the earliest hit, earliest and latest times, page
views added up. Page views, details and events are appended.

A load is published by one commit of :mod:`webtraffic.sources.ledger`, in all tables or in none. It has an id, by default
a fingerprint of its rows (a stream's micro-batches are numbered instead), and a load whose id is in the ledger already changes nothing: a load can be
repeated after any interruption. Of two loads at once the one that commits second merges anew with what
the first one published.

A stored table is read for its keys; only the dates that hold rows of the load's keys, or receive
them, are written again, to new directories.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLE_SCHEMAS, TIME_COLUMN
from ..session import drop_scratch, scratch_path
from ..sources import ledger as L
from ..sources.tables import Tables, plain_tables
from . import first_touch as FT
from . import profiles as P
from . import rollups as RU

KEY = {"visitors": "visitor_id", "sessions": "session_id"}


def combine_visitors(rows: DataFrame) -> DataFrame:
    """One row per visitor from rows that each stand for some of its hits."""
    first = F.min_by(F.struct("id", "ip_address", "user_agent"), F.struct("created_at", "id"))
    return rows.groupBy("visitor_id").agg(
        first.alias("f"), F.min("created_at").alias("created_at"), F.max("last_seen").alias("last_seen")
    ).select("f.id", "visitor_id", "f.ip_address", "f.user_agent", "created_at", "last_seen")


def combine_sessions(rows: DataFrame, count_from: int = 1) -> DataFrame:
    """One row per session; every row's page views start at ``count_from``, the sum does once."""
    names = [f.name for f in TABLE_SCHEMAS["sessions"].fields]
    own = [n for n in names if n not in ("session_id", "page_views")]
    s = rows.groupBy("session_id").agg(
        F.min_by(F.struct(*own), F.struct("started_at", "id")).alias("f"),
        (F.sum(F.col("page_views") - count_from) + count_from).alias("page_views"),
    )
    return s.select(*[F.col(f"f.{n}") if n in own else F.col(n) for n in names])


COMBINE = {"visitors": combine_visitors, "sessions": combine_sessions}


def _dated(name: str, rows: DataFrame) -> DataFrame:
    columns = [f.name for f in TABLE_SCHEMAS[name].fields]
    return rows.select(*columns, F.to_date(TIME_COLUMN[name]).alias("dt"))


def _adopted(spark: SparkSession, root: str) -> L.State:
    """The newest version; plain tables that were written without a ledger become its first one."""
    state = L.read_state(spark, root)
    if state is not None:
        return state
    plain = plain_tables(spark, root)
    if not plain:
        return L.State()
    attempt = uuid.uuid4().hex
    dirs = {n: L.write_dirs(df, root, n, attempt) for n, df in plain.items()}
    if "visitor_details" in plain:
        dirs[P.TABLE] = P.write_profiles(plain["visitor_details"], root, attempt)
    if "sessions" in plain:
        dirs[FT.TABLE] = FT.write_touches(FT.first_touches(plain["sessions"]), root, attempt)
    try:
        return L.commit(spark, root, L.State().after(None, dirs))
    except L.Conflict:
        return L.read_state(spark, root)


def _together(job, names) -> dict:
    """Independent jobs of the named tables, submitted at once."""
    with ThreadPoolExecutor(max_workers=max(1, len(names))) as pool:
        return dict(zip(names, pool.map(job, names), strict=True))


def _merge_keyed(spark: SparkSession, name: str, new: DataFrame, root: str, state: L.State,
                 staged: str) -> dict[str, dict[str, list[str]]]:
    """Write the touched dates of a keyed table anew; the directories of each, none where no row is left. With the
    sessions, their visitors' first touches and their hours' roll-up."""
    key, columns = KEY[name], [f.name for f in TABLE_SCHEMAS[name].fields]
    listed = state.dirs.get(name, {})
    old = L.read_dirs(spark, root, name, listed, TABLE_SCHEMAS[name])
    keys = new.select(key).hint("merge")  # they grow with the load: never sent through the driver
    old.join(keys, key, "left_semi").select(*columns, "dt").write.parquet(f"{staged}/known")
    known = spark.read.schema(old.schema).parquet(f"{staged}/known")
    _dated(name, COMBINE[name](known.select(*columns).unionByName(new))).write.parquet(f"{staged}/merged")
    merged = spark.read.schema(old.schema).parquet(f"{staged}/merged")
    # one value for each date that the load touches
    touched = {r.dt for r in known.select("dt").unionByName(merged.select("dt")).distinct().collect()}
    names = {d: n for d, n in L.dates_of(listed).items() if d in touched}
    rest = L.read_dirs(spark, root, name, {n: listed[n] for n in names.values()}, TABLE_SCHEMAS[name])
    rest = rest.join(keys, key, "left_anti").select(*columns, "dt")
    written = L.write_dirs(rest.unionByName(merged), root, name, uuid.uuid4().hex)
    changes = {name: {n: [] for n in names.values()} | written}
    if name == "sessions":
        untouched = old.join(keys, key, "left_anti").select(*columns)
        changes[FT.TABLE] = FT.merged_touches(spark, root, state, known, merged, untouched)
        changes[RU.TABLE] = RU.merged_rollup(spark, root, state, changes[name])
    return changes


def merge_tables(spark: SparkSession, new: Tables, out_dir: str, load_id: L.Load | None = None) -> L.State:
    """Add a load's tables (:func:`webtraffic.operators.ingest.ingest`) to those under ``out_dir``, once; the version that
    holds them. ``load_id`` names the load where its rows do not (say, two loads of equal rows that both count)."""
    state = _adopted(spark, out_dir)
    if state.holds(load_id):
        return state
    staged = scratch_path(spark, "merge", "load")
    try:
        return _merge(spark, new, out_dir, load_id, staged)
    finally:
        drop_scratch(spark, staged)


def _merge(spark: SparkSession, new: Tables, out_dir: str, load_id: L.Load | None, staged: str) -> L.State:
    attempt = uuid.uuid4().hex
    frames = new.frames()
    appended: dict[str, dict[str, list[str]]] = {}

    def write(name: str) -> DataFrame:
        if name in KEY:
            frames[name].select(*TABLE_SCHEMAS[name].fieldNames()).write.parquet(f"{staged}/{name}")
            return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{staged}/{name}")
        # in place already, to be published
        appended[name] = L.write_dirs(_dated(name, frames[name]), out_dir, name, attempt)
        return L.read_dirs(spark, out_dir, name, appended[name], TABLE_SCHEMAS[name]).drop("dt")

    rows = _together(write, frames)
    load = load_id or L.fingerprint(_together(lambda n: L.row_sums(rows[n]), rows))
    while True:
        state = _adopted(spark, out_dir)
        if state.holds(load):  # a repeated load costs no more than its rows; what it wrote is published nowhere
            for name in appended:
                drop_scratch(spark, f"{out_dir}/{name}/load={attempt}")
            return state
        if "visitor_details" in rows and P.TABLE not in appended:  # the maintained view changes in the same commit
            appended[P.TABLE] = P.write_profiles(rows["visitor_details"], out_dir, attempt)
        work = f"{staged}/{state.version}"
        merged = _together(lambda n: _merge_keyed(spark, n, rows[n], out_dir, state, f"{work}/{n}"), [n for n in rows if n in KEY])  # noqa: B023
        changes = {table: listing for parts in merged.values() for table, listing in parts.items()}
        for name, written in appended.items():
            changes[name] = P.appended(state, name, written)
        try:
            return L.commit(spark, out_dir, state.after(load, changes))
        except L.Conflict:
            continue
