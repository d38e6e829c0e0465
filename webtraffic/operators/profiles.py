"""Maintained per-visitor view of the detail rows (E07, Q32, Q34): kept by ingest, so that listings do not scan them.

A *profile* stands for some detail rows of one visitor: how many there are, the latest one, and the first
``PROFILE_ROWS`` by id (as many as the realtime feed can show). Profiles of one visitor combine, in any order and grouping,
into the profile of all their rows. Each load therefore only appends the profiles of its own rows, in the commit that
publishes the rows themselves; readers combine a visitor's profiles, and :func:`compact_profiles` folds
them into one. They lie in ``BUCKETS`` buckets by visitor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import VISITOR_DETAILS
from ..sources import ledger as L

TABLE = "visitor_profiles"
PROFILE_ROWS = 50
BUCKETS = 64
SHOWN = ("country", "city", "browser", "device_type")
LATEST = (*SHOWN, "os")

_kinds = {f.name: f.dataType for f in VISITOR_DETAILS.fields}
_struct = lambda *names: T.StructType([T.StructField(n, _kinds[n], True) for n in names])
PROFILES = T.StructType([
    T.StructField("visitor_id", T.StringType(), True),
    T.StructField("n_details", T.LongType(), True),
    T.StructField("latest", _struct("updated_at", "id", *LATEST), True),
    T.StructField("first", T.ArrayType(_struct("id", *SHOWN)), True),
])


def detail_profiles(details: DataFrame) -> DataFrame:
    """The profiles of these rows, one for each visitor. The cut to the first rows runs before the shuffle, and counting and
    the latest row combine map-side, so a visitor with very many rows costs each task a bounded number."""
    rows = details.select("visitor_id", "updated_at", "id", *LATEST)
    by_id = Window.partitionBy("visitor_id").orderBy("id", "updated_at")
    first = rows.select("visitor_id", "updated_at", "id", *SHOWN).withColumn("rk", F.row_number().over(by_id)).where(F.col("rk") <= PROFILE_ROWS)
    first = first.groupBy("visitor_id").agg(F.array_sort(F.collect_list(F.struct("id", *SHOWN))).alias("first"))
    whole = rows.groupBy("visitor_id").agg(
        F.count(F.lit(1)).alias("n_details"), F.max_by(F.struct("updated_at", "id", *LATEST), F.struct("updated_at", "id")).alias("latest"))
    return whole.join(first.hint("merge"), "visitor_id").select("visitor_id", "n_details", "latest", "first")


def combine_profiles(profiles: DataFrame) -> DataFrame:
    """One profile for each visitor."""
    return profiles.groupBy("visitor_id").agg(
        F.sum("n_details").alias("n_details"), F.max_by("latest", F.struct("latest.updated_at", "latest.id")).alias("latest"),
        F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, PROFILE_ROWS).alias("first"))


def _bucketed(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("bucket", F.pmod(F.xxhash64("visitor_id"), F.lit(BUCKETS)).cast("int"))


def write_profiles(details: DataFrame, root: str, attempt: str) -> dict[str, list[str]]:
    """Write the profiles of a load's rows, unpublished; their directories by bucket."""
    return L.write_dirs(_bucketed(detail_profiles(details)), root, TABLE, attempt, by="bucket")


def appended(state: L.State, table: str, written: dict[str, list[str]]) -> dict[str, list[str]]:
    """The listing of the written parts with what they hold already."""
    listed = state.dirs.get(table, {})
    return {d: [*listed.get(d, []), *p] for d, p in written.items()}


def keep_profiles(spark: SparkSession, root: str, details: DataFrame, load_id: str) -> L.State:
    """Add the profiles of a load's detail rows, once; for stores that keep their rows elsewhere."""
    written = None
    while True:
        state = L.read_state(spark, root) or L.State()
        if load_id in state.loads:
            return state
        written = written or write_profiles(details, root, uuid.uuid4().hex)
        try:
            return L.commit(spark, root, state.after(load_id, {TABLE: appended(state, TABLE, written)}))
        except L.Conflict:
            continue


def stored_profiles(spark: SparkSession, root: str, state: L.State | None = None) -> DataFrame:
    """Profiles of the newest (or the given) version: visitor_id, n_details, latest, first, bucket; several for a visitor."""
    state = state or L.read_state(spark, root) or L.State()
    return L.read_dirs(spark, root, TABLE, state.dirs.get(TABLE, {}), PROFILES, by=("bucket", T.IntegerType()))


def profiles_of(profiles: DataFrame, keys: DataFrame) -> DataFrame:
    """One profile for each of the visitors in ``keys`` that has any; only their buckets are read where the
    plan prunes by the join."""
    wanted = _bucketed(keys.select("visitor_id").distinct())
    return combine_profiles(profiles.join(wanted, ["bucket", "visitor_id"], "left_semi"))


def compact_profiles(spark: SparkSession, root: str, least: int = 2) -> L.State:
    """Fold the buckets that ``least`` or more loads wrote."""
    return L.compact(spark, root, TABLE, PROFILES, least, by=("bucket", T.IntegerType()), fold=lambda df: _bucketed(combine_profiles(df)))
