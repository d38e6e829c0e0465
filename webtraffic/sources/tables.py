"""The derived traffic tables as Parquet, date-partitioned for pruning."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import first_touch as FT
from ..schema import TABLE_SCHEMAS, TIME_COLUMN
from . import ledger

TABLE_NAMES = tuple(TIME_COLUMN)


@dataclass(frozen=True)
class Tables:
    """The five traffic tables plus the reference instant that stands for "now".

    ``first_touch`` is the maintained view of :mod:`webtraffic.operators.first_touch`, where the tables have one.
    """

    visitors: DataFrame | None = None
    sessions: DataFrame | None = None
    page_views: DataFrame | None = None
    visitor_details: DataFrame | None = None
    events: DataFrame | None = None
    as_of: datetime | None = None
    first_touch: DataFrame | None = None

    def with_as_of(self, as_of) -> "Tables":
        return replace(self, as_of=as_of)

    def frames(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)
                if f.name in TIME_COLUMN and getattr(self, f.name) is not None}


def write_tables(tables: Tables, out_dir: str, mode: str = "overwrite") -> None:
    """Write each table under ``out_dir/<name>``, partitioned by ``dt = to_date(time col)``.

    A rebalance on ``dt`` before the write lets Spark put small dates together and split a busy
    one by its measured size; it reads its input once (a range partitioning would read it twice,
    to sample it). The tables are independent, so their jobs are submitted concurrently.
    """
    def write(item):
        name, df = item
        tcol = TIME_COLUMN[name]
        out = df if "dt" in df.columns else df.withColumn("dt", F.to_date(F.col(tcol)))
        (out.hint("rebalance", "dt")
            .write.mode(mode).partitionBy("dt").parquet(f"{out_dir}/{name}"))

    items = list(tables.frames().items())
    with ThreadPoolExecutor(max_workers=max(1, len(items))) as pool:
        list(pool.map(write, items))


def load_tables(spark: SparkSession, in_dir: str, as_of=None,
                names=TABLE_NAMES, state: ledger.State | None = None) -> Tables:
    """Read tables written by :func:`write_tables` (``dt`` partitions discovered), or the newest (or the given) version of
    those that :func:`webtraffic.operators.merge.merge_tables` committed.

    Schemas are declared, so a table that was written without rows, or without some columns, loads.
    """
    state = state or ledger.read_state(spark, in_dir)
    if state is not None:
        frames = {n: ledger.read_dirs(spark, in_dir, n, state.dirs.get(n, {}), TABLE_SCHEMAS[n]) for n in names}
        touches = FT.stored_first_touch(spark, in_dir, state) if FT.TABLE in state.dirs else None
        return Tables(**frames, as_of=as_of, first_touch=touches)
    dt = T.StructField("dt", T.DateType(), True)
    frames = {n: spark.read.schema(T.StructType([*TABLE_SCHEMAS[n].fields, dt])).parquet(f"{in_dir}/{n}")
              for n in names}
    return Tables(**frames, as_of=as_of)


def plain_tables(spark: SparkSession, in_dir: str) -> dict[str, DataFrame]:
    """Those tables under ``in_dir`` that :func:`write_tables` wrote, with no ledger."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = []
    for n in TABLE_NAMES:
        p = path(f"{in_dir}/{n}/_SUCCESS")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            there.append(n)
    return load_tables(spark, in_dir, names=there).frames() if there else {}


def latest_instant(page_views: DataFrame, col: str = "viewed_at") -> datetime | None:
    """The fixtures' "now": the newest page view (a single scalar brought to the driver)."""
    return page_views.agg(F.max(col).alias("m")).first()["m"]
