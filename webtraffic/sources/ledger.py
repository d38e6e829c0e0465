"""A commit ledger over date-partitioned Parquet: which loads are in, and which directories hold them.

Data is written to ``root/<table>/load=<attempt>/dt=<date>`` and never changed in place. A commit is one file
``root/_ledger/<version>.json`` with the loads applied so far and, for each table and date, the live
directories. It appears under its name by a rename that fails if another writer took that version, so a load
is in all its tables or in none, readers see one version, and what an interrupted or beaten writer left is
never read (:func:`vacuum` removes it). The root needs a file system whose rename does not
overwrite, as HDFS has.

A commit lists one entry for each date and load; :func:`compact` writes a table's dates of many
loads into one directory each. Loads that come numbered from one source, as a stream's micro-batches do, are kept as that
source's last number, so the list does not grow with the age of a stream.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = "_ledger"
NO_DATE = "__HIVE_DEFAULT_PARTITION__"


#: A load's name, or its source and number.
Load = str | tuple[str, int]


class Conflict(Exception):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class State:
    """One version: applied loads, table -> date text -> directories below ``root/<table>``, and the last number of each
    source of numbered loads."""

    version: int = 0
    loads: tuple[str, ...] = ()
    dirs: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)

    def holds(self, load: Load | None) -> bool:
        """Whether a load is applied. Numbered loads of one source come in order, as a stream replays only its last one."""
        if isinstance(load, tuple):
            return load[1] <= self.streams.get(load[0], -1)
        return load in self.loads

    def after(self, load: Load | None, dirs: dict[str, dict[str, list[str]]]) -> State:
        """The next version: ``load`` applied, and the given dates of the given tables as listed."""
        merged = {t: dict(d) for t, d in self.dirs.items()}
        for table, dates in dirs.items():
            here = merged.setdefault(table, {})
            for date, listed in dates.items():
                if listed:
                    here[date] = listed
                else:
                    here.pop(date, None)
        if isinstance(load, tuple):
            return State(self.version + 1, self.loads, merged, self.streams | dict([load]))
        return State(self.version + 1, (*self.loads, *([load] if load else [])), merged, self.streams)


class _Files:
    """The cluster's file system at ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, rel: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}" if rel else self.root)

    def names(self, rel: str) -> list[str]:
        p = self.path(rel)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def age_ms(self, rel: str) -> int:
        return self.jvm.java.lang.System.currentTimeMillis() - self.fs.getFileStatus(self.path(rel)).getModificationTime()

    def read(self, rel: str) -> str:
        stream = self.fs.open(self.path(rel))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, rel: str, text: str) -> None:
        """Make a whole file appear at once, or raise :class:`Conflict` if it exists."""
        part = f"{LEDGER}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(part), False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        keep = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.path(part), self.path(rel), keep)
        except Py4JJavaError as e:
            self.fs.delete(self.path(part), False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(rel) from e
            raise


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint over restarts."""
    return json.loads(_Files(spark, checkpoint).read("metadata"))["id"]


def _versions(files: _Files) -> list[int]:
    return sorted(int(n[:-5]) for n in files.names(LEDGER) if n.endswith(".json") and n[:-5].isdigit())


def _state(files: _Files, version: int) -> State:
    d = json.loads(files.read(f"{LEDGER}/{version:012d}.json"))
    return State(version, tuple(d["loads"]), d["dirs"], d.get("streams", {}))


def read_state(spark: SparkSession, root: str, version: int | None = None) -> State | None:
    """The newest (or the given) version; None where no ledger is."""
    files = _Files(spark, root)
    versions = _versions(files)
    return _state(files, version or versions[-1]) if versions else None


def commit(spark: SparkSession, root: str, state: State) -> State:
    """Publish ``state`` as its version; :class:`Conflict` if that version is taken."""
    body = json.dumps({"loads": state.loads, "dirs": state.dirs, "streams": state.streams}, separators=(",", ":"), sort_keys=True)
    _Files(spark, root).create(f"{LEDGER}/{state.version:012d}.json", body)
    return state


def write_dirs(df: DataFrame, root: str, table: str, attempt: str, by: str = "dt") -> dict[str, list[str]]:
    """Write rows with their ``dt`` (or other partition column), unpublished; the directories by its value."""
    df.hint("rebalance", by).write.partitionBy(by).parquet(f"{root}/{table}/load={attempt}")
    names = _Files(df.sparkSession, root).names(f"{table}/load={attempt}")
    return {n[len(by) + 1 :]: [f"load={attempt}/{n}"] for n in names if n.startswith(f"{by}=")}


def dates_of(listed: dict[str, list[str]]) -> dict:
    """dt value (None for rows without one) -> directory name part."""
    from datetime import date

    return {None if d == NO_DATE else date.fromisoformat(d): d for d in listed}


def read_dirs(spark: SparkSession, root: str, table: str, listed: dict[str, list[str]], schema: T.StructType,
              by: tuple[str, T.DataType] = ("dt", T.DateType())) -> DataFrame:
    """Rows of the listed directories, with the partition column for pruning."""
    full = T.StructType([*schema.fields, T.StructField(*by, True)])
    paths = [f"{root}/{table}/{p}" for dirs in listed.values() for p in dirs]
    if not paths:
        return spark.createDataFrame([], full)
    return spark.read.schema(T.StructType([*full.fields, T.StructField("load", T.StringType())])).option("basePath", f"{root}/{table}").parquet(*paths).drop("load")


def compact(spark: SparkSession, root: str, table: str, schema: T.StructType, least: int = 2,
            by: tuple[str, T.DataType] = ("dt", T.DateType()), fold=lambda df: df) -> State:
    """Rewrite the dates (or other parts) of ``table`` that lie in ``least`` or more directories into one each; ``fold`` may
    combine their rows."""
    while True:
        state = read_state(spark, root) or State()
        many = {d: p for d, p in state.dirs.get(table, {}).items() if len(p) >= least}
        if not many:
            return state
        rows = fold(read_dirs(spark, root, table, many, schema, by))
        written = write_dirs(rows, root, table, uuid.uuid4().hex, by[0])
        try:
            return commit(spark, root, state.after(None, {table: {d: written.get(d, []) for d in many}}))
        except Conflict:
            continue


def vacuum(spark: SparkSession, root: str, versions: int = 2, older_than_s: float = 86400) -> list[str]:
    """Delete the directories that none of the newest ``versions`` lists, and older commit files.

    Younger directories stay, as a writer may be about to publish them, and readers may hold them.
    """
    files = _Files(spark, root)
    have = _versions(files)
    kept = [_state(files, v) for v in have[-versions:]]
    live = {f"{t}/{p}" for s in kept for t, dates in s.dirs.items() for paths in dates.values() for p in paths}
    gone = []
    for table in {t for s in kept for t in s.dirs}:
        for load in (n for n in files.names(table) if n.startswith("load=")):
            if files.age_ms(f"{table}/{load}") < older_than_s * 1000:
                continue
            dead = [d for d in (f"{table}/{load}/{n}" for n in files.names(f"{table}/{load}") if "=" in n) if d not in live]
            whole = not any(x.startswith(f"{table}/{load}/") for x in live)
            for d in [f"{table}/{load}"] if whole else dead:
                files.fs.delete(files.path(d), True)
                gone.append(d)
    if kept:
        for v in have[:-versions]:
            files.fs.delete(files.path(f"{LEDGER}/{v:012d}.json"), False)
    return gone


def row_sums(rows: DataFrame) -> str:
    """What a table's rows come to, in any order."""
    h = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    return ":".join(map(str, rows.agg(F.count(F.lit(1)), F.sum(h), F.bit_xor(F.xxhash64(F.lit(1), *rows.columns))).first()))


def fingerprint(sums: dict[str, str]) -> str:
    """A load's id from the sums of its tables: a repeated load has the same one."""
    return uuid.uuid5(uuid.NAMESPACE_OID, repr(sorted(sums.items()))).hex
