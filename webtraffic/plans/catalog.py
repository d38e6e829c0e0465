"""Named queries over the driver's tables, each paired with an independent DuckDB statement.

Spark side: the library function applied to :func:`fixture_tables`. Oracle side: a DuckDB
statement written from the report's definition (windows, QUALIFY, FILTER aggregates, per-visitor
CTEs), with the reference instant explicit in the ``params`` CTE.
Top-k lists break count ties by their keys ascending (NULLs first) on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.enrich import DIRECT, REFERRER_BUCKETS
from ..sources.fixtures import fixture_tables, oracle


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        CATALOG[name] = Query(fn, sql)
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str):
    return fixture_tables(spark, sf_dir)


# --- SQL helpers for the oracle --------------------------------------------------------------
NOW = "(SELECT now_s FROM params)"
ASOF = "(SELECT as_of FROM params)"
PERIOD_SQL = {"24h": "1 DAY", "7d": "7 DAY", "30d": "30 DAY"}


def after_sql(col: str, interval: str) -> str:
    """``datetime(col) > datetime('now', -interval)`` at whole seconds."""
    return f"{col} >= {NOW} - INTERVAL {interval} + INTERVAL 1 SECOND"


def period_sql(col: str, period: str | None) -> str:
    p = period or "24h"
    return after_sql(col, PERIOD_SQL[p]) if p in PERIOD_SQL else "TRUE"


def range_sql(col: str, start: str, end: str) -> str:
    return (f"{col} >= date_trunc('second', TIMESTAMP '{start}') AND "
            f"{col} < date_trunc('second', TIMESTAMP '{end}') + INTERVAL 1 SECOND")


def today_sql(col: str) -> str:
    return f"CAST({col} AS DATE) = CAST({ASOF} AS DATE)"


def source_sql(domain: str) -> str:
    """The bucket of a referrer domain: the first needle of the priority list that it contains."""
    buckets = ", ".join(f"{{'needle': '{n}', 'label': '{label}'}}" for label, ns in REFERRER_BUCKETS for n in ns)
    first = f"list_filter([{buckets}], lambda b: contains(lower({domain}), b.needle))[1].label"
    return f"if(coalesce({domain}, '') = '', '{DIRECT}', coalesce({first}, {domain}))"


# Fixed parameters of the registered variants.
RANGE_START = "2024-01-10"
RANGE_END = "2024-01-20 12:00:00"

from . import catalog_metrics  # noqa: E402,F401  (registers on import)
from . import catalog_reports  # noqa: E402,F401
from . import catalog_ingest  # noqa: E402,F401
from . import catalog_bundles  # noqa: E402,F401
from . import catalog_streaming  # noqa: E402,F401
from . import catalog_maintained  # noqa: E402,F401
