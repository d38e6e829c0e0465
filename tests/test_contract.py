"""The driver contract: entry(), queries() and oracle_sql() line up."""

import re

import __spark_entry__ as E


def own(names):
    """The library's own queries, without those of the optional operators."""
    return {n: f for n, f in names.items() if n != "pipeline" and not re.match(r"op\d+_", n)}


def test_keys_line_up():
    assert set(E.oracle_sql()) <= set(E.queries())
    qs, sqls = own(E.queries()), own(E.oracle_sql())
    assert qs, "no queries registered"
    assert set(sqls) <= set(qs)
    assert set(qs) == set(sqls)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns[0] == "total_visitors"
    assert rows[0]["total_sessions"] >= rows[0]["total_visitors"] >= 0


def test_plans_have_no_pair_joins_or_python(spark):
    """No registered batch query plans a cartesian or nested-loop join, or runs Python rows."""
    from conftest import SF_SMALL

    banned = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
              "ArrowEvalPython", "PythonUDF")
    for name, fn in own(E.queries()).items():
        if name.startswith("stream_"):  # these return a read of their sink's output
            continue
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not [b for b in banned if b in plan], name


def test_period_reports_prune_dates_and_push_filters(spark):
    """Period-filtered reports reach the Parquet scans with pushed filters and a date-partition
    filter, and read only the columns they use."""
    from conftest import SF_SMALL

    qs = E.queries()
    for name in ("kpi_row", "total_page_views", "top_pages", "entry_pages", "daily_trends",
                 "referrers", "return_visitors"):
        plan = qs[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
        assert scans, name
        pruned = [s for s in scans if "PartitionFilters: [" in s and "dt#" in s.split("PartitionFilters")[1]]
        assert pruned, name
        assert all("PushedFilters: [" in s for s in pruned), name
        assert not any("ReadSchema: struct<id:bigint,visitor_id:string,session_id:string,"
                       "started_at:timestamp_ntz,ended_at" in s for s in scans), name
