"""Sources and sinks: JSON hits (S01), table round trip (S02/S03), report sink."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from webtraffic.operators.ingest import ingest
from webtraffic.plans import report as R
from webtraffic.sources.fixtures import fixture_tables
from webtraffic.sources.hits import fixture_geo_ranges, fixture_raw_hits, read_hits
from webtraffic.sources.tables import load_tables, write_tables


def test_json_hits_round_trip(spark, tmp_dir):
    raw = fixture_raw_hits(spark, SF_SMALL)
    path = os.path.join(tmp_dir, "hits")
    raw.write.json(path)
    with open(os.path.join(path, "bad.json"), "w") as f:
        f.write('{"visitorId": "x", "sessionId": \n')  # a broken record
    back = read_hits(spark, path)
    tables, rejected = ingest(back, fixture_geo_ranges(spark, SF_SMALL))
    direct, direct_rej = ingest(raw, fixture_geo_ranges(spark, SF_SMALL))
    assert tables.sessions.count() == direct.sessions.count()
    assert tables.visitor_details.count() == direct.visitor_details.count()
    # The broken record has no ids and is rejected like any hit without a visitor.
    assert rejected.count() == direct_rej.count() + 1


def test_tables_round_trip_and_pruning(spark, tmp_dir):
    t = fixture_tables(spark, SF_SMALL, materialize=False)
    out = os.path.join(tmp_dir, "tables")
    write_tables(t, out)
    back = load_tables(spark, out, names=tuple(t.frames()))
    for name, df in t.frames().items():
        assert back.frames()[name].select(*df.columns).exceptAll(df).count() == 0
        entries = [e for e in os.listdir(os.path.join(out, name)) if not e.startswith((".", "_"))]
        assert entries and all(e.startswith("dt=") for e in entries)
    plan = back.sessions.where(F.col("dt") >= "2024-01-20")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_write_report(spark, tmp_dir):
    t = fixture_tables(spark, SF_SMALL)
    out = os.path.join(tmp_dir, "report")
    R.write_report(R.basic_stats(t, "all"), out, R.BASIC_KEYS)
    files = [f for f in os.listdir(os.path.join(out, "report.json")) if f.startswith("part-")]
    with open(os.path.join(out, "report.json", files[0])) as f:
        doc = json.loads(f.read())
    assert list(doc) == R.BASIC_KEYS
    assert doc["totalSessions"] == t.sessions.count()
    assert len(doc["topPages"]) == 10
    assert os.path.isdir(os.path.join(out, "topPages"))


def test_staged_ingest_equals_lazy(spark):
    raw = fixture_raw_hits(spark, SF_SMALL)
    lazy, _ = ingest(raw, fixture_geo_ranges(spark, SF_SMALL))
    staged, _ = ingest(raw, fixture_geo_ranges(spark, SF_SMALL), stage=True)
    for name, df in lazy.frames().items():
        other = staged.frames()[name]
        assert df.count() == other.count()
        assert df.exceptAll(other).count() == 0
