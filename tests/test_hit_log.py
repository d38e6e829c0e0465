"""The stored hit logs hold the rows of the events, built after the shuffle, and compressed where a batch reads them."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import webtraffic.plans.catalog  # noqa: F401  (loads the catalog's parts in order)
from webtraffic.plans.catalog_ingest import json_hits, raw_hits, spread_events
from webtraffic.schema import HIT
from webtraffic.sources.hits import raw_hits_from_events, read_hits


def _events(spark, path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * i, microseconds=i), i % 41, ("view", "error", "signup")[i % 3], 0.5, "{}") for i in range(2000)]
    rows += rows[:50] + [(5000, None, 3, "view", None, None), (5001, datetime(2024, 1, 1), None, None, None, None), (5002, None, None, "error", None, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .write.parquet(os.path.join(path, "events.parquet"))


def _rows(df):
    return sorted(map(repr, df.select(*HIT.fieldNames()).collect()))


def _files(path):
    return [os.path.join(path, n) for n in os.listdir(path) if n.startswith("part-")]


def test_logs_hold_every_hit_and_the_batch_log_is_compressed(spark, tmp_dir):
    _events(spark, tmp_dir)
    want = _rows(raw_hits_from_events(spark.read.parquet(f"{tmp_dir}/events.parquet")))
    assert len(want) == 2053 and _rows(raw_hits(spark, tmp_dir)) == want
    text, packed = json_hits(spark, tmp_dir), json_hits(spark, tmp_dir, packed=True)
    assert _rows(read_hits(spark, text)) == want and _rows(read_hits(spark, packed)) == want
    assert all(n.endswith(".json") for n in _files(text)) and all(n.endswith(".json.gz") for n in _files(packed))
    assert sum(map(os.path.getsize, _files(packed))) * 4 < sum(map(os.path.getsize, _files(text)))


def test_narrow_rows_are_shuffled_and_sorted(spark, tmp_dir):
    _events(spark, tmp_dir)
    hits = raw_hits_from_events(spread_events(spark, tmp_dir)).withColumn("dt", F.to_date("received_at"))
    plan = hits._jdf.queryExecution().optimizedPlan()
    wide, _, below = plan.toString().partition("Repartition")
    assert "Mozilla" in wide and "Mozilla" not in below and "props" not in below.split("Relation")[0]
    assert plan.outputOrdering().toString().startswith("List(dt#")  # the writer's order: it need not sort
