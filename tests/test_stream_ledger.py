"""A stream that commits to the ledger ends in the tables of one batch load, whatever is interrupted, late or concurrent."""

import random
from datetime import datetime, timedelta

import pytest

from webtraffic.operators.ingest import ingest
from webtraffic.operators.merge import merge_tables
from webtraffic.operators.people import realtime_feed
from webtraffic.schema import HIT
from webtraffic.sources import ledger as L
from webtraffic.sources.tables import load_tables
from webtraffic.streaming import commits as C
from webtraffic.streaming.live import read_hits_stream


def _hits(n=360, days=30):
    """Thirty days in order of time but for one hit in ten, which comes at any time."""
    r = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        t = start + timedelta(days=days * (i if i % 10 else r.randrange(n)) / n, seconds=r.randrange(3600))
        v = r.randrange(12)
        rows.append((f"v{v}" if i % 50 else None, f"s{v}-{t.day // 3}", None, r.choice(["pageview", "click"]), ("/p", "t", r.choice([None, "https://a.example/"])),
                     (f"agent{i}", "en"), (100, 100), f"1.2.3.{i % 200}", None, None, t, i))
    return rows


def _write(spark, rows, path):
    spark.createDataFrame(rows, HIT).coalesce(1).write.mode("append").parquet(path)


def _run(spark, src, out, ck, **kw):
    hits = read_hits_stream(spark, src, fmt="parquet", max_files_per_trigger=1)
    q = C.ledger_sink(hits, out, ck, **kw)
    q.awaitTermination()


def _rows(tables):
    return {n: sorted(map(str, df.drop("dt").collect())) for n, df in tables.frames().items()}


@pytest.fixture()
def dirs(tmp_path):
    return [str(tmp_path / x) for x in ("src", "out", "ck")]


def test_thirty_days_equal_one_load(spark, dirs, tmp_path):
    src, out, ck = dirs
    hits = _hits()
    whole, _ = ingest(spark.createDataFrame(hits, HIT))
    for k in range(4):
        _write(spark, hits[k * 60 : (k + 1) * 60], src)
    _run(spark, src, out, ck, fold_every=2)
    held = load_tables(spark, out)
    before = _rows(held)
    merge_tables(spark, ingest(spark.createDataFrame(hits[240:300], HIT))[0], out)  # a batch load beside the stream
    _write(spark, hits[300:], src)
    _run(spark, src, out, ck, fold_every=2)  # a restart
    assert _rows(load_tables(spark, out)) == _rows(whole)
    assert _rows(held) == before  # a reader keeps its version
    # no keyed state, and a ledger that does not list the batches
    assert not (tmp_path / "ck" / "state").exists()
    state = L.read_state(spark, out)
    assert len(state.loads) == 1 and list(state.streams.values()) == [4]
    # the live feed is the batch answer, without a detail row read
    as_of = max(r[10] for r in hits)
    want = realtime_feed(whole.page_views, whole.visitors, whole.visitor_details, as_of)
    feed = C.live_feed(spark, out, as_of)
    assert sorted(map(str, feed.collect())) == sorted(map(str, want.select(*feed.columns).collect()))
    assert C.live_feed(spark, out).count() > 0
    assert "visitor_details" not in feed._jdf.queryExecution().toString()


def test_a_replayed_batch_counts_once(spark, dirs, tmp_path):
    src, out, ck = dirs
    hits = _hits(80, 2)
    for k in range(2):
        _write(spark, hits[k::2], src)
    _run(spark, src, out, ck)
    state, rows = L.read_state(spark, out), _rows(load_tables(spark, out))
    # as if the driver was lost between the ledger's commit and the stream's own
    for name in ("1", ".1.crc"):
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    _run(spark, src, out, ck)
    assert (tmp_path / "ck" / "commits" / "1").exists()
    assert L.read_state(spark, out) == state
    assert _rows(load_tables(spark, out)) == rows


@pytest.mark.parametrize("at", ["commit", "write_dirs"])
def test_an_interrupted_batch_is_not_seen_and_is_run_again(spark, dirs, monkeypatch, at):
    src, out, ck = dirs
    hits = _hits(80, 2)
    _write(spark, hits[:40], src)
    _run(spark, src, out, ck)
    before = _rows(load_tables(spark, out))
    _write(spark, hits[40:], src)
    with monkeypatch.context() as m:
        def fail(*args, **kw):
            raise RuntimeError("lost")

        m.setattr(L, at, fail)
        with pytest.raises(Exception, match="lost"):
            _run(spark, src, out, ck)
    assert _rows(load_tables(spark, out)) == before
    _run(spark, src, out, ck)
    assert _rows(load_tables(spark, out)) == _rows(ingest(spark.createDataFrame(hits, HIT))[0])


def test_a_batch_of_rejected_hits(spark, dirs):
    src, out, ck = dirs
    _write(spark, [(None, *r[1:]) for r in _hits(10)], src)
    _run(spark, src, out, ck)
    assert C.live_feed(spark, out).collect() == []
    assert all(df.count() == 0 for df in load_tables(spark, out).frames().values())


def test_numbered_loads_keep_one_entry():
    s = L.State().after(("a", 0), {}).after(("a", 1), {}).after("x", {}).after(("b", 5), {})
    assert s.streams == {"a": 1, "b": 5} and s.loads == ("x",) and s.version == 4
    assert s.holds(("a", 1)) and s.holds(("a", 0)) and not s.holds(("a", 2)) and not s.holds(("c", 0)) and s.holds("x") and not s.holds(None)
