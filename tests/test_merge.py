"""Loads in parts and out of order give the tables of one load."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest

from webtraffic.operators import first_touch as FT
from webtraffic.operators import profiles as P
from webtraffic.operators.ingest import ingest
from webtraffic.operators.merge import merge_tables
from webtraffic.schema import HIT, TABLE_SCHEMAS
from webtraffic.sources import ledger as L
from webtraffic.sources.tables import load_tables, write_tables


def _hits(n=300, days=12):
    r = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        t = start + timedelta(days=r.randrange(days), seconds=r.randrange(86400))
        v = r.randrange(20)
        rows.append((f"v{v}", f"s{v}-{r.randrange(4)}", None, r.choice(["pageview", "click"]), ("/p", "t", r.choice([None, "https://a.example/"])),
                     (f"agent{i}", "en"), (100, 100), f"1.2.3.{i % 200}", None, None, t, i))
    return rows


def test_parts_in_any_order_equal_one_load(spark, tmp_path):
    hits = _hits()
    whole, _ = ingest(spark.createDataFrame(hits, HIT))
    random.Random(5).shuffle(hits)
    out = str(tmp_path / "t")
    for k in range(4):
        part, _ = ingest(spark.createDataFrame(hits[k::4], HIT))
        merge_tables(spark, part, out)
    back = load_tables(spark, out).frames()
    for name, df in whole.frames().items():
        got = sorted(map(str, back[name].select(*df.columns).collect()))
        assert got == sorted(map(str, df.collect())), name
    # rows lie in the directory of their date, once
    v = load_tables(spark, out, names=("visitors",)).visitors
    assert v.where("dt <> to_date(last_seen)").count() == 0
    assert v.select("visitor_id").distinct().count() == v.count()


def test_untouched_dates_keep_their_files(spark, tmp_path):
    hits = _hits()
    out = tmp_path / "t"
    first, _ = ingest(spark.createDataFrame(hits, HIT))
    merge_tables(spark, first, str(out))
    files = lambda: {f: f.stat().st_mtime_ns for f in (out / "sessions").rglob("*.parquet")}
    before = files()
    late = [("new", "new-1", None, "pageview", ("/p", "t", None), ("a", "en"), (1, 1), "1.2.3.4", None, None, datetime(2024, 2, 1), 9999)]
    more, _ = ingest(spark.createDataFrame(late, HIT))
    merge_tables(spark, more, str(out))
    after = files()
    assert before.items() <= after.items() and len(after) == len(before) + 1


def _rows(spark, out):
    return {n: sorted(map(str, df.drop("dt").collect())) for n, df in load_tables(spark, str(out)).frames().items()}


def _parts(spark, n=3):
    hits = _hits(90, 3)
    return [ingest(spark.createDataFrame(hits[k::n], HIT))[0] for k in range(n)]


def test_a_repeated_load_changes_nothing(spark, tmp_path):
    a, b, _ = _parts(spark)
    merge_tables(spark, a, str(tmp_path))
    state = merge_tables(spark, b, str(tmp_path))
    once = _rows(spark, tmp_path)
    again, _ = ingest(spark.createDataFrame(_hits(90, 3)[0::3], HIT).repartition(3))  # the same rows, dealt otherwise
    assert merge_tables(spark, again, str(tmp_path)) == state
    assert _rows(spark, tmp_path) == once
    # a name of its own makes it another load
    assert merge_tables(spark, a, str(tmp_path), load_id="again").version == state.version + 1
    assert merge_tables(spark, b, str(tmp_path), load_id="again").version == state.version + 1
    assert len(_rows(spark, tmp_path)["page_views"]) > len(once["page_views"])


def test_a_repeated_load_makes_no_profiles_and_leaves_nothing(spark, tmp_path, monkeypatch):
    a, _, _ = _parts(spark)
    merge_tables(spark, a, str(tmp_path))
    there = {t: sorted(p.name for p in (tmp_path / t).iterdir()) for t in TABLE_SCHEMAS if (tmp_path / t).exists()}
    monkeypatch.setattr(P, "write_profiles", None)
    merge_tables(spark, a, str(tmp_path))
    assert there == {t: sorted(p.name for p in (tmp_path / t).iterdir()) for t in there}


def test_keys_do_not_go_through_the_driver(spark):
    a, b, _ = _parts(spark)
    plans = [FT.losing_visitors(a.sessions, b.sessions), P.detail_profiles(a.visitor_details)]
    assert not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in plans)


def test_an_interrupted_load_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    a, b, _ = _parts(spark)
    merge_tables(spark, a, str(tmp_path))
    before = _rows(spark, tmp_path)
    for at in ("commit", "write_dirs"):  # all written but not published; first table written only
        with monkeypatch.context() as m:
            real, calls = getattr(L, at), []

            def fail(*args, real=real, calls=calls, at=at):
                calls.append(1)
                if at == "commit" or len(calls) > 1:
                    raise RuntimeError("lost")
                return real(*args)

            m.setattr(L, at, fail)
            with pytest.raises(RuntimeError, match="lost"):
                merge_tables(spark, b, str(tmp_path))
        assert _rows(spark, tmp_path) == before
    merge_tables(spark, b, str(tmp_path))
    other = tmp_path / "other"
    for part in (a, b):
        merge_tables(spark, part, str(other))
    assert _rows(spark, tmp_path) == _rows(spark, other)


def test_a_reader_keeps_its_version(spark, tmp_path):
    a, b, _ = _parts(spark)
    merge_tables(spark, a, str(tmp_path))
    before = _rows(spark, tmp_path)
    held = load_tables(spark, str(tmp_path)).frames()
    merge_tables(spark, b, str(tmp_path))
    assert {n: sorted(map(str, df.drop("dt").collect())) for n, df in held.items()} == before


def test_two_loads_at_once_are_both_in(spark, tmp_path):
    a, b, c = _parts(spark)
    merge_tables(spark, c, str(tmp_path / "t"))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda part: merge_tables(spark, part, str(tmp_path / "t")), (a, b)))
    for part in (c, a, b):
        merge_tables(spark, part, str(tmp_path / "other"))
    assert _rows(spark, tmp_path / "t") == _rows(spark, tmp_path / "other")
    assert L.read_state(spark, str(tmp_path / "t")).version == 3


def test_a_taken_version_is_a_conflict(spark, tmp_path):
    L.commit(spark, str(tmp_path), L.State(1, ("a",)))
    with pytest.raises(L.Conflict):
        L.commit(spark, str(tmp_path), L.State(1, ("b",)))
    assert L.read_state(spark, str(tmp_path)).loads == ("a",)


def test_compact_and_vacuum_keep_the_rows(spark, tmp_path):
    for part in _parts(spark):
        merge_tables(spark, part, str(tmp_path))
    before = _rows(spark, tmp_path)
    for table in ("page_views", "visitor_details"):
        state = L.compact(spark, str(tmp_path), table, TABLE_SCHEMAS[table])
        assert all(len(p) == 1 for p in state.dirs[table].values())
    assert L.vacuum(spark, str(tmp_path)) == []  # too young
    assert L.vacuum(spark, str(tmp_path), versions=1, older_than_s=0)
    assert _rows(spark, tmp_path) == before
    live = {f"{tmp_path}/{t}/{p}" for t, d in state.dirs.items() for paths in d.values() for p in paths}
    assert {str(f.parent) for f in tmp_path.rglob("*.parquet")} == live


def test_plain_tables_are_taken_over(spark, tmp_path):
    a, b, _ = _parts(spark)
    write_tables(a, str(tmp_path / "plain"))
    merge_tables(spark, b, str(tmp_path / "plain"))
    for part in (a, b):
        merge_tables(spark, part, str(tmp_path / "t"))
    assert _rows(spark, tmp_path / "plain") == _rows(spark, tmp_path / "t")
