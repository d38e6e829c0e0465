"""Queries of this subpackage that have SQL, against DuckDB on the smallest tables."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[2]
sys.path.insert(0, str(ROOT / "tools"))

from check_oracle import compare, duck  # noqa: E402

from webtraffic.llm.queries import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    info = compare(name, QUERIES[name](spark, SF), duck(SF), SQL[name])
    assert info["status"] in ("ok", "ok~float"), info


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_read_the_tables(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
