"""Differential test: every registered query against its DuckDB statement (sf0.001)."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

# the library's own queries; the optional operators have tests of their own
NAMES = sorted(n for n in E.queries() if n != "pipeline" and not re.match(r"op\d+_", n))


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    info = compare(name, E.queries()[name](spark, SF_SMALL), con, E.oracle_sql().get(name))
    assert info["status"] in ("ok", "ok~float", "rows-only"), info
    if info["status"] == "rows-only":
        assert info["rows"] == 1
