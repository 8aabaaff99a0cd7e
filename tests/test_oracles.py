"""Every query with a SQL twin gives the twin's rows."""

from __future__ import annotations

import pytest

pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from oracle_check import compare, duck, duck_rows, spark_rows  # noqa: E402

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, folder, con):
    note = compare(spark_rows(entry.queries()[name](spark, folder)), duck_rows(con, ORACLES[name]))
    assert note is None, note


def test_rows_only(spark, folder):
    for name in set(entry.queries()) - set(ORACLES):
        assert entry.queries()[name](spark, folder).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns
