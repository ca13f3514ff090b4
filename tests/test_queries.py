from __future__ import annotations

import os

import pytest

from ledgerloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def plain(rows):
    return sorted(tuple("∅" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    out = catalogue.QUERIES[name](spark, SF)
    rows = out.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    found = con.execute(catalogue.ORACLES[name])
    names = [x[0] for x in found.description]
    want, columns = found.fetchall(), sorted(names)
    assert sorted(out.columns) == columns
    assert plain(tuple(r[c] for c in columns) for r in rows) == plain(tuple(r[names.index(c)] for c in columns) for r in want)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
