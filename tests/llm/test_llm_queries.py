"""The registered queries against their SQL, and the pipeline's stages."""

from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def plain(rows):
    return sorted(tuple("∅" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["op4_sharding", "op8_mixing", "op9_exact_dedup"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from ledgerloom import llm

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    out = llm.QUERIES[name](spark, SF)
    found = con.execute(llm.ORACLES[name]())
    names = [x[0] for x in found.description]
    rows = found.fetchall()
    columns = sorted(names)
    assert sorted(out.columns) == columns
    assert plain(tuple(r[c] for c in columns) for r in out.collect()) == plain(tuple(r[names.index(c)] for c in columns) for r in rows)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    n = docs.count()
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns[: len(names)] == names
        if name in ("quality", "exact_dedup", "simhash"):
            assert 0 < docs.count() <= n
            n = docs.count()
    assert docs.columns == [*names, "token_ids", "n_tokens"]
    assert cp.run(spark, SF).count() == docs.count()
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
