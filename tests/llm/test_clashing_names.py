"""Columns of any name come through every stage, and odd rows through the whole pipeline."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing

SF = "/root/testdata/sf0.001"
CLASH = ["seed", "_source", "size", "score", "_x_hash", "copies", "rate", "target", "_x_len", "_x_c1", "copy_no", "u", "node", "hashes", "family", "_x_text"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_stages_keep_columns(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = docs.columns
    odd = [(None, None, None, None, None), (9001, "", "en", None, 0), (9001, "", "en", None, 0), (9002, " \n\t", "en", "a", 3), (9003, "one line. " * 20_000, "en", "a", 200_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASH}).cache()
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF).cache()
        assert out.columns == [*names, *CLASH, *(["token_ids", "n_tokens"] if name == "bpe" else [])], name
        rows = out.collect()
        assert all(r[c] == f"{c}:{'?' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASH), name
        if name in ("mixing", "bpe"):
            assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
        if name == "bpe":
            assert len(rows) == docs.count()


def test_mix_replaces_its_own_names_only(spark):
    rows = [(1, "a b c", "x", "s", "t"), (2, "d e", "y", "s", "t"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, seed string, size string")
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "source", "seed", "size", "source_size", "target", "rate", "copies"]
    assert {r.doc_id: (r.seed, r.size) for r in out.collect()} == {1: ("s", 3), 2: ("s", 2), None: (None, 0)}
