"""Suffix dedup of very many rows alike, and the registered query against brute force."""

from __future__ import annotations

import hashlib
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import suffix_dedup

SF = "/root/testdata/sf0.001"


def test_many_rows_alike(spark):
    text = " ".join(f"w{k * k % 9973}" for k in range(1000))
    rows = [(7, text)] * 3000 + [(None, text)] * 2000 + [(8, "x" + text[100:900] + "y"), (9, "short"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect())
    n = len(text)
    assert found == Counter({(7, n, n, 1): 3000, (None, n, n, 1): 2000, (8, 802, 800, 1): 1, (9, 5, 0, 0): 1, (None, 0, 0, 0): 1})


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    seen = Counter(hash(t[i : i + 400]) for _, t in docs for i in range(len(t) - 399))
    want = []
    for doc_id, t in docs:
        spans = []
        for i in range(len(t) - 399):
            if seen[hash(t[i : i + 400])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 400
                else:
                    spans.append([i, i + 400])
        kept = b"".join(t[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(t)], strict=True))
        want.append((doc_id, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [tuple(s) for s in spans]))
    out = suffix_dedup.op10_suffix_dedup(spark, SF)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, [tuple(s) for s in r.spans]) for r in out.collect()]
    assert sorted(got) == sorted(want) and out.filter(F.col("repeated") != (F.col("n_removed") > 0)).count() == 0


@pytest.mark.parametrize("most", [suffix_dedup.BUCKET_WINDOWS, 300])
def test_buckets_dealt_over_parts(spark, monkeypatch, most):
    """One passage in very many contexts, whole and in pieces, with buckets met in one part and in many."""
    import random

    monkeypatch.setattr(suffix_dedup, "BUCKET_WINDOWS", most)
    draw = random.Random(5)
    passage = bytes(draw.choices(b"abcdefgh ", k=900)).decode()
    noise = lambda: bytes(draw.choices(b"ijklmnop ", k=draw.randrange(300))).decode()
    texts = []
    for k in range(150):
        a = draw.randrange(500)
        piece = passage[a : a + draw.randrange(200, 900)]
        texts.append(noise() + piece + (piece[:410] if k % 9 == 0 else "") + noise())
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = {k: len({j for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1 for j in range(i, i + 400)}) for k, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df).collect()} == want
