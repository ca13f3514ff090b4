from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import simhash
from ledgerloom.llm.common import Scratch


def test_every_pair_that_shares_a_variant_is_verified(spark, monkeypatch):
    """400 texts that are all a little less similar than it takes, so that very many share a variant."""
    rng, rows, pairs = np.random.default_rng(7), [], []
    base = [f"w{k}" for k in rng.integers(0, 100_000, 300)]
    for k in range(200):
        spots = rng.permutation(np.arange(5, 295, 10))
        for side in range(2):
            copy = list(base)
            for j, at in enumerate(spots[:7]):
                copy[at] = f"x{k}-{j if j < 4 else (side, j)}"
            rows.append((len(rows), " ".join(copy)))
    keep = Scratch.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        if name.startswith("pairs"):
            pairs.extend((r.u, r.v) for r in out.collect())
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.near_dedup(df, least=0.95).count() == len(rows)
    node = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    sigs = np.array([simhash.signature(np.unique(simhash.shingle_hashes(t.encode(), 5))) for _, t in rows])
    parts, want = simhash.bit_parts(sigs), set()
    for i in range(len(rows)):
        near = (np.bitwise_count(parts[i] ^ parts[i + 1 :]) <= simhash.PART_RADIUS).any(axis=1) & (np.bitwise_count(sigs[i, 0] ^ sigs[i + 1 :, 0]) <= simhash.FAR)
        want |= {frozenset((node[i], node[int(j)])) for j in np.flatnonzero(near) + i + 1}
    assert len(want) > 15_000
    assert {frozenset(p) for p in pairs} == want


def test_linked_nodes_do_not_hide_the_partner_of_another():
    """Ten nodes known to be linked share a part with one other node: it meets all ten at the end."""
    sent = {"part": [], "variants": [], "nodes": [], "words": [], "marks": [], "flips": []}
    nodes = np.arange(1, 12, dtype=np.int64)
    label = np.where(nodes <= 10, 1, nodes)
    values = [np.full(11, 5, np.uint64), nodes, np.zeros(11, np.uint64), nodes ^ label, np.zeros(11, np.uint8)]
    columns = [pa.array([0], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in values)]
    batch = pa.RecordBatch.from_arrays(columns, names=list(sent))

    def pairs(meet):
        return sorted({(u, v) for b in meet(iter([batch])) for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True)})

    few = pairs(simhash._meet_parts(simhash.ALL_PAIRS, simhash.NEXT))
    assert {(n, n) for n in nodes.tolist()} <= set(few) and (1, 11) in few
    assert pairs(simhash._meet_parts(None)) == [(n, 11) for n in range(1, 11)]
