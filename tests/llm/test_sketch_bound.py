from __future__ import annotations

import numpy as np

from ledgerloom.llm import simhash
from ledgerloom.llm.common import Scratch


def test_sketches_rule_out_no_similar_pair_and_most_others():
    rng, could, far = np.random.default_rng(3), [], []
    for n in (0, 1, 9, 150, 1500):
        for shared in {*range(0, n + 1, max(1, n // 40)), n}:
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate((a[:shared], rng.integers(0, 2**63, n - shared).astype(np.uint64)))
            # exactly at the similarity, too
            likeness = shared / (2 * n - shared) if n else 1.0
            for least in (likeness, 0.8, 0.95):
                may = bool(simhash.may_be_similar(simhash.sketch(a)[None], simhash.sketch(b)[None], least)[0])
                (could if likeness >= least else far).append((may, likeness, least))
    assert all(may for may, _, _ in could)
    assert not any(may for may, likeness, least in far if likeness < least - 0.2)


def test_a_crowd_that_is_not_similar_is_not_paired_up(spark, monkeypatch):
    """800 texts a little under the similarity, 20 of them with a partner over it: every pair is judged,
    but pairs that sketches settle make no rows."""
    rng, rows, listed = np.random.default_rng(7), [], {}
    base = [f"w{k}" for k in rng.integers(0, 100_000, 300)]
    for k in range(800):
        copy = list(base)
        for j, at in enumerate(rng.permutation(np.arange(5, 295, 10))[:7]):
            copy[at] = f"x{k}-{j}"
        rows.append((k, " ".join(copy)))
    for k in range(20):
        rows.append((800 + k, rows[37 * k][1].replace(base[299], f"y{k}")))
    keep = Scratch.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        if name.startswith("pairs"):
            listed[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(df, least=0.95).collect()) == list(range(800))
    sigs = np.array([simhash.signature(np.unique(simhash.shingle_hashes(t.encode(), 5))) for _, t in rows])
    parts, candidates = simhash.bit_parts(sigs), 0
    for i in range(len(rows)):
        near = (np.bitwise_count(parts[i] ^ parts[i + 1 :]) <= simhash.PART_RADIUS).any(axis=1) & (np.bitwise_count(sigs[i, 0] ^ sigs[i + 1 :, 0]) <= simhash.FAR)
        candidates += int(near.sum())
    # the first two rounds list a few a node; of the rest, only what sketches leave open
    assert candidates > 40_000 and listed["pairs-all"] < 1_000
