from __future__ import annotations

import numpy as np

from ledgerloom.llm import simhash


def words(rng, n):
    return [f"w{k}" for k in rng.integers(0, 100_000, n)]


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_near_copies_of_similarity_0_8_are_found_and_others_stay(spark):
    rng = np.random.default_rng(5)
    rows, similar, other = [], [], []
    for k in range(60):
        base = words(rng, 300)
        copy = list(base)
        # one changed word takes five shingles: 6 leave 266 of 326, which is 0.816; 8 leave 0.762
        for at in range(20, 20 + 40 * (6 if k < 40 else 8), 40) if k < 40 else range(10, 290, 36):
            copy[at] = f"x{k}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        (similar if k < 40 else other).append(2 * k)
    texts = dict(rows)
    assert all(jaccard(texts[i], texts[i + 1]) >= 0.8 for i in similar) and all(jaccard(texts[i], texts[i + 1]) < 0.8 for i in other)
    stay = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(i + 1 not in stay for i in similar) >= 38
    assert {i for i in texts if i % 2 == 0} <= stay and all(i + 1 in stay for i in other)


def test_a_large_group_of_near_copies_becomes_one(spark):
    rng = np.random.default_rng(6)
    base, rows = words(rng, 200), []
    for k in range(300):
        copy = list(base)
        copy[int(rng.integers(0, 200))] = f"x{k}"
        rows.append((k, " ".join(copy)))
    assert [r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]
