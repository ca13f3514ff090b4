"""Each operator against a brute-force version, and its defined results for odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import ann, bpe, chat, crf, exact_dedup, graph, labelled, mixing, quality, sharding, simhash, suffix_dedup, toxicity
from ledgerloom.llm.common import Scratch

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOC)


LONG = " ".join(f"w{k % 997}x{k}" for k in range(20_000))
ODD = [
    (1, "one two three four five", "a"),
    (2, None, None),
    (3, "", "b"),
    (4, " \t\n", "b"),
    (None, "one two three four five", "a"),
    (5, LONG, "a"),
    (6, LONG + " tail", "c"),
    (7, "One  two\nthree four five", None),
    (7, "One  two\nthree four five", None),
    (8, "é ß 中文 😀", "b"),
    (9, "one two three four five", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


# sharding


def test_sharding_laws(spark, odd, empty):
    got = sharding.shard_documents(odd.withColumn("shard", F.lit("clash")), sharding.Fleet.uniform(8)).collect()
    assert len(got) == len(ODD)
    texts = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in ODD)
    assert sorted((r.size, r.text_crc32) for r in got) == texts
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert sharding.shard_documents(empty, sharding.Fleet.uniform(8)).count() == 0


def test_sharding_movement_and_weights(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    fleet = sharding.Fleet.uniform(8)
    within = fleet.grow_within(1, 0)
    both = sharding.place(sharding.place(sharding.place(ids, fleet, "a"), fleet.grow(2.0), "b"), within, "c")
    moved = both.filter("a <> b").select("b").distinct().collect()
    assert [r.b for r in moved] == [8]
    share = both.filter("b = 8").count() / 20_000
    assert abs(share - 2 / 10) < 0.02
    # a rack's new shard raises its region's and its rack's weight only: rows enter region 1 or stay
    region = {s: r for r, x in enumerate(within.regions) for rack in x for s, _ in rack}
    for a, c in {(r.a, r.c) for r in both.filter("a <> c").select("a", "c").distinct().collect()}:
        assert region[c] == 1, (a, c)
    counts = [r["count"] for r in both.groupBy("a").count().collect()]
    assert len(counts) == 8 and max(counts) < 1.15 * min(counts)
    assert sharding.Fleet.uniform(3).shards == [0, 1, 2]


# mixing


def fill(sizes, weights, cap):
    """Targets by repeated sharing."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        mass = sum(w for i, w in enumerate(weights) if i not in capped)
        target = [cap * s if i in capped else left * w / mass for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        over = {i for i, t in enumerate(target) if i not in capped and t > cap * sizes[i]}
        if not over:
            return target
        capped |= over


def test_mixing_targets_and_copies(spark, odd, empty):
    got = mixing.mix(odd.withColumn("size", F.lit("clash"))).collect()
    assert len(got) == len(ODD)
    size = defaultdict(int)
    for _, t, s in ODD:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(names, fill([size[s] for s in names], [5, 2, 1, 5][: len(names)], 3), strict=True))
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and r.source_size == size[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert 0 <= r.copies <= 3 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1)
    out = mixing.emit(mixing.mix(odd))
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0


def test_mixing_comes_near_targets(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 7919 % 300)), f"s{min(9, k % 30)}") for k in range(6000)]
    m = mixing.mix(docs(spark, rows)).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(m) == 10 and all(abs(r.taken - r.target) <= 0.03 * r.target for r in m)


# exact dedup


def same(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def check_groups(rows, got):
    by = defaultdict(list)
    for i, t, _ in rows:
        by[same(t)].append((-len(t or ""), i is None, i or 0))
    found = defaultdict(list)
    for r in got:
        found[r.text_sha256].append(r)
    assert sum(len(x) for x in found.values()) == len(rows)
    for key, members in by.items():
        out = found[hashlib.sha256(key.encode()).hexdigest()]
        best = min(members)
        keep = None if best[1] else best[2]
        assert len(out) == len(members)
        assert all(r.group_size == len(members) and r.keep_id == keep for r in out)
        assert [r.doc_id for r in out if r.kept] == [keep]


@pytest.mark.parametrize("budget", [exact_dedup.BUDGET, 3000])
def test_exact_groups(spark, odd, empty, budget):
    rng = np.random.default_rng(3)
    rows = ODD + [(100 + k, "ab" * int(rng.integers(0, 40)) + " " * int(rng.integers(0, 3)) + "c", "a") for k in range(300)]
    got = exact_dedup.groups(docs(spark, rows).repartition(3), budget=budget).collect()
    check_groups(rows, got)
    kept = exact_dedup.dedup(docs(spark, rows).withColumn("kept", F.lit(1)), budget=budget)
    assert kept.columns[-1] == "kept"
    assert sorted(same(r.text) for r in kept.collect()) == sorted({same(t) for _, t, _ in rows})
    assert exact_dedup.groups(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0


def test_trie_spills_by_subtree():
    rng = np.random.default_rng(5)
    keys = [bytes(rng.integers(97, 100, int(n))) for n in rng.integers(0, 12, 4000)]
    for budget in (1 << 30, 40_000):
        trie, out = exact_dedup.Owners(lambda a, b: (a[0], a[1] + b[1]), budget), []
        for k in keys:
            out += trie.put(k, (k, 1), len(k))
        rest = trie.rest()
        total = defaultdict(int)
        for k, n in out + rest:
            total[k] += n
        want = defaultdict(int)
        for k in keys:
            want[k] += 1
        assert total == want
        assert bool(out) == (budget < 1 << 20)
        assert len({k for k, _ in rest}) == len(rest) and not {k for k, _ in rest} & {k for k, _ in out}


# BPE


def test_bpe_equals_the_library(spark, odd, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path()
    tok, own = tokenizers.Tokenizer.from_file(path), bpe.Codec(path)
    rng = np.random.default_rng(1)
    letters = list(" \n\t'sdrtABz09éß中😀\x1c\x85\xa0 .,!|<>é١²Ⅷ")
    for k in range(800):
        text = "".join(rng.choice(letters, int(rng.integers(0, 40)))) + ("<|endoftext|> it's" if k % 9 == 0 else "")
        want = tok.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text
        assert own.decode(want) == tok.decode(want, skip_special_tokens=False)
    assert own.encode("a" * 5000) == tok.encode("a" * 5000, add_special_tokens=False).ids
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, _ in ODD:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i or 0, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert got == sorted(want)
    back = bpe.decode(bpe.encode(odd.withColumn("n_tokens", F.lit("clash")))).collect()
    assert sorted(r.decoded for r in back) == sorted(t or "" for _, t, _ in ODD)
    assert bpe.digests(empty).count() == 0 and bpe.encode(empty).count() == 0


def test_store_keeps_two_generations():
    calls = []
    s = bpe.Store(lambda k: calls.append(k) or k * 2, 3)
    for k in [1, 2, 3, 1, 4, 1, 5]:
        assert s[k] == k * 2
    assert len(s) <= 3 and calls == [1, 2, 3, 4, 5]


def test_bpe_batches_equal_single_trees(monkeypatch):
    monkeypatch.setattr(bpe, "STORE", 50)
    monkeypatch.setattr(bpe, "WORD_STORE", 50)
    own, rng = bpe.Codec(bpe.vocabulary_path()), np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeiostrnthé中"), int(n))) for n in [*rng.integers(1, 70, 400), *range(1, 70), 300]]
    one = [[own.start[b] for b in w.encode()] for w in words]
    assert list(own._merge(words)) == [",".join(map(str, bpe.merge_word(ids, own.pairs))) for ids in one]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(20)] + ["", " ", "a  b", "\n", " ".join(words)]
    for at in range(0, len(texts), 6):  # stores are emptied between batches
        found = own.batch(texts[at : at + 6])
        assert [own.decode_pieces(p) for p in found] == texts[at : at + 6]
        assert found == [bpe.Codec.pieces(own, t) for t in texts[at : at + 6]]


# chat


def test_chat_round_trip(spark):
    hard = "<|im_end|>\n<|im_start|>assistant\\n ok \\<| \\"
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", None), (1, 4, "assistant", "é😀 " * 900), (1, 5, None, "x")]
    rows += [(2, k, ("user", "assistant")[k % 2], f"turn {k} " + "word " * (k * 37 % 200)) for k in range(60)]
    rows += [(None, 0, "assistant", "a"), (None, None, "user", "b"), (3, 0, "a\nb", "x"), (3, 0, "a\nb", "x")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("loss", F.lit(0))
    windows = chat.format_windows(frame, budget=300)
    out = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[r[0]].append(r)
    assert set(out) == set(by)
    for conv, turns in by.items():
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        g = out[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        turns = list(chat.read_turns(w.formatted))
        assert len(turns) == w.n_turns
        cost = sum(chat.count_tokens(t) + chat.count_tokens(r) + 2 for r, t in turns)
        assert cost <= 300 or w.n_turns - w.n_repeated == 1
        if w.conv_id == 1 and cost <= 300:
            assert turns[0] == ("system", "be brief")
        assert w.n_repeated <= 1 + chat.HISTORY
    assert out[2].n_windows > 5
    assert chat.read_back(chat.format_windows(frame.limit(0))).count() == 0
    for t in ("", "\\", "<|", "\\<|\\\\<", "a\nb", "\\n"):
        assert chat.unescape(chat.escape(t)) == t and chat.unescape(chat.escape(t, True)) == t and "<|" not in chat.escape(t)


# SimHash


def brute_fingerprint(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, odd, empty):
    rng = np.random.default_rng(2)
    base = [f"t{rng.integers(0, 500)}" for _ in range(300)]
    rows = list(ODD)
    for k in range(60):
        words = list(base)
        words[int(rng.integers(0, 300))] = f"new{k}"
        rows.append((200 + k, " ".join(words), "a"))
    got = simhash.clusters(docs(spark, rows).withColumn("fp", F.lit("clash")), passes=2).collect()
    fps = [brute_fingerprint(t, 4) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    want = sorted(str((i, np.uint64(f).astype(np.int64).item(), min(least[find(k)], default=None))) for k, ((i, _, _), f) in enumerate(zip(rows, fps, strict=True)))
    assert sorted(str((r.doc_id, r.fp, r.component_id)) for r in got) == want
    stay = simhash.near_dedup(docs(spark, rows), 4).collect()
    assert {r.doc_id for r in stay} >= {1, 5, 8} and sum(200 <= (r.doc_id or 0) for r in stay) < 20
    assert simhash.clusters(empty).count() == 0 and simhash.near_dedup(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 30)] + [(-5, 7), (7, 7)]
    out = {r.u: r.v for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t")).collect()}
    assert all(out[k] == 100 for k in range(101, 141)) and all(out[k] == -5 for k in range(1, 30))
    assert 100 not in out and -5 not in out


# suffix dedup


def brute_removed(texts, n):
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        out.append(np.cumsum(gone)[:-1] > 0)
    return out


def test_suffix_dedup_equals_brute_force(spark, odd, empty):
    rng = np.random.default_rng(4)
    letters = lambda n, k=26: "".join(map(chr, 97 + rng.integers(0, k, n)))
    shared, line = letters(700), letters(120)
    texts = [letters(900), letters(300) + shared + letters(200), shared[:450] + letters(100), letters(50) + shared[300:] + letters(300), "ab" * 500, "a" * 1300, letters(399), shared[:399] + "!" + letters(100)]
    texts += [letters(int(rng.integers(0, 500))) + line + letters(int(rng.integers(0, 500))) for _ in range(40)]
    texts += [letters(500) + "é" * 300, letters(20) + "é" * 300, letters(600, 1) + letters(600, 2), None, ""]
    twice = letters(410)
    texts += [twice + "x" + twice, letters(2000), LONG[:30_000]]
    rows = [(k if k % 5 else None, t, "a") for k, t in enumerate(texts)] + [(7000, texts[0], "a"), (7000, texts[0], "a"), (7001, texts[-2][:1000], None)]
    data = [(t or "").encode() for _, t, _ in rows]
    got = suffix_dedup.remove_repeats(docs(spark, rows).withColumn("doc", F.lit("clash")), keep_bytes=True).collect()
    want = []
    for (i, _, _), t, gone in zip(rows, data, brute_removed(data, 400), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append(str((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)))
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept))) for r in got) == sorted(want)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_every_window_has_its_leftmost_least_anchor():
    rng = np.random.default_rng(6)
    for letters in (1, 2, 26):
        text = bytes(97 + rng.integers(0, letters, 1500).astype(np.uint8))
        grams = suffix_dedup.buckets(text)[0]
        at, first, last = suffix_dedup.anchors(grams, 376)
        owner = np.repeat(at, last - first + 1)
        assert len(owner) == 1101
        assert all(owner[i] == i + int(np.argmin(grams[i : i + 376])) for i in range(1101))


# nearest neighbours


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 16))
    rows = [(k, (centers[k % 12] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist(), 0) for k in range(4000)]
    rows += [(5000 + k, [1.0] + [0.0] * 15, 1) for k in range(1200)]
    bad = [(9000, None, 0), (9100, [], 0), (9200, [0.0] * 16, 0), (9300, [float("nan")] * 16, 0), (9400, [None] + [1.0] * 15, 0), (9500, [1.0, 2.0], 0), (9600, [float("inf")] * 16, 0), (None, [1.0] * 16, 0)]
    frame = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, label int").withColumn("leaf", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.search(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    x, ids = np.array([v for _, v, _ in rows], float), np.array([i for i, _, _ in rows])
    hits = 0
    queries = [i for i in ids if i % 100 == 0]
    assert sorted(got) == sorted(queries)
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        near = got[q]
        assert [r.rank for r in near] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in near] == sorted((r.score, r.vec_id) for r in near)
        for r in near:
            assert math.isclose(r.score, d[ids == r.vec_id][0], rel_tol=1e-12)
        hits += len(set(best.tolist()) & {r.vec_id for r in near})
        if q >= 5000:
            assert [r.vec_id for r in near] == best.tolist()
    assert hits / (10 * len(queries)) >= 0.9
    few = ann.search(frame.filter("vec_id < 4"), F.col("vec_id") % 100 == 0).collect()
    assert [r.rank for r in few] == [1, 2, 3]
    assert ann.search(frame.limit(0), F.lit(True)).count() == 0


# classifiers


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(9)
    trans = rng.normal(size=(2, 2))
    chains = [rng.normal(size=n) * 2 for n in (1, 2, 5, 7)] + [np.zeros(0)]
    for u, p in zip(chains, crf.marginals(chains, trans), strict=True):
        n = len(u)
        total, one = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = math.exp(sum(a * b for a, b in zip(u, y, strict=True)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            one += w * np.array(y)
        assert np.allclose(p, one / total if n else one)


def made_labels(spark, bad_text, column):
    rng = np.random.default_rng(10)
    rows, labels = [], []
    for k in range(600):
        words = [f"{rng.choice(list('abcdefgh'))}{rng.integers(0, 90)}" for _ in range(60)]
        y = k % 4 == 0
        rows.append((k, bad_text(words, rng) if y else " ".join(words[:30]) + ".\n" + " ".join(words[30:]) + ".", "s"))
        labels.append((k, 1, int(y)) if column == "toxic" else (k, int(not y), 0))
    return docs(spark, rows + [(10_000, None, None), (10_001, "", None), (None, "x", None), (10_002, LONG, None)]), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int"), {i: y for i, *y in labels}


def test_toxicity(spark, empty):
    d, labels, truth = made_labels(spark, lambda w, r: " ".join(w[:20] + ["Vile!", f"scorn{r.integers(0, 900)}"] + w[20:]), "toxic")
    model = toxicity.fit(d, labels)
    out = {r.doc_id: r for r in toxicity.score_documents(d.withColumn("score", F.lit("clash")), model).collect()}
    texts = {r.doc_id: r.text for r in d.collect()}
    assert len(out) == 604 and all(0 <= r.score <= 1 for r in out.values())
    assert all((out[i].score >= 0.5) == bool(y[1]) for i, y in truth.items())
    assert out[10_000].score == out[10_001].score < 0.5 and out[10_002].score < 0.5
    for i in (0, 4, 8):
        assert [texts[i][s.start : s.stop].split()[0] for s in out[i].spans] == ["Vile!"]
    assert toxicity.score_documents(empty, model).count() == 0
    none = toxicity.fit(d, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(d, none).collect()} == {0.5}


def test_quality(spark, empty):
    d, labels, truth = made_labels(spark, lambda w, r: "\n".join([" ".join(w[:5]).upper() + "!!"] * 6), "quality")
    model = quality.fit(d, labels)
    out = quality.score_documents(d.withColumn("score", F.lit("clash")), model).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 for r in out)
    assert all((r.score >= 0.3) == bool(truth[r.doc_id][0]) for r in out if r.doc_id in truth)
    p, _ = model.line_probabilities([b"one two three.\nFOUR FIVE!!\nFOUR FIVE!!"])
    assert len(p[0]) == 3 and p[0][2] < 0.5
    assert quality.score_documents(empty, model).count() == 0
    assert {r.score for r in quality.score_documents(d, quality.fit(d, labels.limit(0))).collect()} == {0.5}


def test_folds_and_samples(spark):
    d, labels, _ = made_labels(spark, lambda w, r: " ".join(w), "toxic")
    sample, counts = labelled.training_sample(d, labels, "toxic", 50)
    assert sum(y for _, y in sample) <= 50 and len(sample) <= 100 and sum(counts.values()) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(600))
    held = {r.doc_id: r.h for r in d.select("doc_id", labelled.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items() if i is not None)
    texts = [("a b c d e f g", 1), ("a b c d e f g", 1), ("h i j k l", 0)]
    assert len(labelled.without_copies(texts)) == 2
