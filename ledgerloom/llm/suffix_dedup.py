"""Suffix-array dedup of long repeated byte strings by bucket-pointer refinement.

A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else, in the
same text or another. Suffixes are put into buckets by their first q bytes and buckets are refined
by the bucket identifiers of later offsets, reused recursively: the bucket of depth 2d at i is the
pair of the depth-d buckets at i and i + d, so q = 25 reaches 400 in four rounds. A bucket's
identifier is a hash of its content, which every task computes alike, so a round needs no sort of
all suffixes; what is sorted across the cluster is only what can still be ambiguous:

1. Of all suffixes only anchors enter: positions whose q-gram identifier is the least in some window
   of ``length`` bytes (about 2 in 377). Equal windows have equal anchors at equal offsets, so none
   is lost, and buckets of one anchor drop out.
2. A bucket is refined by the identifiers of the whole context of windows that hold the anchor.
   Anchors that share it are settled: all their windows repeat, however many there are.
3. One anchor of each remaining context represents it. It is refined by the identifiers at half the
   length right and left of it: windows reach half the length at least to one side.
4. What is left is compared window by window, by the identifiers at depth ``length``. Equal windows
   share the bucket of step 3, so a bucket's windows meet in one part and a context's matches come
   back together; only a bucket of more than ``BUCKET_WINDOWS`` windows is dealt out by window.

Identifiers are 64-bit and compared with a second one: the q-gram's, or 32 bits of another pairing. Cases: a null text
counts as empty; texts shorter than ``length`` keep everything; repeated rows cover each other; a
null doc_id is a value like any other; an empty table gives an empty result; very long texts are
handled whole. Rows with equal doc_id and text are one key with equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, release

LENGTH, ROUNDS = 400, 4
#: Windows that a sending task packs at once, that a receiving task sorts on average, and that a bucket
#: may bring to one part.
PACK_WINDOWS, TASK_WINDOWS, BUCKET_WINDOWS = 1_000_000, 700_000, 350_000
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D | 1
_LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 17)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            p = np.multiply.accumulate(p)
            _powers[k : k + 1] = [p]
    return _powers[0][:n], _powers[1][:n]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _K1 + b)


def buckets(text: bytes, length: int = LENGTH, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Bucket identifiers of every suffix at depths length >> rounds, ..., length >> 1, length."""
    q = length >> rounds
    b = np.frombuffer(text, np.uint8)
    power, inverse = _power(len(b))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[b] * power, dtype=np.uint64)))
    ids = [_mix((sums[q:] - sums[:-q]) * inverse[: len(b) - q + 1])]
    for _ in range(rounds):
        ids.append(_join(ids[-1][:-q], ids[-1][q:]))
        q *= 2
    return ids


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (minimum or maximum) over every stretch of width values."""
    n = len(x)
    fill = np.uint64(0) if op is np.maximum else np.uint64(0xFFFFFFFFFFFFFFFF)
    rows = -(-n // width)
    padded = np.full(rows * width, fill, np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    ahead = op.accumulate(grid, axis=1).ravel()
    behind = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that hold the leftmost least q-gram of some window of width q-grams, and the first and
    last start of the windows of which each is it. Every window has one anchor."""
    least = _sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), width, np.maximum) == grams)
    owner = np.searchsorted(at, np.arange(len(least)))
    todo = np.flatnonzero(grams[at[owner]] != least)
    while len(todo):
        owner[todo] += 1
        todo = todo[grams[at[owner[todo]]] != least[todo]]
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return at[owner[first]], first, np.append(first[1:], len(least)) - 1


_ANCHORS = "doc_id bigint, doc bigint, pos int, first int, last int, gram bigint, root bigint, rh bigint, lh bigint"


def _rows_of(text: bytes, length: int, rounds: int) -> list[np.ndarray]:
    """Per anchor: position, first and last window start, and identifiers of its q-gram, of the whole
    context of its windows, and of half the length right and left of it (0: no window needs it)."""
    ids = buckets(text, length, rounds)
    n, q, half = len(text), length >> rounds, length // 2
    at, first, last = anchors(ids[0], length - q + 1)
    root = _join(_join(ids[-1][first], ids[-1][last]), ((at - first) * 4096 + (at - last)).astype(np.uint64))
    rh = np.where((at - last <= half) & (at + half <= n), ids[-2][np.minimum(at, n - half)], np.uint64(0))
    back = at + q - half
    lh = np.where((at - first >= half - q) & (back >= 0), ids[-2][np.maximum(back, 0)], np.uint64(0))
    return [at, first, last, ids[0][at], root, rh, lh]


def _anchor_rows(length: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                long, counts, found = [], [], []
                for k, text in enumerate(part.column(2).cast(pa.binary()).to_pylist()):
                    if text is not None and len(text) >= length:
                        rows = _rows_of(text, length, rounds)
                        long.append(k)
                        counts.append(len(rows[0]))
                        found.append(rows)
                if not long:
                    continue
                take = pa.array(np.repeat(np.array(long), counts))
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), *(pa.array(x.astype(np.int32)) for x in columns[:3]), *(pa.array(x.view(np.int64)) for x in columns[3:])],
                    names=["doc_id", "doc", "pos", "first", "last", "gram", "root", "rh", "lh"],
                )

    return run


def candidates(slim: DataFrame, scratch: Scratch, length: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """Anchors whose q-gram bucket has another, with ``whole``: the bucket's contexts are all equal."""
    rows = scratch.keep(slim.mapInArrow(_anchor_rows(length, rounds), _ANCHORS), "anchors")
    grams = rows.groupBy("gram").agg(F.count("*").alias("c"), F.min("root").alias("a"), F.max("root").alias("b"))
    # written first: a join right above an aggregate would keep its dealing, which cannot be split
    grams = scratch.keep(grams.filter("c > 1").select("gram", (F.col("a") == F.col("b")).alias("whole")), "grams")
    out = scratch.keep(rows.join(grams, "gram"), "candidates")
    scratch.drop("anchors")
    release(slim.sparkSession)
    return out


def representatives(cand: DataFrame, scratch: Scratch, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Contexts of the buckets that have several, one row each (members, and the first of them), and
    those of them that can share a window with another, with the number of parts that the windows of
    their right and left bucket are dealt over (0: the bucket has no other context)."""
    mixed = cand.filter("NOT whole")
    first = F.min(F.struct("doc_id", "doc", "pos", "first", "last")).alias("f")
    contexts = mixed.groupBy("gram", "root").agg(F.count("*").alias("members"), first, F.max("rh").alias("rh"), F.max("lh").alias("lh"))
    contexts = scratch.keep(contexts.select("gram", "root", "members", "f.*", "rh", "lh"), "contexts")
    side = lambda c: contexts.filter(f"{c} <> 0").groupBy("gram", c).agg(F.count("*").alias("k")).filter("k > 1").select(F.col("gram").alias("g"), F.col(c).alias("h"), "k")
    right, left = scratch.keep(side("rh"), "right"), scratch.keep(side("lh"), "left")
    marked = contexts.join(right.withColumnRenamed("k", "kr"), (F.col("gram") == F.col("g")) & (F.col("rh") == F.col("h")), "left").drop("g", "h")
    marked = marked.join(left.withColumnRenamed("k", "kl"), (F.col("gram") == F.col("g")) & (F.col("lh") == F.col("h")), "left").drop("g", "h")
    dealt = lambda k: F.coalesce(F.ceil(F.col(k) * (length // 2 + 1) / BUCKET_WINDOWS), F.lit(0)).cast("int")
    marked = marked.withColumns({"to_r": dealt("kr"), "to_l": dealt("kl")}).drop("kr", "kl")
    return contexts, scratch.keep(marked.filter("to_r > 0 OR to_l > 0"), "representatives")


_PACKED = "part int, windows binary, checks binary, starts binary, ids array<bigint>, docs array<bigint>, counts array<int>"


def _send(parts: int, length: int, rounds: int):
    """Packs the identifiers of the windows that representatives still have to compare, by the part
    where they meet. Windows that meet in the pack itself are settled here: they are handed on as
    matches, and one of them stays as a witness, so a window in very many contexts arrives once a pack."""
    half, q = length // 2, length >> rounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, names, last = [], 0, [], None

        def pack() -> Iterator[pa.RecordBatch]:
            ids, checks, starts, parts_of = (np.concatenate(c) for c in zip(*held, strict=True))
            owner = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
            order = np.lexsort((checks, ids))
            same = (ids[order[1:]] == ids[order[:-1]]) & (checks[order[1:]] == checks[order[:-1]])
            later = np.concatenate(([False], same))
            met = later | np.concatenate((same, [False]))
            matched = np.sort(order[met])
            send = np.sort(order[~later])
            part = parts_of[send]
            by = np.argsort(part, kind="stable")
            rows = [(-1 - k % parts, m, False) for k, m in enumerate(np.array_split(matched, max(1, len(matched) // 50_000))) if len(m)]
            part, send = part[by], send[by]
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            rows += [(int(part[a]), send[a:b], True) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
            out = []
            for where, at, open_ in rows:
                who = owner[at]
                edges = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
                out.append((where, ids[at].tobytes() if open_ else b"", checks[at].tobytes() if open_ else b"", starts[at].tobytes(), [names[w][0] for w in who[edges]], [names[w][1] for w in who[edges]], np.diff(np.append(edges, len(who))).tolist()))
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "windows", "checks", "starts", "ids", "docs", "counts"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for doc_id, doc, text, reps in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    if (doc_id, doc) == last:  # rows alike come one after the other: one speaks for all
                        continue
                    last = doc_id, doc
                    ids = buckets(text.encode(), length, rounds)
                    pos, first, end, to_r, to_l = np.array([(r["pos"], r["first"], r["last"], r["to_r"], r["to_l"]) for r in reps], np.int64).T
                    lo = np.where(to_l > 0, first, np.maximum(first, pos - (half - q) + 1))
                    hi = np.where(to_r > 0, end, np.minimum(end, pos - half - 1))
                    many = np.maximum(hi - lo + 1, 0)
                    if not many.sum():
                        continue
                    rep = np.repeat(np.arange(len(pos)), many)
                    starts = (np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many) + lo[rep]).astype(np.uint32)
                    # the bucket that all windows equal to one of these share, and its number of parts
                    grams, halves = ids[0][pos], ids[-2]
                    right = _join(grams, halves[np.minimum(pos, len(halves) - 1)])
                    left = _join(~grams, halves[np.maximum(pos + q - half, 0)])
                    on_right = pos[rep] - starts <= half
                    over = np.where(on_right, to_r[rep], to_l[rep]).astype(np.uint64)
                    bucket = np.where(on_right, right[rep], left[rep]) + (ids[-1][starts] >> np.uint64(20)) % over
                    part = ((_mix(bucket) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
                    check = _mix(ids[-2][starts] * _K3 + ids[-2][starts + half]).astype(np.uint32)
                    held.append((ids[-1][starts], check, starts, part))
                    names.append((doc_id, doc))
                    n += len(starts)
                    if n >= PACK_WINDOWS:
                        yield from pack()
                        held, n, names = [], 0, []
        if held:
            yield from pack()

    return run


_MATCHED = "doc_id bigint, doc bigint, starts binary"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of windows that meet another, packed by document."""

    def rows(starts: np.ndarray, ids: np.ndarray, docs: np.ndarray, none: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (ids[1:] != ids[:-1]))))
        cuts = [*edges.tolist(), len(docs)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[edges], pa.int64(), mask=none[edges]), pa.array(docs[edges], pa.int64()), pa.array([starts[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
            names=["doc_id", "doc", "starts"],
        )

    held = []
    for batch in batches:
        for _, windows, checks, starts, ids, docs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            place = [np.repeat(np.array(x, t), counts) for x, t in (([i or 0 for i in ids], np.int64), (docs, np.int64), ([i is None for i in ids], bool))]
            starts = np.frombuffer(starts, np.uint32)
            if windows:
                held.append((np.frombuffer(windows, np.uint64), np.frombuffer(checks, np.uint32), starts, *place))
            else:
                yield rows(starts, *place)
    if not held:
        return
    windows, checks, starts, ids, docs, none = (np.concatenate(c) for c in zip(*held, strict=True))
    del held
    order = np.lexsort((checks, windows))
    same = (windows[order[1:]] == windows[order[:-1]]) & (checks[order[1:]] == checks[order[:-1]])
    hit = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    if len(hit):
        hit = hit[np.lexsort((starts[hit], docs[hit], ids[hit]))]
        yield rows(starts[hit], ids[hit], docs[hit], none[hit])


def _same_doc(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joins right's columns to left on (doc_id, doc), null ids being equal."""
    r = right.withColumnRenamed("doc_id", "_i").withColumnRenamed("doc", "_d")
    return left.join(r, (left["doc"] == r["_d"]) & left["doc_id"].eqNullSafe(r["_i"]), how).drop("_i", "_d")


def repeated(slim: DataFrame, scratch: Scratch, length: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, doc, settled array<struct<first,last>>, starts array<binary>: the window starts whose
    string of ``length`` bytes starts elsewhere too, per document that has any."""
    spark = slim.sparkSession
    cand = candidates(slim, scratch, length, rounds)
    contexts, reps = representatives(cand, scratch, length)
    shared = contexts.filter("members > 1").select(F.col("gram").alias("g"), F.col("root").alias("r"))
    mixed = cand.filter("NOT whole").join(shared, (F.col("gram") == F.col("g")) & (F.col("root") == F.col("r")), "left_semi")
    settled = cand.filter("whole").unionByName(mixed).select("doc_id", "doc", F.struct("first", "last").alias("span"))
    total = reps.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0
    parts = max(8, -(-total // TASK_WINDOWS))
    todo = reps.groupBy("doc_id", "doc").agg(F.collect_list(F.struct("pos", "first", "last", "to_r", "to_l")).alias("reps"))
    sent = _same_doc(slim, todo, "inner").select("doc_id", "doc", "text", "reps").mapInArrow(_send(parts * 4, length, rounds), _PACKED)
    met = scratch.keep(sent.repartition(parts, "part").mapInArrow(_meet, _MATCHED), "met")
    del sent
    release(spark)
    both = settled.withColumn("starts", F.lit(None).cast("binary")).unionByName(met.select("doc_id", "doc", F.lit(None).cast("struct<first:int,last:int>").alias("span"), "starts"))
    # sets, as every one of many rows alike in doc_id and text brings the same spans
    return both.groupBy("doc_id", "doc").agg(F.collect_set("span").alias("settled"), F.collect_set("starts").alias("starts"))


def _covered(n: int, settled: list, starts: list, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last byte of every maximal removed run."""
    first = [np.array([s["first"] for s in settled], np.int64)]
    last = [np.array([s["last"] for s in settled], np.int64)]
    for x in starts:
        at = np.frombuffer(x, np.uint32).astype(np.int64)
        first.append(at)
        last.append(at)
    first, stop = np.concatenate(first), np.concatenate(last) + length
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(stop[order])
    new = np.concatenate(([True], first[1:] > stop[:-1]))
    begin = np.flatnonzero(new)
    return first[begin], stop[np.append(begin[1:] - 1, len(first) - 1)]


_OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (first and past-last removed byte of
    each run; and kept binary, the remaining bytes, on request: they need not be whole UTF-8) of every
    row. Other columns of docs play no part, whatever their names."""
    scratch = Scratch(docs.sparkSession, "suffix")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc"), F.col(text_col).alias("text"))
    spans = scratch.keep(repeated(slim, scratch, length, rounds), "spans")
    release(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for doc_id, text, settled, starts in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    text, kept, removed, runs = text or b"", text or b"", 0, []
                    if settled or starts:
                        a, b = _covered(len(text), settled or [], starts or [], length)
                        kept = b"".join(text[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True))
                        removed, runs = int((b - a).sum()), [{"start": i, "stop": j} for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                    out.append((doc_id, len(text), removed, len(runs), hashlib.sha256(kept).hexdigest(), runs, *([kept] if keep_bytes else [])))
                kinds = [pa.int64()] * 4 + [pa.string(), _SPANS] + [pa.binary()] * keep_bytes
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names[: len(kinds)])

    joined = _same_doc(slim, spans, "left").select("doc_id", "text", "settled", "starts")
    return joined.mapInArrow(run, _OUT + ", kept binary" * keep_bytes)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).withColumn("repeated", F.col("n_removed") > 0)
