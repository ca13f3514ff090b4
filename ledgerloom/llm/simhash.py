"""SimHash near-dedup by meet-in-the-middle ball hashing.

A text's words (ASCII letters lower-cased, split at the six white-space bytes) are cut into
overlapping shingles, repeats included; a fingerprint bit is 1 if it is set in over half of the
shingles' XXH64 hashes. Two fingerprints within ``radius`` bits share a variant within half the
radius of both, so every distinct fingerprint emits all its variants (2,081 for radius 4), variants
meet by a shuffle, and fingerprints that meet are linked after their distance is verified.

What is met at one variant lies pairwise within the radius, so links to the smallest fingerprint
there keep components whole without all pairs, and no variant can gather more than the ball's
size however many near copies there are. Copies collapse to one fingerprint before anything is
emitted. Variants travel packed, in ``passes`` slices of the variant space whose shuffle files are
dropped one after the other, so that the disk holds a slice or two of eight. Components are
found by star rounds on links between distinct fingerprints.

``near_dedup`` looks for texts of a given similarity of shingle sets, which one word within four bits
mostly misses: it ball-hashes 32 parts of a signature of 256 bits and verifies each candidate pair.
Where very many texts share parts, most of their pairs are far from similar: there sketches of the
shingle sets prove a pair too unlike where it meets, and only the others are paired up for the count.

Cases: a null or blank text has fingerprint zero and is linked like any other; fewer words than a
shingle are hashed as one; a null doc_id counts in no component's smallest id, so a component of
such rows only has a null id; repeated rows have one fingerprint and come out as often as they came
in; an empty table gives an empty result; long texts are hashed whole. Columns beside doc_id and text
play no part and ``near_dedup`` returns them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, hide, release, shown
from .graph import components

SHINGLE, RADIUS, SEED = 4, 4, 42
PASSES = 8
#: Variants that one receiving task sorts, and that a sending task holds before it packs them.
TASK_VARIANTS, PACK_VARIANTS = 1_250_000, 1_500_000
#: Near-dedup: similarity of shingle sets that links, words of a signature, orders in which its bits
#: are cut into 32-bit parts, and radius within a part.
SIMILARITY, WORDS, ORDERS, PART_RADIUS = 0.8, 4, 4, 2
#: Candidates differ in at most FAR bits of 64 (similar texts in about 10, others in about 32). At first up
#: to ALL_PAIRS nodes at one variant meet in all pairs, more of them with the first and the NEXT ones; those
#: that did not meet in all pairs do so at the end, MEET_PAIRS at once.
FAR, ALL_PAIRS, NEXT, STAND, MEET_PAIRS = 20, 8, 2, 2, 2_000_000
#: At the end up to LISTED nodes (at most 244,650 pairs) list all their pairs; of more, sketches of SKETCH
#: words, compared BOUND_PAIRS at once, leave out those that cannot be similar. A task then takes a quarter
#: of the variants, for the sketches' room.
LISTED, SKETCH, BOUND_PAIRS, SKETCHED = 700, 32, 50_000, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def masks(bits: int, width: int = 64) -> np.ndarray:
    """All words of that width with at most so many bits set, none first."""
    out = [0]
    for k in range(1, bits + 1):
        out += [sum(1 << i for i in c) for c in combinations(range(width), k)]
    return np.array(out, np.uint64)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included; none for a blank text."""
    words = text.lower().split()
    joined = b" ".join(words)
    h, n = xxhash.xxh64_intdigest, len(words)
    if n <= shingle:
        return np.array([h(joined, SEED)] if n else [], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], stops[: n - shingle] + 1)).tolist()
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, stops[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, shingle)
    return majority(hashes) if len(hashes) else 0


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in over half of the hashes; counted in blocks of bounded size."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp bigint (the fingerprint's bits) and text_hash bigint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                fps = np.array([fingerprint(x or b"", shingle) for x in part.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), part.column(2)], names=["doc_id", "fp", "text_hash"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return slim.mapInArrow(run, "doc_id bigint, fp bigint, text_hash bigint")


def _send(radius: int, passes: int, this: int, parts: int):
    """Packs the variants of one slice by the part that they meet in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = masks(radius // 2)
        step = max(1, PACK_VARIANTS // len(ball))

        def pack(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            variants = (fps[:, None] ^ ball[None, :]).ravel()
            mixed = variants * _MIX
            mine = np.flatnonzero((mixed >> np.uint64(56)) % np.uint64(passes) == np.uint64(this))
            part = ((mixed[mine] >> np.uint64(24)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, mine = part[order], mine[order]
            variants, mask = variants[mine], (mine % len(ball)).astype(np.uint16)
            cuts = np.flatnonzero(np.diff(part)) + 1
            starts, stops = [0, *cuts.tolist()], [*cuts.tolist(), len(part)]
            if len(part):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[starts], pa.int32()), pa.array([variants[a:b].tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary()), pa.array([mask[a:b].tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary())],
                    names=["part", "variants", "masks"],
                )

        held, n = [], 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            held.append(fps)
            n += len(fps)
            while n >= step:
                fps = np.concatenate(held)
                yield from pack(fps[:step])
                held, n = [fps[step:]], n - step
        if n:
            yield from pack(np.concatenate(held))

    return run


def _meet(radius: int):
    """Links between fingerprints that share a variant, as a forest: each to the smallest it reaches here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = masks(radius // 2)
        variants, mask = [], []
        for batch in batches:
            variants += [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            mask += [np.frombuffer(x, np.uint16) for x in batch.column(2).to_pylist()]
        if not variants:
            return
        v, m = np.concatenate(variants), np.concatenate(mask)
        del variants, mask
        s = np.sort(v)
        shared = np.unique(s[1:][s[1:] == s[:-1]])
        del s
        if not len(shared):
            return
        at = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
        hit = shared[at] == v
        v, fp = v[hit], v[hit] ^ ball[m[hit]]
        order = np.lexsort((fp, v))
        v, fp = v[order], fp[order]
        new = np.concatenate(([True], v[1:] != v[:-1]))
        least = fp[np.flatnonzero(new)][np.cumsum(new) - 1]
        link = np.unique(np.stack([least, fp], axis=1)[least != fp], axis=0)
        link = link[np.bitwise_count(link[:, 0] ^ link[:, 1]) <= radius]
        node, at = np.unique(link, return_inverse=True)
        a, b = at.reshape(-1, 2).T
        label = np.arange(len(node))
        while True:
            low = np.minimum(label[a], label[b])
            old = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == old).all():
                break
        out = np.flatnonzero(label != np.arange(len(node)))
        # signed order must be the order of links: hand over as bigint
        yield pa.RecordBatch.from_arrays([pa.array(node[out].view(np.int64)), pa.array(node[label[out]].view(np.int64))], names=["u", "v"])

    return run


def linked(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, passes: int = PASSES) -> DataFrame:
    """u, v bigint: links between the distinct values of fps.fp, enough for whole components."""
    spark = fps.sparkSession
    distinct = scratch.keep(fps.select("fp").distinct(), "distinct")
    n = distinct.count()
    size = len(masks(radius // 2))
    parts = max(8, -(-n * size // (passes * TASK_VARIANTS)))
    senders = max(8, -(-n // 4096))
    dealt = distinct.repartition(senders)
    out = None
    for this in range(passes):
        sent = dealt.mapInArrow(_send(radius, passes, this, parts), "part int, variants binary, masks binary")
        met = scratch.keep(sent.repartitionById(parts, F.col("part")).mapInArrow(_meet(radius), "u bigint, v bigint"), f"links{this}")
        out = met if out is None else out.unionByName(met)
        del sent
        release(spark)
    return out


def clusters(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, passes: int = PASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, text_hash and component_id of every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, shingle, id_col, text_col), "fps")
    root = components(linked(fps, scratch, radius, passes), scratch)
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = nodes.join(root.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = scratch.keep(nodes, "nodes")
    least = scratch.keep(nodes.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = nodes.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp")


def signature(hashes: np.ndarray) -> np.ndarray:
    """WORDS fingerprints of one set of shingle hashes, the hashes mixed anew for each."""
    out = np.zeros(WORDS, np.uint64)
    for k in range(WORDS if len(hashes) else 0):
        mixed = (hashes ^ np.uint64(k)) * _MIX
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out[k] = majority(mixed ^ (mixed >> np.uint64(32)))
    return out


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sigs = [signature(np.unique(shingle_hashes(x or b"", shingle))).tobytes() for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigs, pa.binary())], names=["node", "sig"])

    return run


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH words, each bit the parity of how many of a set's hashes fall on it, and the set's size."""
    at = (((hashes * _MIX) >> np.uint64(32)) % np.uint64(64 * SKETCH)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.append(np.packbits(odd, bitorder="little").view(np.uint64), np.uint64(len(hashes)))


def may_be_similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """False only where sketches (rows) prove a Jaccard similarity below ``least``: a bit differs only by
    an element that one set lacks, so no fewer elements than bits are in one set alone."""
    sizes = [x[:, -1].astype(np.int64) for x in (a, b)]
    alone = np.maximum(np.bitwise_count(a[:, :-1] ^ b[:, :-1]).sum(axis=1, dtype=np.int64), np.abs(sizes[0] - sizes[1]))
    both = sizes[0] + sizes[1]
    return both - alone >= (least - 1e-9) * (both + alone)


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [sketch(np.unique(shingle_hashes(x or b"", shingle))).tobytes() for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["node", "sketch"])

    return run


def bit_parts(sigs: np.ndarray) -> np.ndarray:
    """Rows of WORDS words to rows of 32-bit parts: the bits are cut in ORDERS orders."""
    bits = np.unpackbits(sigs.view(np.uint8).reshape(len(sigs), -1), axis=1, bitorder="little")
    draw = np.random.default_rng(SEED)
    orders = [draw.permutation(bits.shape[1]) for _ in range(ORDERS)]
    return np.concatenate([np.ascontiguousarray(np.packbits(bits[:, o], axis=1, bitorder="little")).view(np.uint32) for o in orders], axis=1)


def _send_parts(passes: int, this: int, parts: int):
    """The variants of one slice's signature parts (part number above, 32 bits below), packed by the
    part of the shuffle that they meet in, each with its node, the signature's first word, mark and the
    bits that make the variant. Sketches, where nodes have them, go along once a run of one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = masks(PART_RADIUS // 2, 32)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                nodes = piece.column(0).to_numpy(zero_copy_only=False)
                sigs = np.frombuffer(b"".join(piece.column(1).to_pylist()), np.uint64).reshape(-1, WORDS)
                mark = piece.column(2).to_numpy(zero_copy_only=False)
                found = bit_parts(sigs)
                mine = np.arange(this, found.shape[1], passes)
                keys = found[:, mine].astype(np.uint64) | (mine.astype(np.uint64) << np.uint64(32))
                variants = (keys[:, :, None] ^ ball).reshape(-1)
                row, flip = np.repeat(np.arange(len(nodes)), len(mine) * len(ball)), np.tile(np.arange(len(ball), dtype=np.uint8), len(nodes) * len(mine))
                part = (((variants * _MIX) >> np.uint64(24)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                part, variants, row, flip = part[order], variants[order], row[order], flip[order]
                cuts = np.flatnonzero(np.diff(part)) + 1
                spans = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True)) if len(part) else []
                packed = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (variants, nodes[row], sigs[row, 0], mark[row], flip)]
                names = ["part", "variants", "nodes", "words", "marks", "flips"]
                if batch.num_columns > 3:
                    held = np.frombuffer(b"".join(piece.column(3).to_pylist()), np.uint64).reshape(-1, SKETCH + 1)
                    packed.append(pa.array([held[row[a:b][_runs(nodes[row[a:b]])]].tobytes() for a, b in spans], pa.binary()))
                    names.append("sketches")
                yield pa.RecordBatch.from_arrays([pa.array([part[a] for a, _ in spans], pa.int32()), *packed], names=names)

    return run


def _runs(x: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before it."""
    return np.concatenate(([True], x[1:] != x[:-1]))


def _meet_parts(most: int | None, beyond: int = 0, least: float = 0.0):
    """Candidate pairs of nodes that share a variant, differ in at most FAR bits of their first word and
    are not known to be linked; with no ``most``, all of them, or with sketches all that these do not prove
    less similar than ``least``. Otherwise of nodes known to be linked STAND
    stand at a variant for all, and up to ``most`` nodes at a variant meet in all pairs; of more, each
    meets the first and the next ``beyond``. Where that leaves pairs out, every node of the variant comes
    out as a pair with itself too. Two nodes share all variants of a part or two: the pair is handed on
    at the part itself or the lesser."""

    ball = masks(PART_RADIUS // 2, 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], [], [], [], []]
        sketches: list[np.ndarray] = []
        for batch in batches:
            if batch.num_columns > 6:
                sketches += [np.frombuffer(x, np.uint64) for x in batch.column(6).to_pylist()]
            for k, kind in enumerate((np.uint64, np.int64, np.uint64, np.int64, np.uint8)):
                got[k] += [np.frombuffer(x, kind) for x in batch.column(k + 1).to_pylist()]
        if not got[0]:
            return
        v, node, word, mark, flip = (np.concatenate(x) for x in got)
        if sketched := bool(sketches):
            # the number of each one's sketch: a run of one node in what came packed together has one
            mine = np.cumsum(np.concatenate([_runs(x) for x in got[1]])) - 1
            held = np.concatenate(sketches).reshape(-1, SKETCH + 1)
        del got, sketches
        s = np.sort(v)
        shared = np.unique(s[1:][s[1:] == s[:-1]])
        del s
        if not len(shared):
            return
        hit = shared[np.minimum(np.searchsorted(shared, v), len(shared) - 1)] == v
        v, node, word, label, flip = v[hit], node[hit], word[hit], node[hit] ^ mark[hit], flip[hit]
        order = np.lexsort((node, label, v))
        v, node, word, label, flip = v[order], node[order], word[order], label[order], ball[flip[order]]
        if sketched:
            mine = mine[hit][order]

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            ok = (np.bitwise_count(word[a] ^ word[b]) <= FAR) & (label[a] != label[b])
            ok &= np.where(flip[a] == flip[b], flip[a] == 0, v[a] < v[a] ^ flip[a] ^ flip[b])
            a, b = a[ok], b[ok]
            if sketched and len(a):
                ok = np.concatenate([may_be_similar(held[mine[a[k : k + BOUND_PAIRS]]], held[mine[b[k : k + BOUND_PAIRS]]], least) for k in range(0, len(a), BOUND_PAIRS)])
                a, b = a[ok], b[ok]
            return np.unique(np.sort(np.stack([node[a], node[b]], axis=1), axis=1), axis=0)

        def rows(pair: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])

        new = np.concatenate(([True], v[1:] != v[:-1]))
        if most is None:
            # a node meets what comes after the nodes of its own label, up to the end of its variant
            run_new = new | np.concatenate(([True], label[1:] != label[:-1]))
            ends = lambda x: np.repeat(np.append(np.flatnonzero(x)[1:], len(v)), np.diff(np.append(np.flatnonzero(x), len(v))))
            start, many = ends(run_new), ends(new) - ends(run_new)
            upto = np.cumsum(many)
            at = 0
            while at < len(v) and upto[-1] > (done := upto[at - 1] if at else 0):
                to = max(at + 1, int(np.searchsorted(upto, done + MEET_PAIRS, "right")))
                n = many[at:to]
                a = np.repeat(np.arange(at, to), n)
                yield rows(near(a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + start[a]))
                at = to
            return
        lead = np.concatenate((np.ones(min(STAND, len(v)), bool), (v[STAND:] != v[:-STAND]) | (label[STAND:] != label[:-STAND])))
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(v)) - 1
        cut = (label[at] != label[last]) & ((np.add.reduceat(lead, at) > most) | ~np.logical_and.reduceat(lead, at))
        left = np.unique(node[np.repeat(cut, last - at + 1)])
        v, node, word, label, flip = v[lead], node[lead], word[lead], label[lead], flip[lead]
        at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        size = np.diff(np.append(at, len(v)))
        first, small = np.repeat(at, size), np.repeat(size <= most, size)
        i = np.flatnonzero(np.arange(len(v)) != first)
        a, b = [first[i]], [i]
        for d in range(1, max(most, beyond + 1)):
            i = np.flatnonzero((v[d:] == v[:-d]) & (small[d:] | (d <= beyond)))
            a.append(i)
            b.append(i + d)
        yield rows(near(np.concatenate(a), np.concatenate(b)))
        yield rows(np.stack([left, left], axis=1))

    return run


def _packed(meet):
    """The pairs that meet gives; the nodes that come out with themselves go into one row a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in meet(batches):
            u, v = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for x, y, left in ((u[u != v], v[u != v], None), ([None], [None], u[u == v].tobytes())):
                if left != b"":
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array([left] * len(x), pa.binary())], names=["u", "v", "left"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)))], names=["node"])


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [np.unique(shingle_hashes(x or b"", shingle)).view(np.int64) for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return run


def similar(docs: DataFrame, scratch: Scratch, shingle: int, least: float = SIMILARITY, passes: int = PASSES) -> DataFrame:
    """u, v bigint: links between text hashes of docs (_x_hash, text) whose texts have at least that
    similarity of shingle sets, enough for components. Signature parts are ball-hashed for candidates,
    and every candidate pair's similarity is counted exactly from the texts. The first slice goes
    through once before the others with few pairs a node, then all slices with few pairs where many
    meet: what these link need not be paired again, so a large group of near copies is not paired in
    all ways. Then the nodes of every variant where pairs were left out go through all slices again and
    meet in all pairs that are neither linked nor verified yet, so that no candidate is lost; if these
    nodes are more than LISTED, their sketches settle most pairs where they meet, without an error."""
    spark = docs.sparkSession
    sigs = docs.select("_x_hash", "text").mapInArrow(_signatures(shingle), "node bigint, sig binary")
    sigs = scratch.keep(scratch.keep(sigs, "rows").distinct(), "signatures")

    def candidates(marked: DataFrame, n: int, slices: range, most: int | None, beyond: int, name: str) -> DataFrame:
        variants = n * len(masks(PART_RADIUS // 2, 32)) * (WORDS * 64 // 32) * ORDERS
        sketched = "sketch" in marked.columns
        parts = max(8, -(-variants * (SKETCHED if sketched else 1) // (passes * TASK_VARIANTS)))
        senders = max(8, -(-n // 4096))
        packs = "part int, variants binary, nodes binary, words binary, marks binary, flips binary" + ", sketches binary" * sketched
        out = None
        for this in slices:
            sent = marked.repartition(senders).mapInArrow(_send_parts(passes, this, parts), packs)
            met = sent.repartitionById(parts, F.col("part")).mapInArrow(_packed(_meet_parts(most, beyond, least)), "u bigint, v bigint, left binary")
            met = scratch.keep(met, f"met-{name}{this}")
            out = met if out is None else out.unionByName(met)
            del sent
            release(spark)
        return out

    def pairs_of(met: DataFrame) -> DataFrame:
        return met.filter("left is null").select("u", "v").distinct()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        nodes = scratch.keep(pairs.select(F.col("u").alias("_x_hash")).union(pairs.select("v")).distinct(), f"nodes-{name}")
        texts = docs.select("_x_hash", "text").join(nodes, "_x_hash", "left_semi").mapInArrow(_sets(shingle), "node bigint, hashes array<bigint>")
        sets = scratch.keep(texts.dropDuplicates(["node"]), f"sets-{name}")
        side = lambda k: sets.select(F.col("node").alias(k), F.col("hashes").alias(f"{k}_hashes"))
        both, shared = pairs.join(side("u"), "u").join(side("v"), "v"), F.size(F.array_intersect("u_hashes", "v_hashes"))
        # blank texts have no shingles and are alike
        alike = F.coalesce(shared / F.nullif(F.size("u_hashes") + F.size("v_hashes") - shared, F.lit(0)), F.lit(1.0))
        links = scratch.keep(both.filter(alike >= least).select("u", "v"), f"links-{name}")
        scratch.drop(f"sets-{name}")
        release(spark)
        return links

    def marks(root: DataFrame, name: str) -> DataFrame:
        at = root.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return scratch.keep(sigs.join(at, "node", "left").select("node", "sig", F.coalesce(F.col("node").bitwiseXOR(F.col("root")), F.lit(0)).alias("mark")), name)

    n = sigs.count()
    met = candidates(sigs.withColumn("mark", F.lit(0).cast("long")), n, range(1), 1, 1, "early")
    early = scratch.keep(pairs_of(met), "pairs-early")
    links = verified(early, "early")
    met = candidates(marks(components(links, scratch), "marks-few"), n, range(passes), ALL_PAIRS, NEXT, "few")
    few = scratch.keep(pairs_of(met), "pairs-few")
    cut = scratch.keep(met.filter("left is not null").select("left").mapInArrow(_unpacked, "node bigint").distinct(), "cut")
    root = components(links.unionByName(verified(few, "few")), scratch)
    if not (n := cut.count()):
        return root
    crowd = marks(root, "marks-all").join(cut, "node", "left_semi")
    if n > LISTED:
        held = docs.select("_x_hash", "text").join(cut.withColumnRenamed("node", "_x_hash"), "_x_hash", "left_semi")
        held = scratch.keep(held.mapInArrow(_sketches(shingle), "node bigint, sketch binary").dropDuplicates(["node"]), "sketches")
        crowd = scratch.keep(crowd.join(held, "node"), "crowd")
    met = candidates(crowd, n, range(passes), None, 0, "all")
    every = scratch.keep(pairs_of(met).join(early.unionByName(few), ["u", "v"], "left_anti"), "pairs-all")
    return root.unionByName(verified(every, "all"))


def near_dedup(docs: DataFrame, shingle: int = 5, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, one of each component of texts whose shingle sets have at least
    that Jaccard similarity: smallest doc_id (nulls last), then the smallest hash of the text; of
    rows alike in both, all stay (exact dedup takes those)."""
    scratch = Scratch(docs.sparkSession, "near")
    docs, names = hide(docs, ("doc_id", "text"))
    marked = docs.withColumn("_x_hash", F.xxhash64("text"))
    root = components(similar(marked, scratch, shingle, least), scratch)
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").cast("long").alias("b"), F.col("_x_hash").alias("c"))
    best = scratch.keep(marked.groupBy("_x_hash").agg(F.min(order).alias("k")), "best")
    best = best.join(root.select(F.col("u").alias("_x_hash"), F.col("v").alias("root")), "_x_hash", "left")
    stay = best.groupBy(F.coalesce("root", "_x_hash").alias("_by")).agg(F.min("k").alias("k")).select(F.col("k.b").alias("_k"), F.col("k.c").alias("_h"))
    on = marked["doc_id"].cast("long").eqNullSafe(stay["_k"]) & (marked["_x_hash"] == stay["_h"])
    return shown(marked.join(stay, on, "left_semi"), names)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
