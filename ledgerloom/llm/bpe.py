"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves' left ends: leaf i holds rank and position of the pair that starts
at symbol i, inner nodes the smaller of two, so the root is the leftmost pair of the lowest rank.
A merge rewrites three leaves and their paths, logarithmic each, until the root holds no mergeable
pair; a word of n bytes takes O(n log n) however long it is.

Words of up to 64 bytes are merged many at a time: the same trees, as rows of an array. Words repeat,
so results are kept: by word, and by the stretch between single spaces (a stretch that neither is
empty nor starts or ends with white space is cut the same way wherever it stands). A store that has
outgrown its bound is emptied before the next slice of texts; it lives on from task to task. Texts
with other white space between stretches are cut by the pattern as a whole.

The vocabulary file is a parameter; files shipped with the job are read by each Python worker.
Added tokens that occur in a text become their own id, as in the library. Cases: a null text counts
as empty and has no tokens; a null id passes through; repeated rows repeat; an empty table gives an
empty result; very long texts are encoded whole. Other columns pass through ``encode`` unless they
are named like its own, which win.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

VOCABULARY = "byte_bpe_50k.json"
#: Entries from which a store of results is emptied (words cost most to compute), and bytes of text
#: that are worked on at once.
STORE, WORD_STORE, SLICE = 250_000, 600_000, 4 << 20
#: How byte-level vocabularies cut texts before merging (fixed value).
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_NONE = 1 << 62


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the other bytes in order for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class Store(dict):
    """Results by key, computed when missing, in two generations of bounded size."""

    def __init__(self, make, limit: int = STORE):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


def merge_word(ids: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Merge symbols by rank; pairs: (left << 32 | right) -> (rank, merged)."""
    n = len(ids)
    if n < 2:
        return ids
    width = 1
    while width < n:
        width *= 2
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        p = pairs.get(ids[i] << 32 | ids[i + 1])
        if p is not None:
            tree[width + i] = p[0] << 32 | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = width + i
        if tree[k] == value:
            return
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            new = a if a < b else b
            if tree[k] == new:
                return
            tree[k] = new
            k >>= 1

    while tree[1] != _NONE:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        ids[i] = pairs[ids[i] << 32 | ids[j]][1]
        ids[j] = -1
        k = after[i] = after[j]
        put(j, _NONE)
        if k < n:
            before[k] = i
            p = pairs.get(ids[i] << 32 | ids[k])
            put(i, _NONE if p is None else p[0] << 32 | i)
        else:
            put(i, _NONE)
        h = before[i]
        if h >= 0:
            p = pairs.get(ids[h] << 32 | ids[i])
            put(h, _NONE if p is None else p[0] << 32 | h)
    return [x for x in ids if x >= 0]


class Pairs:
    """The merge table as sorted arrays, and segment trees over many short words at once: every step
    takes each tree's root and updates three leaves and their paths, for all words that have a merge left."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.rank = np.array([*(pairs[k][0] for k in keys.tolist()), 0], np.int64)
        self.merged = np.zeros(int(self.rank.max()) + 1, np.int64)
        for rank, new in pairs.values():
            self.merged[rank] = new

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place of each pair, _NONE where it is not mergeable (a symbol of -1 never is)."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = len(self.keys) - 1
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), (self.rank[at] << 6) | place, _NONE)

    def merge(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """ids: a word's symbols a row, -1 beyond its length; at most 64 columns, a power of two. Returns
        the rows with merged symbols where a pair started and -1 in the other places."""
        n, width = ids.shape
        tree = np.full((n, 2 * width), _NONE, np.int64)
        tree[:, width : 2 * width - 1] = self.leaves(ids[:, :-1], ids[:, 1:], np.arange(width - 1))
        at = width // 2
        while at:
            tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
            at //= 2
        after, before = np.tile(np.arange(1, width + 1), (n, 1)), np.tile(np.arange(-1, width - 1), (n, 1))
        row = np.flatnonzero(tree[:, 1] != _NONE)
        while len(row):
            root = tree[row, 1]
            i = root & 63
            new = self.merged[root >> 6]
            j = after[row, i]
            k = after[row, j]
            ids[row, i], ids[row, j], after[row, i] = new, -1, k
            more = k < lengths[row]
            before[row[more], k[more]] = i[more]
            h = before[row, i]
            back = h >= 0
            tree[row, width + j] = _NONE
            tree[row, width + i] = self.leaves(new, np.where(more, ids[row, np.minimum(k, width - 1)], -1), i)
            tree[row[back], width + h[back]] = self.leaves(ids[row[back], h[back]], new[back], h[back])
            rows, node = np.concatenate((row, row, row[back])), np.concatenate((i, j, h[back])) + width
            for _ in range(width.bit_length() - 1):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            row = row[tree[row, 1] != _NONE]
        return ids


class Codec:
    """Encoder and decoder of one vocabulary file; pieces are decimal ids joined by commas."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.start = [vocab[letters[b]] for b in range(256)]
        self.pairs = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.trees, self.first = Pairs(self.pairs), np.array(self.start, np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(back[c] for c in w) for w, i in vocab.items() if all(c in back for c in w)}
        self.bytes |= {i: w.encode() for w, i in self.added.items()}
        self.names = list(map(str, range(max(self.bytes) + 1)))
        self.cut = regex.compile(CUT)
        self.split = regex.compile("(" + "|".join(regex.escape(w) for w in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.forget()

    def forget(self) -> None:
        """Empties the stores: pieces by word, by stretch at a text's start and by stretch after a space,
        and bytes by piece."""
        self.word: dict[str, str] = {}
        self.lead: dict[str, str] = {}
        self.spaced: dict[str, str] = {}
        self.text: dict[str, bytes] = {}

    def _merge(self, words: list[str]) -> Iterator[str]:
        """The pieces of words, in batches of like length; words of over 64 bytes one by one."""
        raw = [w.encode() for w in words]
        out: list[str] = [""] * len(raw)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        for width, least in ((8, 0), (16, 8), (32, 16), (64, 32)):
            mine = np.flatnonzero((size > least) & (size <= width))
            for part in (mine[k : k + 8192] for k in range(0, len(mine), 8192)):
                grid = np.frombuffer(b"".join([raw[k].ljust(width, b"\0") for k in part.tolist()]), np.uint8).reshape(-1, width)
                ids = np.where(np.arange(width) < size[part, None], self.first[grid], -1)
                ids = self.trees.merge(ids, size[part])
                live = ids >= 0
                names = [self.names[i] for i in ids[live].tolist()]
                stops = np.cumsum(live.sum(axis=1)).tolist()
                for k, a, b in zip(part.tolist(), [0, *stops[:-1]], stops, strict=True):
                    out[k] = ",".join(names[a:b])
        for k in np.flatnonzero(size > 64).tolist():
            out[k] = ",".join(map(str, merge_word([self.start[b] for b in raw[k]], self.pairs)))
        return iter(out)

    def batch(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text. What is not stored yet is gathered over all texts and merged at once."""
        for store, bound in ((self.word, WORD_STORE), (self.lead, STORE), (self.spaced, STORE), (self.text, STORE)):
            if len(store) > bound:
                store.clear()
        parts = [[(x, x in self.added) for x in self.split.split(t)] if self.split is not None and any(w in t for w in self.added) else [(t, False)] for t in texts]
        cut = {x: x.split(" ") for own in parts for x, added in own if x and not added}
        lead, spaced = set(), set()
        for first, *rest in cut.values():
            lead.add(first)
            spaced.update(rest)
        todo, bad = ({}, {}), (set(), set())  # words by stretch, and stretches that white space may join
        for k, (store, found, before) in enumerate(((self.lead, lead, ""), (self.spaced, spaced, " "))):
            for x in found:
                if not x or x[0].isspace() or x[-1].isspace():
                    bad[k].add(x)
                elif x not in store:
                    # most are plain words, whose cut needs no pattern
                    if x.isascii() and x.isalpha():
                        todo[k][x] = [before + x]
                    elif x.isascii() and x[:-1].isalpha() and x[-1] in ".,;:!?":
                        todo[k][x] = [before + x[:-1], x[-1]]
                    else:
                        todo[k][x] = self.cut.findall(before + x)
        whole = {}
        for x, (first, *rest) in cut.items():
            if first in bad[0] or not bad[1].isdisjoint(rest):
                whole[x] = self.cut.findall(x)
        new = list({w for words in (*todo[0].values(), *todo[1].values(), *whole.values()) for w in words if w not in self.word})
        self.word.update(zip(new, self._merge(new), strict=True))
        word = self.word.__getitem__
        for store, found in zip((self.lead, self.spaced), todo, strict=True):
            store.update((x, ",".join(map(word, words))) for x, words in found.items())
        done = {x: list(map(word, words)) for x, words in whole.items()}
        for x, (first, *rest) in cut.items():
            if x not in done:
                done[x] = [self.lead[first], *map(self.spaced.__getitem__, rest)]
        part = lambda x, added: [str(self.added[x])] if added else done[x] if x else []
        return [part(*own[0]) if len(own) == 1 else [p for x in own for p in part(*x)] for own in parts]

    def pieces(self, text: str) -> list[str]:
        return self.batch([text])[0]

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.pieces(text) for i in p.split(",")]

    def decode_pieces(self, pieces: list[str]) -> str:
        text = self.text
        for p in pieces:
            if p not in text:
                text[p] = b"".join([self.bytes[int(i)] for i in p.split(",")])
        return b"".join(map(text.__getitem__, pieces)).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut to about SLICE bytes of text (one text at least), with the texts in column ``at``."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            used = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, used + SLICE)))
            part = batch.slice(start, stop - start)
            yield part, pc.fill_null(part.column(at), "").to_pylist()
            start = stop


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a worker process."""
    return Codec(path)


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with token_ids array<int> and n_tokens bigint of each text."""
    path = path or vocabulary_path()
    docs = docs.drop("token_ids", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch, texts in _slices(batches, names.index(text_col)):
            ids = [np.fromstring(",".join(p), np.int32, sep=",") for p in c.batch(texts)]
            sizes = np.array([len(x) for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(sizes)], names=[*names, "token_ids", "n_tokens"])

    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, token_ids array<int>, n_tokens bigint")


def decode(df: DataFrame, ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """df with decoded string: the text of the ids in ids_col (null ids: no text)."""
    path = path or vocabulary_path()
    df = df.drop("decoded")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in (b.slice(k, 200) for b in batches for k in range(0, b.num_rows, 200)):
            texts = [c.decode(x or []) for x in batch.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the round trip of each text in one pass."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch, found in _slices(batches, 1):
            counts, ids, texts = [], [], []
            for pieces in c.batch(found):
                joined = ",".join(pieces)
                counts.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(c.decode_pieces(pieces).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
