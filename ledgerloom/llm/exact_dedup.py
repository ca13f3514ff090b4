"""Exact dedup by owners in Patricia tries.

Texts are equal when their UTF-8 bytes without the six white-space bytes are equal. Every input
partition inserts those byte strings into a compressed radix trie, so the copies in it collapse to
one row before any shuffle, however hot the group; the rows left are dealt by (length, SHA-256 of
the string) and the receiving partitions insert the full strings into tries of their own. A
terminal node holds the row that stays (most code points in the original text, then smallest
doc_id), the number of rows, and how many rows tie with the one that stays.

A trie holds at most ``budget`` bytes (or one string). Beyond it the largest subtree under the root is spilled:
its terminals are emitted, and what reaches that subtree later passes straight through. On the
first side that only lets a few more rows through; on the second the spilled rows are dealt anew
among as many partitions as their bytes ask for, until none is left. A spilled subtree is never used again, so no text is
counted both inside and outside.

Cases: null text counts as empty and equals texts of white space only; a null doc_id is larger
than any other; of rows alike in text and doc_id exactly one is kept; an empty table gives an empty
result; very long texts are inserted whole. Other columns have any names and come back from ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, documents, hide, shown

SPACE = b" \t\n\x0b\x0c\r"
BUDGET = 24 << 20
NODE_BYTES = 400
OUT_BYTES = 4 << 20
_LAST = 1 << 63  # a null id, as a rank


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """How many leading bytes a and b[at:] share."""
    n = min(len(a), len(b) - at)
    step, lo = 32, 0
    while lo < n and a[lo : lo + step] == b[at + lo : at + lo + step] and lo + step <= n:
        lo += step
        step *= 2
    hi = min(n, lo + step)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Node:
    __slots__ = ("end", "kids", "label")

    def __init__(self, label: bytes, end=None):
        self.label, self.end, self.kids = label, end, {}


class Owners:
    """A radix trie from byte strings to records, of bounded size; ``merge(old, new)`` joins records."""

    def __init__(self, merge: Callable, budget: int = BUDGET):
        self.merge, self.budget = merge, budget
        self.root, self.held, self.ends, self.sizes, self.spilled = Node(b""), 0, 0, {}, set()

    def put(self, key: bytes, record, weight: int) -> list:
        """Records this insertion pushed out; the own one if its subtree is spilled."""
        if not key:
            self.root.end = record if self.root.end is None else self.merge(self.root.end, record)
            return []
        top = key[0]
        if top in self.spilled:
            return [record]
        node, at, n = self.root, 0, len(key)
        while True:
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = Node(key[at:], record)
                break
            label = kid.label
            if key.startswith(label, at):
                at, node = at + len(label), kid
                if at < n:
                    continue
                if node.end is not None:
                    node.end = self.merge(node.end, record)
                    return []
                node.end = record
                break
            cut = common_prefix(label, key, at)
            fork = Node(label[:cut])
            kid.label = label[cut:]
            fork.kids[kid.label[0]] = kid
            node.kids[key[at]] = fork
            if at + cut == n:
                fork.end = record
            else:
                fork.kids[key[at + cut]] = Node(key[at + cut :], record)
            break
        self.sizes[top] = self.sizes.get(top, 0) + weight + NODE_BYTES
        self.held += weight + NODE_BYTES
        self.ends += 1
        out = []
        # one string alone always fits: dealt among more partitions, every spilled string comes to that
        while self.held > self.budget and self.ends > 1:
            big = max(self.sizes, key=self.sizes.get)
            gone = self._ends(self.root.kids.pop(big))
            out += gone
            self.ends -= len(gone)
            self.held -= self.sizes.pop(big)
            self.spilled.add(big)
        return out

    @staticmethod
    def _ends(node: Node) -> list:
        todo, out = [node], []
        while todo:
            x = todo.pop()
            if x.end is not None:
                out.append(x.end)
            todo.extend(x.kids.values())
        return out

    def rest(self) -> list:
        return self._ends(self.root)


def _better(old: list, new: list) -> list:
    """Records: [code points, id rank, rows, ties, length, sha, values]."""
    a, b = (-old[0], old[1]), (-new[0], new[1])
    win = new if b < a else old
    ties = old[3] + new[3] if a == b else win[3]
    return [win[0], win[1], old[2] + new[2], ties, win[4], win[5], win[6]]


def _batches(rows: Iterator, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight + 100
        if size >= OUT_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _plain(column: pa.Array) -> list:
    """Values in a form that pa.array reads back; strings stay UTF-8 bytes."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return column.to_pylist()


def _steps(names: list[str], id_col: str, text_col: str, carry: bool, budget: int):
    """The two sides. Rows between them: _x_len, _x_sha, _x_rows, _x_ties, _x_cps, _x_spilled and the
    columns of the documents."""
    i, t = names.index(id_col), names.index(text_col)

    def side(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie, schema = Owners(_better, budget), None

            def rows() -> Iterator:
                nonlocal schema
                for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
                    meta = 0 if first else 6
                    if schema is None:
                        schema = pa.schema(
                            [("_x_len", pa.int64()), ("_x_sha", pa.binary()), ("_x_rows", pa.int64()), ("_x_ties", pa.int64()), ("_x_cps", pa.int64()), ("_x_spilled", pa.bool_())]
                            + [(n, batch.schema.field(meta + k).type) for k, n in enumerate(names)]
                        )
                    columns = [_plain(batch.column(meta + k)) for k in range(len(names))]
                    if first:
                        cps = pc.fill_null(pc.utf8_length(batch.column(t)), 0).to_pylist()
                    else:
                        lens, shas, counts, ties, cps, _ = (batch.column(k).to_pylist() for k in range(6))
                    for k, values in enumerate(zip(*columns, strict=True)):
                        text = values[t] or b""
                        key = text.translate(None, SPACE)
                        rank = _LAST if values[i] is None else values[i]
                        record = [cps[k], rank, 1, 1, len(key), None, values] if first else [cps[k], rank, counts[k], ties[k], lens[k], shas[k], values]
                        for out in trie.put(key, record, len(key) + len(text)):
                            yield emit(out, True)
                for out in trie.rest():
                    yield emit(out, False)

            def emit(x: list, spilled: bool):
                values = x[6]
                sha = x[5] or hashlib.sha256((values[t] or b"").translate(None, SPACE)).digest()
                spilled = spilled and not first
                if not (first or carry or spilled):
                    values = (*values[:t], None, *values[t + 1 :])
                return (x[4], sha, x[2], x[3], x[0], spilled, *values), len(values[t] or b"")

            made = rows()
            head = next(made, None)
            if head is not None:
                yield from _batches(_chain(head, made), schema)

        return run

    return side(True), side(False)




def _chain(head, rest):
    yield head
    yield from rest


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = True, budget: int = BUDGET, scratch: Scratch | None = None) -> DataFrame:
    """One row per distinct text: the columns of the row that stays (its text only if carry), with
    _x_len, _x_sha, _x_rows, _x_ties, _x_cps. Written to the shared folder round by round."""
    scratch = scratch or Scratch(docs.sparkSession, "owners")
    first, second = _steps(docs.columns, id_col, text_col, carry, budget)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = f"_x_len bigint, _x_sha binary, _x_rows bigint, _x_ties bigint, _x_cps bigint, _x_spilled boolean, {kinds}"
    todo, done, k = docs.mapInArrow(first, schema), None, 0
    while True:
        if k == 0:
            dealt = todo.repartition("_x_len", "_x_sha")
        else:  # so many partitions that a trie's share is a quarter of its budget
            held = todo.agg(F.sum(F.col("_x_len") + F.octet_length(text_col) + NODE_BYTES)).first()[0]
            dealt = todo.repartition(max(8 * 4**k, -(-4 * held // budget)), "_x_sha", "_x_len", F.lit(k))
        out = scratch.keep(dealt.mapInArrow(second, schema), f"owners{k}")
        part = out.filter("NOT _x_spilled").drop("_x_spilled")
        done = part if done is None else done.unionByName(part)
        todo = out.filter("_x_spilled")
        if todo.isEmpty():
            return done
        k += 1


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, code points, length and SHA-256 of the text without white space."""
    for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
        texts = _plain(batch.column(1))
        keys = [(x or b"").translate(None, SPACE) for x in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64()), pa.array([len(k) for k in keys], pa.int64()), pa.array([hashlib.sha256(k).digest() for k in keys], pa.binary())],
            names=["doc_id", "cps", "len", "sha"],
        )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    scratch = Scratch(docs.sparkSession, "groups")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = owners(slim, carry=False, budget=budget, scratch=scratch)
    own = own.filter("_x_rows > 1").select(F.col("_x_len").alias("len"), F.col("_x_sha").alias("sha"), F.col("doc_id").alias("keep_id"), F.col("_x_rows").alias("group_size"), F.col("_x_ties").alias("ties"), F.col("_x_cps").alias("best"))
    members = slim.mapInArrow(_keys, "doc_id bigint, cps bigint, len bigint, sha binary")
    # a hot group is one key of the left side: the adaptive planner splits it, owners being one row a key
    joined = scratch.keep(members.join(own, ["len", "sha"], "left"), "joined")
    single = F.col("ties").isNull()
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("cps") == F.col("best"))
    tied = ~single & best & (F.col("ties") > 1)
    tied = F.coalesce(tied, F.lit(False))
    cols = lambda kept: ("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    clear = joined.filter(~tied).select(*cols(F.coalesce(single | best, F.lit(False))))
    number = F.row_number().over(W.partitionBy("len", "sha").orderBy("doc_id"))
    return clear.unionByName(joined.filter(tied).select(*cols(number == 1)))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows that stay, with the columns of docs."""
    hidden, names = hide(docs, (id_col, text_col))
    return shown(owners(hidden, id_col, text_col, True, budget), names)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))


def op9_sql() -> str:
    return r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS cps, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY cps DESC, doc_id NULLS LAST)
"""
