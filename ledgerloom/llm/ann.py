"""Approximate nearest neighbours by a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample (``fit_rows`` rows, those of least hash), every row is put
into the leaf that it reaches by nearest centroids, and a query visits leaves best bin first: a
priority queue of nodes by distance to their centroid opens the nearest node until it has given as
many leaves as needed. How many is calibrated: for a bounded set of queries the exact neighbours
among all rows are found by brute force, and visits are widened until the share of them that lies
in visited leaves reaches ``recall``. A query widens further until its leaves hold k candidates.

Leaves are cut into salted parts by their row counts, and probes by theirs (both tables are bounded
by the tree), so neither a leaf that a third of all vectors share nor one that most queries visit
is one task's work. Each part returns the k best of each probe; a window takes the best of those.

Cases: vectors that are null, empty, zero, hold null or non-finite values, or differ in length from
the most common length take no part; rows with a null id take no part; of repeated query ids one
vector (the least) asks, and no row with the query's id is its candidate; repeated rows are
candidates each; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

K, RECALL, BRANCH, DEPTH = 10, 0.97, 8, 4
FIT_ROWS, CALIBRATE, LEAF_ROWS = 20_000, 64, 1_000
#: Rows of a leaf, and probes of a leaf, in one task's group.
PART_ROWS, PART_PROBES = 512, 20_000


class Tree:
    """Centroids of all nodes; kids of node i, leaves numbered in order of discovery."""

    def __init__(self, sample: np.ndarray, depth: int, branch: int = BRANCH, seed: int = 7):
        self.centroids, self.kids, self.leaf = [sample.mean(axis=0)], [[]], [-1]
        rng = np.random.default_rng(seed)
        todo = [(0, sample, depth)]
        leaves = 0
        while todo:
            node, x, left = todo.pop()
            parts = self._split(x, branch, rng) if left and len(x) > branch else []
            if len(parts) < 2:
                self.leaf[node] = leaves
                leaves += 1
                continue
            for center, rows in parts:
                self.kids[node].append(len(self.centroids))
                todo.append((len(self.centroids), rows, left - 1))
                self.centroids.append(center)
                self.kids.append([])
                self.leaf.append(-1)
        self.centroids, self.leaves = np.array(self.centroids), leaves

    @staticmethod
    def _split(x: np.ndarray, branch: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        distinct = np.unique(x, axis=0)
        c = distinct[rng.permutation(len(distinct))[:branch]]
        for _ in range(10):
            at = _nearest(x, c)
            c = np.array([x[at == k].mean(axis=0) if (at == k).any() else c[k] for k in range(len(c))])
        at = _nearest(x, c)
        return [(c[k], x[at == k]) for k in range(len(c)) if (at == k).any()]

    def put(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.kids[node]:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.kids[node])
            at = _nearest(x[rows], self.centroids[kids])
            todo += [(int(kid), rows[at == k]) for k, kid in enumerate(kids)]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves of one query, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.kids[node]:
                yield self.leaf[node]
                continue
            kids = self.kids[node]
            for d, kid in zip(((self.centroids[kids] - q) ** 2).sum(axis=1).tolist(), kids, strict=True):
                heapq.heappush(queue, (d, kid))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def _share(col: str, part: float):
    """Rows whose hashed id falls into so large a part of the hash range."""
    return F.shiftrightunsigned(F.xxhash64(col), 1) <= F.lit(min(2**63 - 1, int(part * 2**63)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v array<double> of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (common.n if common else 0))


def _best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Position of each query with its k nearest rows of x and their distances; differences are
    taken in double precision, ties go to the smaller id."""
    step = max(1, 4_000_000 // max(1, x.size))
    for at in range(0, len(q), step):
        d = np.sqrt(((q[at : at + step, None, :] - x[None]) ** 2).sum(axis=-1))
        for i, row in enumerate(d):
            mine = np.flatnonzero(ids != own[at + i])
            if len(mine) > k:
                cut = np.partition(row[mine], k - 1)[k - 1]
                mine = mine[row[mine] <= cut]
            mine = mine[np.lexsort((ids[mine], row[mine]))][:k]
            yield at + i, ids[mine], row[mine]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("leaf", pa.int32())])


def _found(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = [np.concatenate([np.full(len(r[1]), r[0], np.int64) for r in rows] or [[]]), *(np.concatenate([r[k] for r in rows] or [[]]) for k in (1, 2, 3))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int = K, recall: float = RECALL, fit_rows: int = FIT_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row that is_query (a Column
    on vec_id) holds for."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.keep(usable(vectors, id_col, vec_col), "rows")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = np.array([r.v for r in rows.filter(_share("vec_id", fit_rows / n)).select("v").limit(fit_rows).collect()] or [rows.first().v])
    depth = 1
    while depth < DEPTH and BRANCH**depth * LEAF_ROWS < n:
        depth += 1
    tree = Tree(sample[np.lexsort(sample.T[::-1])], depth)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.put(_matrix(b.column(1))))], names=["vec_id", "v", "leaf"])

    indexed = scratch.keep(rows.mapInArrow(index, "vec_id bigint, v array<double>, leaf int"), "index")
    sizes = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # at most the tree's leaves
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = scratch.keep(queries.withColumnRenamed("vec_id", "query_id"), "queries")
    m = queries.count()
    few = queries.filter(_share("query_id", 2.0 * CALIBRATE / max(1, m))).limit(CALIBRATE).collect()
    visits = _calibrate(indexed, tree, few, sizes, k, recall)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, leaves = [], []
            for i, q in enumerate(_matrix(b.column(1))):
                held, opened = 0, 0
                for leaf in tree.visits(q):
                    if opened >= visits and held > k:
                        break
                    opened += 1
                    if leaf in sizes:
                        held += sizes[leaf]
                        take.append(i)
                        leaves.append(leaf)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(leaves, pa.int32())], names=["query_id", "q", "leaf"])

    probes = scratch.keep(queries.repartition("query_id").mapInArrow(probe, "query_id bigint, q array<double>, leaf int"), "probes")
    asked = {r.leaf: r["count"] for r in probes.groupBy("leaf").count().collect()}  # at most the tree's leaves
    cut = spark.createDataFrame([(leaf, -(-c // PART_ROWS), -(-asked.get(leaf, 0) // PART_PROBES)) for leaf, c in sizes.items()], "leaf int, row_parts int, probe_parts int")
    cut = F.broadcast(cut)
    part = lambda c, of: F.pmod(F.xxhash64(c, F.lit("part")), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = indexed.join(cut, "leaf").filter("probe_parts > 0").select("leaf", part("vec_id", "row_parts").alias("rp"), every("probe_parts").alias("pp"), "vec_id", "v")
    right = probes.join(cut, "leaf").select("leaf", every("row_parts").alias("rp"), part("query_id", "probe_parts").alias("pp"), "query_id", "q")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _FOUND.empty_table()
        ids, own = a.column("vec_id").to_numpy(), b.column("query_id").to_numpy()
        x, q = _matrix(a.column("v").combine_chunks()), _matrix(b.column("q").combine_chunks())
        leaf = a.column("leaf")[0].as_py()
        return pa.Table.from_batches([_found([(int(own[i]), near, d, np.full(len(near), leaf, np.int32)) for i, near, d in _best(q, ids, x, own, k)])])

    by = ["leaf", "rp", "pp"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double, leaf int")
    return _top(found, k).select("query_id", "rank", "vec_id", "score")


def _calibrate(indexed: DataFrame, tree: Tree, few: list, sizes: dict, k: int, recall: float) -> int:
    """How many leaves to visit so that the mean recall of the calibration queries reaches the aim."""
    if not few:
        return 1
    own, q = np.array([r.query_id for r in few]), np.array([r.v for r in few])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
                x = _matrix(b.column(1))
                where = {int(i): int(f) for i, f in zip(ids, leaf, strict=True)}
                yield _found([(int(own[i]), near, d, np.array([where[int(j)] for j in near], np.int32)) for i, near, d in _best(q, ids, x, own, k)])

    true = _top(indexed.mapInArrow(exact, "query_id bigint, vec_id bigint, score double, leaf int"), k).collect()
    order = {int(o): {leaf: i for i, leaf in enumerate(leaf for leaf in tree.visits(v))} for o, v in zip(own, q, strict=True)}
    need: dict[int, list[int]] = {}
    for r in true:
        need.setdefault(r.query_id, []).append(order[r.query_id][r.leaf] + 1)
    visits = 1
    while need and visits < tree.leaves and np.mean([np.mean([x <= visits for x in xs]) for xs in need.values()]) < recall:
        visits += 1
    return visits


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 100 == 0)
