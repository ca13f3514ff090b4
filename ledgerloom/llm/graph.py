"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(e: DataFrame, keep: Callable) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, keep: Callable) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = keep(down.groupBy("u").agg(F.min("v").alias("m")))
    rest = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """u, v: every node that is not its component's smallest, with that smallest node. Edges have
    u and v of one orderable type. Each step is written to the shared folder, so a lost executor
    repeats at most one; a node with very many neighbours is one key of aggregates that combine
    before the shuffle and of joins that the adaptive planner splits (the least neighbours are
    written first, since a join right above their aggregate could not be split)."""
    e = scratch.keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges0")
    before, k = None, 0
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or state.n == 0:
            return e
        before, k = state, k + 1
        large = scratch.keep(_large_star(e, lambda x: scratch.keep(x, f"least{k}")), f"large{k}")  # noqa: B023
        e = scratch.keep(_small_star(large, lambda x: scratch.keep(x, f"least{k}s")), f"edges{k}")  # noqa: B023
        for name in (f"edges{k - 1}", f"least{k}", f"large{k}", f"least{k}s"):
            scratch.drop(name)
