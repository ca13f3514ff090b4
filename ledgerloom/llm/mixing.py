"""Mixing sources to target weights by repetition rates.

Words are summed per source; a source's target is its weight's share of all words, cut at ``cap``
times what the source has, the excess going to the others by weight until none is above. The rate
is target over words: a document is taken floor(rate) times and once more when a hash-seeded
Bernoulli draw falls below the fraction. Each source draws under a few seeds and keeps the one
whose words come nearest its target (ties: the smaller seed), so a source of few long documents
does not miss by chance, and reruns agree.

Nulls: a null text has no words; a null source is a source of its own, last in order; a null
doc_id draws as the empty string. Repeated rows draw alike. An empty table gives an empty result;
a source without words has target and rate 0. Other columns pass through ``mix`` untouched under
their own names, whatever these are; of ``mix`` the operator's own columns (size, source_size, target,
rate, copies) replace columns of the same name, ``take`` returns the columns of docs and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, documents, hide, shown, sql_uniform, uniform

WEIGHTS, CAP, SEEDS = (5, 2, 1), 3, 8
#: Sources up to this many rows are sent to every task; beyond it the join shuffles.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target from (source, size); one row per source.

    Filling by weight under caps has a closed form: in order of cap over weight, a source is capped
    while its cap is within the level that the words and weights left over would give."""
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    stats = stats.withColumn("_n", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    stats = stats.withColumn("_w", weight).withColumn("_cap", F.col("source_size").cast("double") * float(cap))
    stats = stats.withColumn("_r", F.col("_cap") / F.col("_w"))
    everything = W.partitionBy()
    before = W.orderBy("_r", "_n").rowsBetween(W.unboundedPreceding, -1)
    total, mass = F.sum(F.col("source_size").cast("double")).over(everything), F.sum("_w").over(everything)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (mass - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    stats = stats.withColumn("_level", level)
    free = F.max(F.when(F.col("_r") > F.col("_level"), F.col("_level"))).over(everything)
    target = F.when(F.col("_r") > F.col("_level"), F.least(free * F.col("_w"), F.col("_cap"))).otherwise(F.col("_cap"))
    return stats.select("source", "source_size", target.alias("target"))


def _copies(rate: Column, u: Column) -> Column:
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def mix_plan(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seeds: int = SEEDS) -> DataFrame:
    """source, source_size, target, rate, seed of every source. slim: doc_id, source, size."""
    t = source_targets(slim, weights, cap)
    t = t.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0))
    tried = _join(slim, t)
    sums = tried.groupBy("source").agg(*[F.sum(F.col("size") * _copies(F.col("rate"), uniform(F.col("doc_id"), F.lit(f"mix{k}")))).alias(f"_t{k}") for k in range(seeds)])
    sums = sums.withColumnRenamed("source", "_s")
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_t{k}") - F.col("target")).alias("d"), F.lit(k).alias("k")) for k in range(seeds)])).getField("k")
    return t.join(sums, F.col("source").eqNullSafe(F.col("_s"))).select("source", "source_size", "target", "rate", best.alias("seed"))


def _join(slim: DataFrame, per_source: DataFrame) -> DataFrame:
    p = per_source.withColumnRenamed("source", "_source")
    return slim.join(p, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seeds: int = SEEDS) -> DataFrame:
    """Every row of docs with size, source_size, target, rate and copies (how often the mix takes it)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    slim = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    plan = scratch.keep(mix_plan(scratch.keep(slim, "slim"), weights, cap, seeds), "plan")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    own = ("size", "source_size", "target", "rate", "copies")
    hidden, names = hide(docs, ("doc_id", "source", "text"))
    out = _join(hidden.withColumn("size", words(F.col("text"))), plan).withColumn("copies", _copies(F.col("rate"), _seeded()))
    return out.select(*[F.col(s).alias(n) for s, n in names.items() if n not in own], *own)


def _seeded() -> Column:
    return uniform(F.col("doc_id"), F.concat(F.lit("mix"), F.col("seed").cast("string")))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row ``copies`` times, with its number from 0 in copy_no."""
    return mixed.filter("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seeds: int = SEEDS) -> DataFrame:
    """The rows of docs as often as the mix takes them."""
    hidden, names = hide(docs, ("doc_id", "source", "text"))
    return shown(emit(mix(hidden, weights, cap, seeds)), names)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_sql() -> str:
    u = lambda k: sql_uniform("doc_id", f"'mix{k}'")
    copies = lambda k: f"(floor(rate) + CASE WHEN {u(k)} < rate - floor(rate) THEN 1 ELSE 0 END)"
    tries = ", ".join(f"sum(size * CAST({copies(k)} AS BIGINT)) AS t{k}" for k in range(SEEDS))
    gaps = ", ".join(f"abs(t{k} - target)" for k in range(SEEDS))
    seed = f"CASE least({gaps}) " + " ".join(f"WHEN abs(t{k} - target) THEN {k}" for k in range(SEEDS)) + " END"
    taken = "CASE seed " + " ".join(f"WHEN {k} THEN {copies(k)}" for k in range(SEEDS)) + " END"
    weight = "[" + ", ".join(f"{float(w)}" for w in WEIGHTS) + "]"
    return f"""
WITH slim AS (SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s1),
s3 AS (SELECT *, CAST(({weight})[CAST(n % {len(WEIGHTS)} + 1 AS INTEGER)] AS DOUBLE) AS w, CAST(source_size AS DOUBLE) * {float(CAP)} AS c FROM s2),
s4 AS (SELECT *, c / w AS r FROM s3),
s5 AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(c) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
       FROM s4 WINDOW b AS (ORDER BY r, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s6 AS (SELECT source, source_size, CASE WHEN r > level THEN least(max(CASE WHEN r > level THEN level END) OVER () * w, c) ELSE c END AS target FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, {float(CAP)}) ELSE 0.0 END AS rate FROM s6),
j AS (SELECT d.doc_id, d.size, p.* FROM slim d JOIN s7 p ON d.source IS NOT DISTINCT FROM p.source),
tried AS (SELECT source, {tries}, any_value(target) AS target FROM j GROUP BY source),
best AS (SELECT source, {seed} AS seed FROM tried)
SELECT j.doc_id, j.size, j.source_size, j.target, CAST(j.size * ({taken}) AS BIGINT) AS taken
FROM j JOIN best ON j.source IS NOT DISTINCT FROM best.source
"""
