"""Gap-free yearly numbers, idempotent by the set of references they were given for.

Allocation is serial by nature: requests of a batch are few against the data behind them, and only
their identities are ordered. State is three relations; every function returns the new ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import identity

CAP = 9999


class RegistryError(ValueError):
    """A request the registry refuses; nothing is consumed."""


@dataclass(frozen=True)
class State:
    """announcements(identity, year, sequence, prefix), members(ref, identity), counters(year, last),
    journal(action, operator, detail); cutover year and sequence, None before activation."""

    announcements: DataFrame
    members: DataFrame
    counters: DataFrame
    journal: DataFrame
    cutover: tuple[int, int] | None = None


def empty(spark: SparkSession) -> State:
    make = lambda s: spark.createDataFrame([], s)
    return State(make("identity string, year int, sequence int, prefix boolean"), make("ref string, identity string"), make("year int, last int"), make("action string, operator string, detail string"))


def _require(ok: bool, why: str) -> None:
    if not ok:
        raise RegistryError(why)


def _log(s: State, action: str, operator: str, detail: str) -> DataFrame:
    _require(bool(operator and operator.strip()), "an operator is needed")
    return s.journal.unionByName(s.journal.sparkSession.createDataFrame([(action, operator, detail)], s.journal.schema))


def activate(s: State, year: int, last: int, operator: str) -> State:
    _require(s.cutover is None, "already activated")
    counters = s.counters.sparkSession.createDataFrame([(year, last)], s.counters.schema)
    return State(s.announcements, s.members, counters, _log(s, "activate", operator, f"{year}{last:04d}"), (year, last))


def allocate(s: State, refs: list[str], year: int, operator: str, existing: tuple[int, int, bool] | None = None, simulate: bool = False) -> tuple[State, str, bool]:
    """(state, number, reused) for one set of references; ``existing`` adopts a number from before the
    cut-over. A simulation answers without changing anything."""
    spark = s.members.sparkSession
    key = spark.createDataFrame([(refs,)], "r array<string>").select(identity(F.col("r")).alias("k")).first().k
    _require(key is not None, "references must be 1 to 100, well-formed and distinct")
    row = s.announcements.filter(F.col("identity") == key).first()
    if row:
        _require(not existing or existing[:2] == (row.year, row.sequence), "the source's number differs from the registered one")
        return s, f"{row.year}{row.sequence:04d}", True
    taken = s.members.filter(F.col("ref").isin(key.split("|"))).first()
    _require(taken is None, "a reference belongs to another set")
    if simulate:
        return s, "", False
    _require(s.cutover is not None, "not activated")
    latest = s.counters.agg(F.max("year").alias("y")).first().y
    _require(year >= max(s.cutover[0], latest or 0), "the clock is before the latest year")
    last = s.counters.filter(F.col("year") == year).first()
    y, n, prefix = existing or (year, (last.last if last else 0) + 1, False)
    if existing:
        _require(n > 0 and y <= year, "invalid or future number")
        _require((y, n) <= s.cutover, "a number after the cut-over must come from the registry")
    _require(n <= CAP, "the year's numbers are used up")
    _require(s.announcements.filter((F.col("year") == y) & (F.col("sequence") == n)).first() is None, "the number belongs to another announcement")
    counters = s.counters if existing else s.counters.filter(F.col("year") != year).unionByName(spark.createDataFrame([(y, n)], s.counters.schema))
    new = State(
        s.announcements.unionByName(spark.createDataFrame([(key, y, n, prefix)], s.announcements.schema)),
        s.members.unionByName(spark.createDataFrame([(r, key) for r in key.split("|")], s.members.schema)),
        counters,
        _log(s, "adopt" if existing else "allocate", operator, key),
        s.cutover,
    )
    return new, f"{y}{n:04d}", False


def set_prefix(s: State, key: str, prefix: bool, operator: str) -> State:
    _require(s.announcements.filter(F.col("identity") == key).first() is not None, "unknown announcement")
    rows = s.announcements.withColumn("prefix", F.when(F.col("identity") == key, F.lit(prefix)).otherwise(F.col("prefix")))
    return State(rows, s.members, s.counters, _log(s, "prefix", operator, key), s.cutover)


def allocate_batch(requests: DataFrame, year: str, key: str, order: list[str], known: DataFrame | None = None, last: DataFrame | None = None) -> DataFrame:
    """requests(key, year, ...) with sequence: identities already known keep their number, each other
    identity takes the next one of its year in the order of its first request."""
    first = requests.groupBy(year, key).agg(F.min(F.struct(*order)).alias("_o"))
    if known is not None:
        first = first.join(known.select(key), key, "left_anti")
    w = W.partitionBy(year).orderBy("_o", key)
    numbered = first.withColumn("sequence", F.row_number().over(w))
    if last is not None:
        numbered = numbered.join(last, year, "left").withColumn("sequence", F.col("sequence") + F.coalesce("last", F.lit(0))).drop("last")
    numbered = numbered.select(key, year, "sequence")
    return numbered if known is None else known.select(key, year, "sequence").unionByName(numbered)
