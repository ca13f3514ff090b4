"""Aggregates with the engine's own rules for missing values and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_or_null(c: Column) -> Column:
    """A sum only if every row has a value (and there is one); null otherwise."""
    return F.when((F.count(c) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0), F.sum(c))


def sum_or_zero(c: Column) -> Column:
    """A sum only if every row has a value; 0, which callers read as unknown, otherwise."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.coalesce(F.sum(c), F.lit(0))).otherwise(0)


def first_filled(c: Column, order: Column, valid: Column | None = None) -> Column:
    """The first value in order that is there (and valid)."""
    ok = c.isNotNull() & (c != "") if valid is None else c.isNotNull() & valid
    return F.min_by(c, F.when(ok, order))


def cross_check(df: DataFrame, pairs: dict[str, tuple[str, str, float]], out: str = "discrepancy") -> DataFrame:
    """Texts of declared totals that differ from complete sums: name -> (declared, summed, tolerance)."""
    notes = [F.when(F.abs(F.col(a) - F.col(b)) > tol, F.concat(F.lit(f"{name}: "), F.col(a).cast("string"), F.lit(" / "), F.col(b).cast("string"))) for name, (a, b, tol) in pairs.items()]
    return df.withColumn(out, F.array_join(F.array_compact(F.array(*notes)), " | "))


def best_group(fragments: DataFrame, key: list[str], group: str, order: str, fields: list[str]) -> DataFrame:
    """Per key the group whose first filled fields are most; the earliest group on ties."""
    merged = fragments.groupBy(*key, group).agg(*[first_filled(F.col(f), F.col(order)).alias(f) for f in fields], F.min(order).alias("_at"))
    score = sum((F.coalesce(F.col(f) != "", F.lit(False)).cast("int") for f in fields), F.lit(0))
    merged = merged.withColumn("filled", score)
    best = merged.groupBy(*key).agg(F.max_by(F.struct(group, *fields, "filled"), F.struct("filled", -F.col("_at"))).alias("b"))
    return best.select(*key, "b.*")


def complete_sequence(df: DataFrame, key: list[str], position: str, first: int = 0) -> DataFrame:
    """key, n, complete: positions run from first without gap or repetition."""
    agg = df.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct(position).alias("d"), F.min(position).alias("lo"), F.max(position).alias("hi"))
    return agg.select(*key, "n", ((F.col("n") == F.col("d")) & (F.col("lo") == first) & (F.col("hi") == first + F.col("n") - 1)).alias("complete"))
