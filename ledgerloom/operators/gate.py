"""The quality gate: every reason against a declaration, in order and once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_number, parse_packages

MASS_TOLERANCE = 0.05


def _bad_mass(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x <= 0)


def line_reasons(line: Column, n: Column) -> Column:
    gross, net, packs, name, code = (line[c] for c in ("gross", "net", "packages", "designation", "code"))
    say = lambda text: F.concat(F.lit("line "), n.cast("string"), F.lit(f": {text}"))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(name, F.lit("")) == "", say("designation missing")),
            F.when(~code.rlike(r"^\d{6,10}$"), say("commodity code missing or invalid")),
            F.when(_bad_mass(gross), say("gross mass missing or invalid")),
            F.when(_bad_mass(net), say("net mass missing or invalid")),
            F.when(net > gross, say("net mass over gross mass")),
            F.when(packs.isNull() | (packs <= 0), say("packages missing or ambiguous")),
        )
    )


def _parsed(d: DataFrame) -> DataFrame:
    """Numbers are read once, in a projection of their own."""
    lines = F.coalesce(F.col("lines"), F.array().cast(d.schema["lines"].dataType))
    line = lambda x: F.struct(
        x["designation"].alias("designation"), F.regexp_replace(F.coalesce(x["code"], F.lit("")), r"[.\s]", "").alias("code"),
        parse_number(x["gross"]).alias("gross"), parse_number(x["net"]).alias("net"), parse_packages(x["packages"]).alias("packages"),
    )
    return d.withColumns({"_lines": F.transform(lines, line), "_total": parse_number(F.col("total_gross")), "_packs": parse_packages(F.col("total_packages"))})


def _reasons() -> Column:
    """For declarations with mrn, verified, dm, parties, lines array<struct>, total_gross,
    total_packages, discrepancy, model_used, evidence, blockers, warnings."""
    lines = F.col("_lines")
    per_line = F.flatten(F.transform(lines, lambda x, i: line_reasons(x, i + 1)))
    total, packs = F.col("_total"), F.col("_packs")
    masses, counts = F.transform(lines, lambda x: x["gross"]), F.transform(lines, lambda x: x["packages"])
    whole = lambda a: (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull())
    add = lambda a, zero: F.aggregate(a, zero, lambda s, x: s + x)
    before = F.array(
        F.when(~F.coalesce(F.col("mrn"), F.lit("")).rlike("^[0-9]{2}[A-Z]{2}[A-Z0-9]{14}$"), "identifier missing or malformed"),
        F.when(~F.coalesce(F.col("verified"), F.lit(False)), "identifier not corroborated"),
        F.when(F.coalesce(F.col("dm"), F.lit("")).rlike("^$|(?i)vérifier|compléter|absent|inconnu"), "announcement number missing"),
        F.when(F.size(F.coalesce(F.col("parties"), F.array())) == 0, "parties missing"),
        F.when(F.size(lines) == 0, "no lines"),
    )
    after = F.array(
        F.when(_bad_mass(total), "total gross mass missing or invalid").when(whole(masses) & (F.abs(add(masses, F.lit(0.0)) - total) > MASS_TOLERANCE), "gross masses differ from the total"),
        F.when(packs.isNull() | (packs <= 0), "total packages missing or invalid").when(whole(counts) & (add(counts, F.lit(0)) != packs), "packages differ from the total"),
        F.nullif(F.col("discrepancy"), F.lit("")),
        F.when(F.coalesce(F.col("model_used"), F.lit(False)), "model reading needs a person"),
        F.when(F.size(F.coalesce(F.col("evidence"), F.array())) == 0, "no evidence"),
    )
    loud = F.filter(F.coalesce(F.col("warnings"), F.array()), lambda m: (F.contains(m, F.lit("MRN")) & F.contains(m, F.lit("différent"))) | m.rlike("(?i)non associ|non extrait|illisible"))
    blockers = F.coalesce(F.col("blockers"), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(blockers, F.array_compact(before), per_line, F.array_compact(after), loud))


def gate(declarations: DataFrame) -> DataFrame:
    """declarations with reasons and deliverable."""
    d = _parsed(declarations).withColumn("reasons", _reasons()).drop("_lines", "_total", "_packs")
    return d.withColumn("deliverable", F.size("reasons") == 0)


def incomplete(lines: DataFrame, key: str) -> DataFrame:
    """key and incomplete: no line, or a line without code or without any mass."""
    bad = F.col("code").isNull() | (F.col("gross").isNull() & F.col("net").isNull())
    return lines.groupBy(key).agg(F.coalesce(F.bool_or(bad), F.lit(True)).alias("incomplete"))
