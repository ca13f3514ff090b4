"""From declarations to one announcement: flattened lines, groups, pages, numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flatten_lines(lines: DataFrame, batch: list[str], order: list[str], name: str, ref: str) -> DataFrame:
    """lines renumbered 1..n in their batch; names carry the reference if the batch has several."""
    w = W.partitionBy(*batch).orderBy(*order)
    every = W.partitionBy(*batch)
    many = F.min(ref).over(every) != F.max(ref).over(every)
    return lines.withColumn("no", F.row_number().over(w)).withColumn(name, F.when(many, F.concat(F.col(name), F.lit(" ["), F.col(ref).cast("string"), F.lit("]"))).otherwise(F.col(name)))


def keep_first(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def paginate(heights: Column, most: int, bound: float, final: float | None = None) -> Column:
    """Page numbers of an ordered array of heights: a page holds at most ``most`` of them and at most
    ``bound`` together; a page of one is never too full to exist. With ``final``, the height of the
    closing block, a line higher than the bound is an error, and the last line moves to a page of its
    own if the block does not fit below the last page's lines. A fold, since a page's room depends on
    where the last one ended."""
    start = F.struct(F.lit(1).alias("page"), F.lit(0).alias("n"), F.lit(0.0).alias("h"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        turn = (acc["n"] > 0) & ((acc["n"] >= most) | (acc["h"] + h > bound))
        page = F.when(turn, acc["page"] + 1).otherwise(acc["page"])
        return F.struct(page.alias("page"), F.when(turn, 1).otherwise(acc["n"] + 1).alias("n"), F.when(turn, h).otherwise(acc["h"] + h).alias("h"), F.array_append(acc["out"], page).alias("out"))

    def close(acc: Column) -> Column:
        moved = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(acc["page"] + 1))
        return F.when((acc["n"] > 1) & (acc["h"] + final > bound), moved).otherwise(acc["out"])

    if final is None:
        return F.aggregate(heights, start, step, lambda acc: acc["out"])
    tall = F.exists(heights, lambda h: h > bound)
    return F.when(tall, F.raise_error(F.lit("a line is too tall for a page"))).otherwise(F.aggregate(heights, start, step, close))


def party_groups(parties: DataFrame, by: list[str], ref: str) -> DataFrame:
    """One row per party with the references it stands in, joined in order."""
    return parties.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(F.col(ref).cast("string"))), ",").alias("refs"), F.countDistinct(ref).alias("n_refs"))


def merge_declarations(declarations: DataFrame, batch: str, order: str) -> DataFrame:
    """One nested announcement per batch: principal declaration, all lines renumbered with their
    reference when there are several, totals only where every part is known, identifiers in order."""
    item = F.struct(order, "mrn", "dm", "lines", "gross", "packages", "parties")
    d = declarations.groupBy(batch).agg(F.array_sort(F.collect_list(item)).alias("d"))
    many = F.size("d") > 1
    named = F.flatten(F.transform("d", lambda x: F.transform(x["lines"], lambda l: l.withField("designation", F.when(many, F.concat(l["designation"], F.lit(" ["), x["mrn"], F.lit("]"))).otherwise(l["designation"])))))
    whole = lambda f: F.forall("d", lambda x: x[f].isNotNull())
    add = lambda f, zero: F.aggregate(F.transform("d", lambda x: x[f]), zero, lambda s, x: s + x)
    return d.select(
        batch,
        F.get("d", F.lit(0))["dm"].alias("dm"),
        F.transform("d", lambda x: x["mrn"]).alias("mrns"),
        F.transform(named, lambda l, i: l.withField("no", i + 1)).alias("lines"),
        F.when(whole("gross"), add("gross", F.lit(0.0))).alias("gross"),
        F.when(whole("packages"), add("packages", F.lit(0))).alias("packages"),
        F.array_distinct(F.flatten(F.transform("d", lambda x: x["parties"]))).alias("parties"),
    )


def to_json_documents(announcements: DataFrame, batch: str) -> DataFrame:
    """key and json, one document a batch: the announcement sink's rows."""
    rest = [c for c in announcements.columns if c != batch]
    return announcements.select(F.col(batch), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))


def keep_new(facts: DataFrame, batch: str, order: list[str], always: str = "MRN") -> DataFrame:
    """facts (label, value) of a batch's declarations, a pair only where it comes first; labels of
    identifiers always stay."""
    w = W.partitionBy(batch, "label", "value").orderBy(*order)
    return facts.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | (F.col("label") == always)).drop("_n")


def route(status: Column, name: Column, taken: Column, stamp: Column) -> Column:
    """The path of a rendered announcement: its folder by the gate, the time appended where the name is taken."""
    folder = F.when(status == "ready", "Prets_a_remettre").otherwise("A_verifier")
    return F.concat(folder, F.lit("/"), name, F.when(taken, F.concat(F.lit("_"), stamp)).otherwise(""), F.lit(".pdf"))


def wrap(text: Column, most: int) -> Column:
    """Lines of at most ``most`` characters, words kept whole unless one alone is longer; one empty line
    for an empty text. Widths are characters: a renderer with a font brings its own measure."""
    pieces = F.flatten(F.transform(F.split(text, " "), lambda w: F.regexp_extract_all(w, F.lit(f"(?s)(.{{1,{most}}})"), F.lit(1))))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(acc: Column, w: Column) -> Column:
        fits = (acc["line"] == "") | (F.length(acc["line"]) + 1 + F.length(w) <= most)
        longer = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        return F.struct(F.when(fits, acc["lines"]).otherwise(F.array_append(acc["lines"], acc["line"])).alias("lines"), F.when(fits, longer).otherwise(w).alias("line"))

    return F.aggregate(pieces, start, step, lambda acc: F.array_append(acc["lines"], acc["line"]))


def journal(lines: DataFrame, run: str, order: list[str]) -> DataFrame:
    """One report a run: its lines (line) in order."""
    return lines.groupBy(run).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n").alias("report"))
