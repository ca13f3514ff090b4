"""Completing declarations from model readings and staged lookups, and what a person sees and confirms.

Lines are structs (no, designation, code, gross, net, packages, previous), parties structs (role, name,
address), transport facts structs (label, value), all of strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scalars import format_kg, model_mass, model_text, parse_number, transport_label
from .gate import gate
from .reconcile import MOVEMENT

LINE_FIELDS = ("code", "gross", "net", "packages", "previous")
MASSES = ("gross", "net")


def _said(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array())


def lacking(lines: Column, parties: Column) -> Column:
    """Whether only an image could tell what is missing: no line, one without designation, code or any
    mass, or no party."""
    whole = F.forall(lines, lambda x: _said(x["designation"]).isNotNull() & _said(x["code"]).isNotNull() & F.coalesce(_said(x["gross"]), _said(x["net"])).isNotNull())
    return ~(F.coalesce(F.size(lines) > 0, F.lit(False)) & F.coalesce(whole, F.lit(False)) & F.coalesce(F.size(parties) > 0, F.lit(False)))


def reading_wanted(declarations: DataFrame) -> DataFrame:
    """declarations (file_id, decl_id, lines, parties, several_notes) with wanted, and why_not where pages are
    incomplete and yet not read: a file of several declarations, or one with several shipments."""
    counts = declarations.groupBy("file_id").agg(F.count("*").alias("_n"))
    short = lacking(F.col("lines"), F.col("parties"))
    why = F.when(F.col("_n") > 1, "several declarations in the file").when(F.col("several_notes"), "several shipments annexed")
    d = declarations.join(counts, "file_id")
    return d.withColumns({"wanted": short & why.isNull(), "why_not": F.when(short, why)}).drop("_n")


def read_within_budget(pages: DataFrame, read: Callable[[DataFrame], DataFrame], budget: int = 12) -> tuple[DataFrame, DataFrame]:
    """Pages (decl_id, page, family, richness, image) from the most telling on, at most ``budget`` of a
    declaration, an image only once. ``read`` adds a column reading to its pages, null where it failed.
    Returns the log (decl_id, page, status, reading) and the blockers (decl_id, blockers)."""
    first = F.when(F.col("family").isin(*rules.FIRST_READ), 0).when(F.col("family").isin(*rules.SECOND_READ), 1).otherwise(2)
    order = W.partitionBy("decl_id").orderBy(first, F.desc("richness"), "page")
    usable = pages.filter(~F.coalesce(F.col("family").isin("ENVELOPPE", "EXPORT"), F.lit(False)))
    chosen = usable.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= budget)
    chosen = chosen.withColumn("_copy", F.col("image").isNotNull() & (F.row_number().over(W.partitionBy("decl_id", "image").orderBy("_k")) > 1))
    answers = read(chosen.filter(~F.col("_copy"))).select("decl_id", "page", F.when(F.col("reading").isNull(), "failed").otherwise("read").alias("status"), "reading")
    log = answers.unionByName(chosen.filter("_copy").select("decl_id", "page", F.lit("copy").alias("status"), F.lit(None).cast(answers.schema["reading"].dataType).alias("reading")))
    over = usable.groupBy("decl_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > budget)
    limited = over.select("decl_id", F.lit(0).alias("page"), F.concat(F.lit(f"reading limited to {budget} of "), F.col("_n").cast("string"), F.lit(" pages")).alias("text"))
    failed = answers.filter("status = 'failed'").select("decl_id", "page", F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": reading failed")).alias("text"))
    told = limited.unionByName(failed).groupBy("decl_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("w"))
    return log, told.select("decl_id", F.col("w.text").alias("blockers"))


def _read_line(x: Column, field: str) -> Column:
    return model_mass(x[field]) if field in MASSES else model_text(x[field])


def _without_code(name: Column, code: Column) -> Column:
    """A designation without the commodity code that a model likes to add to it."""
    pattern = F.concat(F.lit(rules.CODE_PREFIX), F.lit(r"\Q"), F.replace(code, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    bare = F.btrim(F.regexp_replace(name, pattern, F.lit("")), F.lit(" ,;.-"))
    return F.when(F.contains(name, code), F.coalesce(F.nullif(bare, F.lit("")), name)).otherwise(name)


def _new_line(x: Column, i: Column) -> Column:
    name, code = model_text(x["designation"]), model_text(x["code"])
    fields = [_read_line(x, f).alias(f) for f in LINE_FIELDS]
    return F.struct(F.coalesce(model_text(x["no"]), (i + 1).cast("string")).alias("no"), F.coalesce(_without_code(name, code), name).alias("designation"), *fields)


def _filled_line(x: Column, read: Column) -> Column:
    key = lambda y: F.lower(_said(y["designation"]))
    same = F.filter(read, lambda y: key(y) == key(x))
    one = F.when(F.size(same) == 1, F.get(same, F.lit(0)))
    return F.struct(x["no"].alias("no"), x["designation"].alias("designation"), *[F.coalesce(_said(x[f]), _read_line(one, f)).alias(f) for f in LINE_FIELDS])


def _new_facts(known: Column, read: Column) -> Column:
    """Facts whose label has a canonical form not yet known and whose value suits it; the first of each."""

    def fact(t: Column) -> Column:
        label, value = transport_label(model_text(t["label"]), rules.TRANSPORT_LABELS), model_text(t["value"])
        mass = label.isin("Masse brute totale", "Masse nette totale")
        fit = F.when(mass, model_mass(value)).when((label == "Véhicule / mode") & ~value.rlike(rules.VEHICLE), None).otherwise(value)
        return F.struct(label.alias("label"), fit.alias("value"))

    have = F.transform(known, lambda k: F.lower(k["label"]))
    good = F.filter(F.transform(read, fact), lambda t: t["label"].isNotNull() & t["value"].isNotNull() & ~F.coalesce(F.array_contains(have, F.lower(t["label"])), F.lit(False)))
    return F.filter(good, lambda t, i: ~F.exists(F.slice(good, F.lit(1), i), lambda s: s["label"] == t["label"]))


def fill_from_reading(declarations: DataFrame, readings: DataFrame) -> DataFrame:
    """declarations (decl_id, lines, parties, transport, total_gross, total_packages, goods_source,
    warnings) completed by at most one reading each (decl_id, lines, parties, transport, total_gross,
    total_packages, comment), and changed. Lines are replaced only if none has a designation; else a
    line takes what it lacks from the one read line of its name. Parties only if there are none, new
    canonical facts, totals only if missing; a comment becomes a warning."""
    given = ("lines", "parties", "transport", "total_gross", "total_packages", "comment")
    d = declarations.join(readings.select("decl_id", *[F.col(c).alias(f"_{c}") for c in given]), "decl_id", "left")
    d = d.withColumns({
        "_lines": F.filter(_list("_lines"), lambda x: model_text(x["designation"]).isNotNull()),
        "_parties": F.filter(_list("_parties"), lambda p: model_text(p["name"]).isNotNull()),
    })
    replace = (F.size("_lines") > 0) & ~F.exists(_list("lines"), lambda x: _said(x["designation"]).isNotNull())
    lines = F.when(replace, F.transform("_lines", _new_line)).otherwise(F.transform(_list("lines"), lambda x: _filled_line(x, F.col("_lines"))))
    parties = F.transform("_parties", lambda p: F.struct(model_text(p["role"]).alias("role"), model_text(p["name"]).alias("name"), model_text(p["address"]).alias("address")))
    count = F.nullif(F.regexp_replace(model_text(F.col("_total_packages")), r"\D", ""), F.lit(""))
    d = d.withColumns({
        "_replaced": replace, "_new": lines, "_people": F.when(F.size(_list("parties")) == 0, parties), "_facts": _new_facts(_list("transport"), _list("_transport")),
        "_packs": F.when(_said(F.col("total_packages")).isNull(), F.concat(count, F.lit(" colis"))), "_gross": F.when(_said(F.col("total_gross")).isNull(), format_kg(parse_number(model_text(F.col("_total_gross"))))),
    })
    gained = F.exists(F.arrays_zip(F.col("_new").alias("n"), _list("lines").alias("o")), lambda z: F.array(*[_said(z["n"][f]).isNotNull() & _said(z["o"][f]).isNull() for f in LINE_FIELDS]) != F.array(*[F.lit(False)] * len(LINE_FIELDS)))
    changed = F.col("_replaced") | F.coalesce(gained, F.lit(False)) | (F.size(F.coalesce("_people", F.array())) > 0) | (F.size("_facts") > 0) | F.col("_packs").isNotNull() | F.col("_gross").isNotNull()
    said = F.array_compact(F.array(
        F.when(F.col("_replaced"), F.concat(F.lit("designations from a model ("), F.size("_new").cast("string"), F.lit(" lines): to check"))),
        F.concat(F.lit("model: "), F.substring(model_text(F.col("_comment")), 1, 160)),
    ))
    full = {
        "changed": changed, "lines": F.col("_new"), "parties": F.coalesce("_people", "parties"), "transport": F.concat(_list("transport"), F.col("_facts")),
        "total_packages": F.coalesce("_packs", "total_packages"), "total_gross": F.coalesce("_gross", "total_gross"),
        "goods_source": F.when(F.col("_replaced"), "model reading of the page").otherwise(F.col("goods_source")), "warnings": F.concat(_list("warnings"), said),
    }
    return d.withColumns(full).drop("_replaced", "_new", "_people", "_facts", "_packs", "_gross", *[f"_{c}" for c in given])


def staged_lookup(movements: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """movements (mrn) with key, stage and status. The stages (name, relation of mrn and key) are asked
    in order, a stage for what none before it answered; several keys of one movement answer nothing
    there. A key that several movements claim goes to the first of them. All joins are on mrn, so one
    partitioning of the movements serves every stage."""
    d = movements.select(F.col("mrn"), F.coalesce(F.col("mrn").rlike(MOVEMENT), F.lit(False)).alias("_ok")).distinct()
    for i, (_, relation) in enumerate(stages):
        keys = relation.filter("key IS NOT NULL").groupBy("mrn").agg(F.min("key").alias(f"_k{i}"), (F.min("key") != F.max("key")).alias(f"_m{i}"))
        d = d.join(keys, "mrn", "left")
    only = [F.when(F.col("_ok") & ~F.col(f"_m{i}"), F.col(f"_k{i}")) for i in range(len(stages))]
    stage = F.coalesce(*[F.when(k.isNotNull(), name) for k, (name, _) in zip(only, stages)], F.lit(None))
    many = F.array_max(F.array(*[F.coalesce(F.col(f"_m{i}"), F.lit(False)) for i in range(len(stages))], F.lit(False)))
    d = d.select("mrn", "_ok", F.coalesce(*only, F.lit(None)).alias("key"), stage.alias("stage"), many.alias("_many"))
    owners = d.filter("key IS NOT NULL").groupBy("key").agg(F.min("mrn").alias("_owner"))
    d = d.join(owners, "key", "left")
    status = F.when(~F.col("_ok"), "malformed").when(F.col("_owner") != F.col("mrn"), "key of another movement").when(F.col("key").isNotNull(), "found").when(F.col("_many"), "ambiguous").otherwise("absent")
    d = d.withColumn("status", status)
    return d.select("mrn", F.when(F.col("status") == "found", F.col("key")).alias("key"), F.when(F.col("status") == "found", F.col("stage")).alias("stage"), "status")


def changed_sources(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """The recorded sources (path, sha256) that are gone or no longer what they were."""
    return recorded.join(present.select("path", "sha256"), ["path", "sha256"], "left_anti")


def confirm_by_person(declarations: DataFrame, recorded: DataFrame, present: DataFrame, operator: str) -> DataFrame:
    """declarations (batch, decl_id and the gate's columns) as a person corrected them: what machines
    said of them is reset, the gate runs again, and accepted tells whether the whole batch may go: its
    sources are recorded and unchanged, no movement is repeated, no reason is left."""
    none = F.array().cast("array<string>")
    reset = {"verified": F.lit(True), "model_used": F.lit(False), "blockers": none, "warnings": none, "discrepancy": F.lit(""), "evidence": F.concat(_list("evidence"), F.array(F.lit(f"confirmed by {operator}")))}
    d = gate(declarations.withColumns(reset))
    batches = d.groupBy("batch").agg((F.count("*") != F.count_distinct("mrn")).alias("repeated"), F.bool_or(~F.col("deliverable")).alias("doubt"))
    changed = changed_sources(recorded, present).select("batch").distinct().withColumn("_changed", F.lit(True))
    known = recorded.select("batch").distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("_known").isNull(), "no sources").when(F.col("_changed"), "sources changed").when(F.col("repeated"), "movement repeated").when(F.col("doubt"), "reasons left").otherwise("accepted")
    verdicts = batches.join(known, "batch", "left").join(changed, "batch", "left").select("batch", status.alias("status"))
    return d.join(verdicts, "batch").withColumn("accepted", F.col("status") == "accepted")


def escape_html(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def review_sheets(declarations: DataFrame, sources: DataFrame, batch: str, order: str) -> DataFrame:
    """Per batch what a person needs: form, JSON with sources (path, sha256), the first reasons and the
    declarations as they are, and sheet, the same as a page of HTML."""
    shown = [c for c in declarations.columns if c not in (batch, "reasons")]
    title = F.coalesce(_said(F.col("mrn")), F.lit("movement unknown"))
    section = F.concat(F.lit("<h2>"), escape_html(title), F.lit("</h2><ul>"), F.array_join(F.transform(_list("reasons"), lambda r: F.concat(F.lit("<li>"), escape_html(r), F.lit("</li>"))), ""), F.lit("</ul><pre>"), escape_html(F.to_json(F.struct(*shown))), F.lit("</pre>"))
    one = F.struct(F.col(order).alias("_o"), F.struct("mrn", "reasons").alias("r"), F.struct(*shown).alias("d"), section.alias("s"))
    d = declarations.groupBy(batch).agg(F.array_sort(F.collect_list(one)).alias("_w"))
    s = sources.groupBy(batch).agg(F.array_sort(F.collect_set(F.struct("path", "sha256"))).alias("_s"))
    d = d.join(s, batch, "left").withColumn("_s", F.coalesce("_s", F.array()))
    form = F.to_json(F.struct(F.lit(1).alias("version"), F.col("_s").alias("sources"), F.col("_w.r").alias("reasons"), F.col("_w.d").alias("declarations")))
    files = F.transform("_s", lambda x: F.concat(F.lit("<h2>Source: "), escape_html(x["path"]), F.lit("</h2>")))
    page = F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>To verify</title><h1>To verify: not released</h1>'), F.array_join("_w.s", ""), F.array_join(files, ""))
    return d.select(batch, form.alias("form"), page.alias("sheet"))


def render_checks(pages: DataFrame, words: DataFrame, expected: DataFrame, box: str = "CONTRÔLE") -> DataFrame:
    """Rendered documents (pages: doc_id, page, text, width, height; words: doc_id, page, x0, y0, x1,
    y1; expected: doc_id, text) with errors, accents and ok: two pages at least, the control box on the
    last, every expected text there (white space aside), no word off its page, accents on the first."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s ]+", "")
    d = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("_w"))
    d = d.select("doc_id", F.size("_w").alias("_n"), F.element_at("_w", 1)["text"].alias("_first"), F.element_at("_w", -1)["text"].alias("_last"), bare(F.array_join("_w.text", "")).alias("_all"))
    wanted = expected.filter(bare(F.col("text")) != "").select("doc_id", "text")
    missing = wanted.join(d.select("doc_id", "_all"), "doc_id").filter(~F.contains("_all", bare(F.col("text"))))
    missing = missing.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("text missing: "), "text"))).alias("_missing"))
    off = words.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"]).filter("x0 < 0 OR y0 < 0 OR x1 > width OR y1 > height")
    off = off.groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("_off"))
    d = d.join(missing, "doc_id", "left").join(off, "doc_id", "left")
    general = F.array_compact(F.array(F.when(F.col("_n") < 2, "fewer than two pages"), F.when(~F.contains(F.coalesce("_last", F.lit("")), F.lit(box)), "control box missing on the last page")))
    outside = F.transform(_list("_off"), lambda p: F.concat(F.lit("text off page "), p.cast("string")))
    d = d.withColumns({"errors": F.concat(general, _list("_missing"), outside), "accents": F.coalesce(F.col("_first").rlike("[éèà]"), F.lit(False))})
    return d.select("doc_id", "errors", "accents", (F.col("accents") & (F.size("errors") == 0)).alias("ok"))


def corpus_cases(cases: DataFrame, files: DataFrame, readings: DataFrame, tolerance: float = 0.00001) -> DataFrame:
    """Cases (source, field, expected) against what was read (source, field, value) of the one file of
    that name below the corpus (files: path): fields, concordant, differing names and status a source.
    No file or several of the name: not evaluated. Numbers agree within ``tolerance``."""
    names = files.groupBy(F.regexp_extract("path", r"([^/]+)$", 1).alias("source")).agg(F.count("*").alias("_files"))
    j = cases.join(readings, ["source", "field"], "left").join(names, "source", "left")
    numbers = F.abs(F.col("expected").try_cast("double") - F.col("value").try_cast("double")) < tolerance
    same = F.col("expected").eqNullSafe(F.col("value")) | F.coalesce(numbers, F.lit(False))
    one = F.coalesce(F.first("_files") == 1, F.lit(False))
    out = j.groupBy("source").agg(one.alias("_one"), F.count("*").alias("fields"), F.count_if(same).alias("concordant"), F.array_sort(F.collect_set(F.when(~same, F.col("field")))).alias("differing"))
    status = F.when(~F.col("_one"), "not evaluated").when(F.size("differing") == 0, "concordant").otherwise("differences")
    shown = lambda c: F.when(F.col("_one"), F.col(c))
    return out.select("source", status.alias("status"), shown("fields").alias("fields"), shown("concordant").alias("concordant"), shown("differing").alias("differing"))
