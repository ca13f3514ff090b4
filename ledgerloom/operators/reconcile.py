"""Bringing the sources of one declaration together: codes, courier notes, model readings, names.

Relations carry file_id; a file's declarations, codes and notes are few, so per-file arrays are the
natural unit and every join is on the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import date_fr, digits, page_number

HEADERS = ("TRANSIT_TAD", "TRANSIT_TCH", "TRANSIT_FR", "ANNONCE_CW", "ANNONCE_CW_INV")


def code_check(declarations: DataFrame, codes: DataFrame) -> DataFrame:
    """declarations (file_id, decl_id, mrn, name_mrn) against the optical codes of header pages
    (file_id, family, code): verified, the adopted mrn, and a note. One declaration and one code: the
    code must be the text's or the file name's. Several declarations: each needs its own code."""
    seen = codes.filter(F.col("family").isin(*HEADERS)).groupBy("file_id").agg(F.collect_set("code").alias("_codes"))
    counts = declarations.groupBy("file_id").agg(F.count("*").alias("_n"))
    d = declarations.join(counts, "file_id").join(seen, "file_id", "left").withColumn("_codes", F.coalesce("_codes", F.array().cast("array<string>")))
    k, one = F.size("_codes"), F.get("_codes", F.lit(0))
    pair = (F.col("_n") == 1) & (k == 1)
    agrees = F.coalesce(one == F.col("mrn"), F.lit(False)) | F.coalesce(one == F.col("name_mrn"), F.lit(False))
    own = (F.col("_n") > 1) & F.coalesce(F.array_contains("_codes", F.col("mrn")), F.lit(False))
    note = F.when(pair & agrees & ~F.coalesce(F.col("mrn") == one, F.lit(False)), "corrected from code and file name").when(pair & ~agrees, "code differs from text and file name").when(~pair & ~own & (k > 1), "several codes, none chosen")
    return d.withColumns({"verified": (pair & agrees) | own, "mrn": F.when(pair & agrees, one).otherwise(F.col("mrn")), "note": note, "blocked": F.coalesce(note.isin("code differs from text and file name", "several codes, none chosen"), F.lit(False))}).drop("_codes", "_n")


def _note_fits(w: Column, r: Column, mrn: Column, ref: Column) -> Column:
    m, d = digits(mrn), digits(ref)
    tail = lambda c, n: F.right(c, F.lit(n))
    first = (w != "") & (m != "") & ((tail(w, 9) == tail(m, 9)) | F.contains(mrn, w))
    second = (F.length(w) >= 8) & (d != "") & F.contains(d, tail(w, 8))
    third = (F.length(r) >= 10) & (m != "") & (tail(r, 10) == tail(m, 10))
    return F.coalesce(first, F.lit(False)) | F.coalesce(second, F.lit(False)) | F.coalesce(third, F.lit(False))


def waybill_for(declarations: DataFrame, waybills: DataFrame) -> DataFrame:
    """decl_id with the first courier note (by page) of its file that shares its digits."""
    pairs = declarations.select("file_id", "decl_id", "mrn", "reference").join(waybills.withColumnRenamed("reference", "_r"), "file_id")
    pairs = pairs.filter(_note_fits(digits(F.coalesce("waybill", F.lit(""))), digits(F.coalesce("_r", F.lit(""))), F.coalesce("mrn", F.lit("")), F.coalesce("reference", F.lit(""))))
    best = pairs.groupBy("decl_id").agg(F.min_by(F.struct("page", "waybill", "designation", "net", "gross"), "page").alias("b"))
    return declarations.select("decl_id").join(best, "decl_id", "left").select("decl_id", "b.*")


def merge_readings(readings: DataFrame, declarations: DataFrame) -> DataFrame:
    """Model readings (decl_id, page, type, reference, mrn, awb, printed, pages, lines, parties,
    total_gross, total_packages) to one per declaration: status and, if complete, lines in printed order,
    the first parties, and totals on which all pages agree. One group of pages with lines, one page
    count, and pages 1..n each once; anything else leaves the declaration to a person."""
    d = declarations.select("decl_id", F.col("mrn").alias("_mrn"), "references")
    r = readings.join(d, "decl_id")
    awb = digits(F.coalesce("awb", F.lit("")))
    known = F.exists("references", lambda x: (digits(x) == awb) | ((F.length(digits(x)) > F.length(awb)) & F.contains(digits(x), awb)))
    transit = F.coalesce(F.col("type") == "transit", F.lit(False))
    own = F.coalesce(F.col("mrn") == F.col("_mrn"), F.lit(False))
    ok = (F.coalesce("mrn", F.lit("")) == "") | own
    ok = ok & (transit | own | ((F.length(awb) >= 8) & F.coalesce(known, F.lit(False))))
    ref = F.when(transit, F.col("mrn")).otherwise(F.col("reference"))
    r = r.filter(ok & (F.coalesce(ref, F.lit("")) != "")).withColumns({"_ref": ref, "_p": page_number(F.col("printed")), "_k": page_number(F.col("pages"))})
    agree = lambda c: F.when(F.count_distinct(F.nullif(F.col(c), F.lit(""))) <= 1, F.max(F.nullif(F.col(c), F.lit(""))))
    page = F.struct("_p", "page", "lines", "parties")
    groups = r.groupBy("decl_id", "type", "_ref", F.coalesce("awb", F.lit("")).alias("_awb")).agg(
        F.array_sort(F.collect_list(page)).alias("w"), F.max(F.size("lines") > 0).alias("useful"), F.count("*").alias("n"), F.count("_k").alias("counted"), F.min("_k").alias("lo"), F.max("_k").alias("hi"),
        agree("total_gross").alias("total_gross"), agree("total_packages").alias("total_packages"),
    )
    useful = groups.filter("useful").groupBy("decl_id").agg(F.count("*").alias("groups"), F.first(F.struct(*[c for c in groups.columns if c != "decl_id"])).alias("g"))
    whole = F.transform("g.w", lambda x: x["_p"]) == F.sequence(F.lit(1), F.greatest(F.col("g.hi"), F.lit(1)))
    paged = (F.col("g.counted") == F.col("g.n")) & (F.col("g.lo") == F.col("g.hi"))
    out = declarations.select("decl_id").join(useful, "decl_id", "left")
    status = F.when(F.col("groups").isNull(), "none").when(F.col("groups") > 1, "several documents").when(~F.coalesce(paged, F.lit(False)), "page count missing or contradictory").when(~F.coalesce(whole, F.lit(False)), "pages missing or repeated").otherwise("merged")
    out = out.withColumn("status", status)
    good = lambda c: F.when(F.col("status") == "merged", c)
    parties = F.get(F.filter(F.transform("g.w", lambda x: x["parties"]), lambda p: F.size(p) > 0), F.lit(0))
    return out.select("decl_id", "status", good(F.flatten(F.transform("g.w", lambda x: x["lines"]))).alias("lines"), good(parties).alias("parties"), good(F.col("g.total_gross")).alias("total_gross"), good(F.col("g.total_packages")).alias("total_packages"))


def resolve_identifiers(declarations: DataFrame) -> DataFrame:
    """mrn and dm from the document, else from the file's name (name_mrn, name_dm), with warnings."""
    mrn, name = F.nullif(F.col("mrn"), F.lit("")), F.col("name_mrn")
    taken, differs = mrn.isNull() & name.isNotNull(), mrn != name
    dm = F.nullif(F.col("dm"), F.lit(""))
    notes = F.array_compact(F.array(F.when(differs, "identifier differs from the file name"), F.when(taken, "identifier from the file name"), F.when(F.coalesce(mrn, name).isNull(), "identifier not found"), F.when(dm.isNull() & F.col("name_dm").isNotNull(), "announcement number from the file name"), F.when(F.coalesce(dm, F.col("name_dm")).isNull(), "announcement number missing")))
    return declarations.withColumns({"warnings": notes, "mrn": F.coalesce(mrn, name), "dm": F.coalesce(dm, F.col("name_dm"))})


def batch_guard(declarations: DataFrame, batch: str) -> DataFrame:
    """Per batch: whether it may be produced. A file without declarations or an identifier twice stops
    the whole batch; any reason sends it to a person."""
    m = F.nullif(F.col("mrn"), F.lit(""))
    agg = declarations.groupBy(batch).agg((F.count(m) != F.count_distinct(m)).alias("repeated"), F.bool_or(F.col("decl_id").isNull()).alias("unreadable"), F.bool_or(F.size("reasons") > 0).alias("doubt"))
    status = F.when(F.col("unreadable"), "nothing produced").when(F.col("repeated"), "refused").when(F.coalesce("doubt", F.lit(False)), "to verify").otherwise("ready")
    return agg.select(batch, status.alias("status"))


#: A well-formed movement.
MOVEMENT = r"^\d{2}[A-Z]{2}[A-Z0-9]{14}$"


def waybill_fallback(declarations: DataFrame, waybills: DataFrame, pages: DataFrame) -> DataFrame:
    """waybill_for with its two rules for whole files: with notes of more than one shipment nobody gets
    one (and is told); else a declaration without a match takes the file's first note if the file has
    one national page. pages: file_id, page, family."""
    name = F.coalesce(F.nullif("waybill", F.lit("")), F.nullif("reference", F.lit("")))
    note = F.struct("page", "waybill", "designation", "net", "gross")
    notes = waybills.groupBy("file_id").agg(F.count_distinct(name).alias("_groups"), F.min_by(note, "page").alias("_only"))
    national = pages.groupBy("file_id").agg(F.count_if(F.col("family") == "TRANSIT_TCH").alias("_national"))
    own = waybill_for(declarations, waybills).select(F.col("decl_id").alias("_d"), F.when(F.col("page").isNotNull(), note).alias("_own"))
    d = declarations.join(own, F.col("decl_id") == F.col("_d"), "left").join(notes, "file_id", "left").join(national, "file_id", "left")
    several = F.coalesce(F.col("_groups") > 1, F.lit(False))
    taken = F.when(~several, F.coalesce("_own", F.when(F.col("_national") == 1, F.col("_only"))))
    return d.withColumns({"note": taken, "several_notes": several}).select("file_id", "decl_id", "note.*", "several_notes")


def apply_headers(declarations: DataFrame, headers: DataFrame) -> DataFrame:
    """declarations (mrn, dm, warnings) with the remote header of exactly their movement (mrn, lrn,
    arrival, customs_status, phase, office, movement): it proves the movement, its number replaces the
    announcement's, and its other facts come as ordered labels and values. Without one: a warning. Of
    several headers of one movement the first by key counts."""
    h = headers.filter(F.coalesce("mrn", F.lit("")) != "").groupBy(F.col("mrn").alias("_m")).agg(F.min_by(F.struct("key", "lrn", "arrival", "customs_status", "phase", "office", "movement"), "key").alias("_h"))
    d = declarations.join(h, F.col("mrn") == F.col("_m"), "left")
    some = lambda c: F.nullif(F.col(f"_h.{c}"), F.lit(""))
    arrival = F.trim(F.concat_ws(" ", date_fr(some("arrival")), F.nullif(F.substring(some("arrival"), 12, 5), F.lit(""))))
    facts = {"Date d'arrivée": F.when(some("arrival").isNotNull(), arrival), "Statut douane": some("customs_status"), "Phase": some("phase"), "Bureau de destination": some("office"), "Type de mouvement": F.concat(some("movement"), F.lit(" (arrivée)"))}
    pairs = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("label"), v.alias("value"))) for k, v in facts.items()]))
    found = F.col("_m").isNotNull()
    said = F.when(found, F.when(some("lrn").isNotNull(), F.array_remove("warnings", "announcement number missing")).otherwise(F.col("warnings"))).otherwise(F.col("warnings"))
    last = F.when(found, "header completed").otherwise("no header of this movement")
    return d.withColumns({"verified": found, "evidence": F.col("_h.key"), "dm": F.coalesce(some("lrn"), "dm"), "facts": pairs, "warnings": F.array_append(said, last)}).drop("_m", "_h")


def finalise(declarations: DataFrame) -> DataFrame:
    """declarations (mrn, dm, date, file_date, file, lines, goods_source, incomplete, gap, warnings) with
    what is still missing filled, and confidence: high only with both numbers, a readable line, nothing
    incomplete, no gap and no doubt about the movement. Lines are structs with designation."""
    mrn, dm = F.nullif(F.col("mrn"), F.lit("")), F.nullif(F.col("dm"), F.lit(""))
    shape = F.when(mrn.isNull(), "movement not found: to verify").when(~mrn.rlike(MOVEMENT), "movement malformed: to verify")
    warned = F.array_distinct(F.concat("warnings", F.array_compact(F.array(shape, F.when(dm.isNull(), "announcement number missing")))))
    doubt = F.exists(warned, lambda x: F.contains(x, F.lit("movement")) & F.contains(x, F.lit("to verify")))
    readable = F.exists("lines", lambda x: F.coalesce(F.trim(x["designation"]), F.lit("")) != "")
    high = mrn.isNotNull() & dm.isNotNull() & F.coalesce(readable, F.lit(False)) & ~F.coalesce("incomplete", F.lit(False)) & ~F.coalesce("gap", F.lit(False)) & ~doubt
    return declarations.withColumns({"date": F.coalesce("date", date_fr(F.col("file_date"))), "file": F.coalesce(F.nullif("file", F.lit("")), mrn), "goods_source": F.coalesce(F.nullif("goods_source", F.lit("")), F.lit("transit document")), "confidence": F.when(high, "high").otherwise("low"), "warnings": warned})
