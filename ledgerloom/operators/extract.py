"""Typed facts from page texts and goods lines from page cells, as projections and block aggregates.

Every field is one nullable expression, so a query that asks for three fields computes three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from .layout import PAGE, blocks

#: Labels that end an address.
ADDRESS_ENDS = r"(?iu)^(?:bureau|num[ée]ro|d[ée]lai|total|ce document|r[ée6]f[ée6]rence|gdrn|d[ée6]claration|exp[ée6]diteur|destinataire)\b"
#: A label alone on its line.
LABEL_ONLY = r"(?u)^[A-ZÀ-Ý][a-zà-ÿ]+\s*:?\s*$"
#: Fields of national transit declarations.
NATIONAL = {
    "mrn": r"(?iu)GDRN[ \t]*:?[ \t]*([0-9A-Z][0-9A-Z \t]{9,40})",
    "date": r"(?iu)D[ée6]claration\s+accept[ée]e\s*:?\s*([\d.]{8,10}(?:,\s*[\d:]{5})?)",
    "reference": r"(?iu)R[ée6]f[ée6]rence\s*:?\s*([^\n]+)",
    "packages": r"(?iu)Total\s+emballages\s*:?\s*([\dOIl]+)",
    "gross": r"(?iu)Total\s+masse\s+brute\s*\(?kg\)?\s*:?\s*([\d.,OI]+)",
    "office": r"(?iu)Bureau\s+de\s+destination\s*:?\s*([^\n]+)",
}
#: Fields of courier notes, the alternatives of each in order.
WAYBILL = {
    "designation": [r"(?i)sh[ia]?[pob]?(?:ment|mont|menl)\s+con\S{0,8}(?:nt|nl)\s*:?\s*([^\n]+)", r"(?i)description\s+quantity\s+unit\s+price[^\n]*\n(.*)", r"(?i)shipment\s+content\s*:?\s*([^\n]+)"],
    "net": [r"(?i)net\s*w?eight\s*:?\s*([\d.,]+)"],
    "gross": [r"(?i)gro\S*\s*w?eight\s*:?\s*([\d.,]+)", r"(?i)(?:gr[oö]\S*|gross)\s+weight\s+([\d.,]+)\s*KG"],
    "packages": [r"(?i)(\d+)\s*box(?:es)?\s*[\dx]+cm"],
    "waybill": [r"WAYB[Il|]LL\s*([\d ]{8,})", r"(?i)AWB\s*No\.?\s*([\d ]{8,})"],
    "value": [r"(?i)customs\s+value\s*:?\s*([\d.,]+\s*[A-Z]{3})"],
}
#: Fields of arrival announcements.
ARRIVAL = {
    "number": r"(?i)No\s+annonce\s+DA\s+([^\n]+)",
    "reference": r"(?iu)R[eé]f[eé]r[ea]nce\s+([^\n]+)",
    "date": r"(?i)Date\s+acceptation\s+([\d.\s]{8,14})",
    "time": r"(?i)Temps\s+acceptation\s+([\d:\s]{5,10})",
    "declarant": r"(?iu)No\s+de\s+d[eé]clarant\s+([^\n]+)",
    "place": r"(?iu)Lieu\s+agr[eé][^\n]*\n?[^\n]*?(\d{8,})",
}
#: Fields of inventory reports.
INVENTORY = {
    "packages": r"(?i)(?:Tobi?t?l?\s*packag\w*|Total\s+packag\w*)\s*([\dOIl]{1,4})",
    "gross": r"(?i)(?:Total\s+gro\S*m(?:ass)?\s*\(?\s*Kg\s*\)?|gross\s*mass\s*\(Kg\))\s*([\d.,]{1,12})",
    "lines": r"(?i)f?otal\s+it[eo]ms?\s*([\dOIl]{1,4})",
}


def _tidy(c: Column) -> Column:
    return s.clean_digits(s.clean_text(c))


def address(text: Column, label: str, most: int = 3) -> Column:
    """The lines from a label on: what follows it on its line and up to ``most`` lines after, ending
    before an empty line or another label."""
    lines = F.split(text, r"\r?\n")
    marked = F.transform(lines, lambda x, i: F.struct(F.when(x.rlike(f"(?iu){label}"), i).alias("i")))
    at = F.array_min(F.transform(marked, lambda x: x["i"]))
    part = F.slice(lines, at + 1, most + 1)
    clean = F.transform(part, lambda x, i: s.clean_text(F.when(i == 0, F.regexp_replace(x, f"(?iu){label}", "")).otherwise(x)))
    ends = F.transform(clean, lambda x, i: F.when((i > 0) & ((x == "") | x.rlike(LABEL_ONLY) | x.rlike(ADDRESS_ENDS)), i))
    kept = F.slice(clean, F.lit(1), F.coalesce(F.array_min(ends), F.size(clean)))
    return F.when(at.isNotNull(), F.filter(kept, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def national(text: Column) -> Column:
    f = {k: s.found(text, p) for k, p in NATIONAL.items()}
    return F.struct(
        s.normalise_movement(f["mrn"]).alias("mrn"), *[_tidy(f[k]).alias(k) for k in ("date", "reference", "office")],
        s.repair_digits(f["packages"]).alias("packages"), F.replace(s.repair_digits(f["gross"]), F.lit(","), F.lit(".")).alias("gross"),
        address(text, r"Exp[ée6]diteur\s*:?").alias("sender"), address(text, r"Destinataire\s*:?").alias("receiver"),
    )


def waybill(text: Column) -> Column:
    first, table, plain = (s.found(text, p) for p in WAYBILL["designation"])
    first = s.blank_to_null(s.clean_text(F.regexp_replace(first, r"(?i)\bpackages?\b|Dackaoes|Dacka\S*", " ")))
    table = s.clean_text(F.regexp_replace(table, r"\d[\d\s,.]*$", ""))
    table = F.when((F.length(table) > 8) & table.rlike("[A-Za-z]{4,}"), table)
    either = lambda k: F.coalesce(*[s.found(text, p) for p in WAYBILL[k]])
    return F.struct(
        F.coalesce(first, table, s.clean_text(plain)).alias("designation"), either("net").alias("net"), either("gross").alias("gross"), either("packages").alias("packages"),
        s.digits(either("waybill")).alias("waybill"), s.clean_text(either("value")).alias("value"),
    )


def arrival(text: Column) -> Column:
    pattern = r"(?is)No\.?\s*position\s+(\d+)\s*\n\s*MRN\s+([0-9A-Z ]{12,26})"
    positions = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("no"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), s.normalise_movement).alias("mrn"))
    return F.struct(*[_tidy(s.found(text, p)).alias(k) for k, p in ARRIVAL.items()], positions.alias("positions"), s.clean_text(s.found(text, r"Dossier\s*:?\s*([^\n]+)")).alias("file"))


def inventory(text: Column) -> Column:
    flat = F.regexp_replace(text, r"[ \x{a0}\x{fe}\x{ff}\x{0c}]+", " ")
    f = {k: s.found(flat, p) for k, p in INVENTORY.items()}
    return F.struct(
        F.get(s.movement_candidates(text), F.lit(0)).alias("mrn"), s.repair_digits(f["packages"]).alias("packages"), f["gross"].alias("gross"), s.repair_digits(f["lines"]).alias("lines"),
        F.regexp_extract_all(flat, F.lit(r"\b(\d{1,4}\.\d{3,6})\b"), F.lit(1)).alias("page_masses"),
    )


def from_file_name(name: Column) -> Column:
    """Identifiers in a file's name: movement, announcement, remote key."""
    stem = F.upper(F.regexp_replace(name, r"(?i)\.pdf$", ""))
    mrn = s.found(stem, r"(?<![0-9A-Z])(\d{2}[A-Z]{2}[0-9A-Z]{14})(?![0-9A-Z])")
    pmp = F.concat(F.lit("DM PMP "), s.found(stem, r"\bPMP[ _]?(\d{4,8})\b"))
    dm = F.concat(F.lit("DM "), s.found(stem, r"\bDM[ _]+(?:[A-Z]{2}[ _]+)?(\d{3,8})\b"))
    return F.struct(mrn.alias("mrn"), F.coalesce(pmp, dm).alias("dm"), s.found(stem, r"(NCT\d{8})").alias("remote_key"))


def remote_header(raw: Column) -> Column:
    """A remote answer as JSON text, its keys compared without case and marks, nested codes unwrapped."""
    m = F.transform_keys(F.from_json(raw, "map<string,string>"), lambda k, _: s.fold_key(k))
    code = lambda c: F.coalesce(F.get_json_object(c, "$.code"), c)
    pick = lambda *ks: F.coalesce(*[code(F.try_element_at(m, F.lit(k))) for k in ks])
    return F.struct(pick("mrn", "entrynumber").alias("mrn"), pick("customsstatus").alias("customs_status"), pick("messagestatus", "msgstatus").alias("msg_status"), pick("movementtype", "movement").alias("movement"), pick("arrivaldate", "arrival").alias("arrival"), pick("lrn").alias("lrn"))


def list_lines(cells: DataFrame, pages: DataFrame, labels: str) -> DataFrame:
    """Goods lines of standard list pages. cells: as split_cells leaves them; pages: file_id, page,
    width, height; labels: pattern of the frame's labels, below whose last line goods start. A cell
    ``n;KIND;`` at the left opens a line; first code and masses win, the last previous document does."""
    d = cells.join(pages, PAGE)
    head = d.groupBy(*PAGE).agg(F.max(F.when(F.col("text").rlike(labels), F.col("y"))).alias("_head"))
    d = d.join(head, PAGE).filter(F.col("y") >= F.coalesce(F.col("_head") + 2, 0.28 * F.col("height")))
    x, w = F.col("x"), F.col("width")
    opens = (x < 0.30 * w) & F.trim("text").rlike(r"^\d{1,3}\s*;\s*[A-Z]{2}\s*;")
    d = blocks(d, PAGE, ["y", "line_no", "x"], opens).filter("block > 0").withColumn("t", s.clean_text(F.col("text"))).withColumn("o", F.struct("y", "line_no", "x"))
    squeezed = F.replace(F.col("t"), F.lit(" "), F.lit(""))
    middle, right = x.between(0.45 * w, 0.75 * w) & (x < 0.75 * w), x >= 0.75 * w
    code, doc = squeezed.rlike(r"^\d{6,10}$"), F.col("t").rlike(r"^\d+\s*;\s*(?:EXPO|N\d{3})\s*;")
    words = (F.length("t") > 15) & F.col("t").rlike("[A-Za-z]{4,}") & ~F.col("t").rlike(labels)
    mass = right & squeezed.rlike(r"^[\d.,oO]{1,12}$")
    masses = F.array_sort(F.collect_list(F.when(mass, F.struct("o", s.format_kg(s.parse_number(s.repair_digits(squeezed))).alias("kg")))))
    names = F.array_sort(F.collect_list(F.when(middle & words & ~code & ~doc, F.struct("o", "t"))))
    expo = F.contains(squeezed, F.lit(";EXPO;"))
    a = d.groupBy(*PAGE, F.col("block").alias("no")).agg(
        F.min_by(F.regexp_replace(F.trim("text"), r"^(\d{1,3})\s*;\s*([A-Z]{2}).*$", "$1 $2"), F.when(opens, F.col("o"))).alias("packages"),
        F.array_join(F.transform(names, lambda v: v["t"]), " ").alias("designation"),
        F.min_by(squeezed, F.when(middle & code, F.col("o"))).alias("code"),
        F.get(masses, F.lit(0))["kg"].alias("gross"), F.get(masses, F.lit(1))["kg"].alias("net"),
        F.max_by("t", F.when(middle & doc & expo, F.col("o"))).alias("prev_doc"), F.max_by("t", F.when(middle & doc & ~expo, F.col("o"))).alias("supporting"),
    )
    cut = r"(?i)\b(consignor|consignee|holder|carrier|previous|supporting|additional|document|guarantee)\b.*$"
    a = a.withColumn("designation", s.blank_to_null(s.clean_text(F.regexp_replace("designation", cut, ""))))
    return a.filter("designation IS NOT NULL OR code IS NOT NULL OR gross IS NOT NULL")


def form_lines(words: DataFrame, pages: DataFrame, labels: str) -> DataFrame:
    """Goods lines of remote-form pages, from words with line_no: a line with a number at the left and
    a description at the right opens one; masses keep their places even when unreadable."""
    d = words.join(pages, PAGE)
    x, w = F.col("x0"), F.col("width")
    item = F.struct("x0", "text")
    joined = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, item))), lambda v: v["text"]), " ")
    cell = r"^[0-9OoIiLlSsTt]+[.,][0-9OoIiLlSsTt]{3,6}$"
    lines = d.groupBy(*PAGE, "line_no").agg(
        F.min_by("text", F.when((x < 0.15 * w) & F.col("text").rlike(r"^\d{1,3}$"), x)).alias("no"), joined(x >= 0.52 * w).alias("right"), joined((x >= 0.28 * w) & (x < 0.52 * w)).alias("packing"),
        F.array_sort(F.collect_list(F.when((x >= 0.84 * w) & F.col("text").rlike(cell), F.struct("x0", F.col("text").alias("t"))))).alias("masses"), F.min("yc").alias("y"),
    )
    opens = F.col("no").isNotNull() & F.col("right").rlike("(?u)[A-Za-zÀ-ÿ]{4,}") & ~F.col("right").rlike(labels)
    lines = blocks(lines, PAGE, ["y", "line_no"], opens).withColumn("opens", opens).filter("block > 0")
    head = lambda c: F.min_by(c, F.when(F.col("opens"), F.col("line_no")))
    later = ~F.col("opens")
    masses = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(later, F.struct("y", "line_no", "masses")))), lambda v: v["masses"]))
    read = lambda v: F.when(F.translate(v, "OoIilL", "001111").rlike(r"^\d+[.,]\d+$"), s.format_kg(s.parse_number(F.translate(v, "OoIilL", "001111"))))
    note = lambda p: F.min_by(s.after_label(F.col("right"), p), F.when(later & F.col("right").rlike(p), F.col("line_no")))
    a = lines.groupBy(*PAGE, "block").agg(
        head(F.col("no")).alias("no"), s.clean_text(head(F.col("right"))).alias("designation"), s.package_cell(F.regexp_replace(head(F.col("packing")), ",", " ")).alias("packages"),
        F.replace(s.found(head(F.col("packing")), r"\b(?:PK|PC|PX|PLT|CTN|CAR|COL)\s*,\s*\d+\s*,\s*([0-9 ]+)"), F.lit(" "), F.lit("")).alias("marks"), masses.alias("_m"),
        note(r"(?i)previous\s+document").alias("prev_doc"), note(r"(?i)supporting\s+document").alias("supporting"),
    )
    return a.withColumns({"gross": read(F.get("_m", F.lit(0))["t"]), "net": read(F.get("_m", F.lit(1))["t"])}).drop("_m", "block")
