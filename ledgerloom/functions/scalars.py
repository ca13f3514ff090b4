"""Scalar functions as Column expressions: numbers, dates and identifiers as forms write them.

Missing is null throughout; sentinels are written only by the last projection of a sink."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that stand for digits in degraded numeric fields.
DIGIT_REPAIR = {"O": "0", "o": "0", "I": "1", "l": "1", "S": "5", "B": "8"}
#: Characters confused with each other in identifiers, each class by its first one.
CONFUSED = ("0OQ", "1IL|", "2Z", "5S", "6G", "8B", "4A", "7T")
#: Letters read in place of the two digits after the country of a Swiss identifier.
SWISS_DIGITS = {"O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "|": "1", "Z": "2", "R": "2", "T": "7", "S": "5", "B": "8", "G": "6", "A": "4", "E": "3", "H": "4", "U": "0", "J": "1"}
#: Issuing countries of movement identifiers.
COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GR HR HU IE IS IT LT LU LV MT NL NO PL PT RO SE SI SK TR GB".split()
#: Beginnings of texts that name no goods.
NOT_GOODS = r"(?i)^(?:cust|shpt|gross|net|total|value|awb|page|dhl)\b"
#: A form's own words and marks, never data.
NOISE = (
    r"(?i)^\W*$|^\[?\d{1,2}\s?\d{1,2}\]?$|^ID\s*:?$|^r[Dd]\s*:?$|^t[Dd]\s*:?"
    r"|^(?:Referente|Speditore|Destinatario|Titolare|Rappresentante|Trasportatore"
    r"|Formulari|Formulaires|BCP|Sicurezza|UCR|TIR|LRN|Numero|Tipo|UNDG|Codice"
    r"|Spese|Massa|Unitä|Unita|Documento|Documenti|Riferimento|Informazioni"
    r"|Attore|Mezzo|ELENCO|Descrizione|Descn|Pag|Totale|Tolal|Toiale|Des|MARIN"
    r"|CUS|Dich|dich|merci|articolo|No\.?|Commodity|Grossmass|Netmass|Consignor"
    r"|Consignee|Holder|Carrier|Previous|Supporting|Additional|Guarantee|Seal"
    r"|Dossier|Nbre|Declarant)\b.*$"
    r"|^[iIl|\[\]\.\,\-\s]{3,}$|^[0-9OISB]{2}[A-Z]{2}[0-9A-Z]{12,}$"
)
#: What a model writes for nothing.
MODEL_NOTHING = ["", "0", "0.0", "0,00", "-", "n/a", "null", "none", "aucun", "aucune"]


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: lambdas would compute it anew for every item and mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def parse_number(c: Column) -> Column:
    """``2 126,0``, ``1.234,5``, ``0,800 kg`` to double; with both marks the dot groups thousands."""
    x = F.regexp_replace(F.regexp_replace(F.lower(c), r"\s*(kg|tonnes?)\b\.?", ""), "[\\s  ]", "")
    both = F.contains(x, F.lit(",")) & F.contains(x, F.lit("."))
    x = F.replace(F.when(both, F.replace(x, F.lit("."), F.lit(""))).otherwise(x), F.lit(","), F.lit("."))
    return F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), x.try_cast("double"))


def format_kg(c: Column) -> Column:
    return F.concat(F.translate(F.format_number(c.cast("double"), 2), ",.", " ,"), F.lit(" kg"))


def clean_text(c: Column) -> Column:
    """One space between words and after marks, none before marks, edges trimmed of both."""
    x = F.regexp_replace(c, r"\s+", " ")
    x = F.regexp_replace(x, r" ?([.,;:]) ?", "$1 ")
    return F.btrim(x, F.lit(" .;:-"))


def clean_digits(c: Column) -> Column:
    """Marks between digits lose their spaces; thousands groups close up."""
    x = F.regexp_replace(c, r"(?<=\d)\s*([.:/])\s*(?=\d)", "$1")
    x = F.regexp_replace(x, r"(?<=\d) (?=\d{3}(?!\d))", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _translate(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def repair_digits(c: Column) -> Column:
    return F.regexp_replace(_translate(c, DIGIT_REPAIR), "[  ]", "")


def repair_identifier(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[  -]", ""))


def confusion_key(c: Column) -> Column:
    table = {x: group[0] for group in CONFUSED for x in group[1:]}
    return _translate(F.upper(c), table)


def normalise_movement(c: Column) -> Column:
    """Letters and digits only, upper case; a Swiss identifier's two office digits are repaired."""
    x = F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    office = F.substring(x, 5, 2)
    swiss = (F.substring(x, 3, 2) == "CH") & ~office.rlike(r"^\d\d$") & (F.length(x) >= 8)
    return F.when(swiss, F.concat(F.substring(x, 1, 4), _translate(office, SWISS_DIGITS), F.substr(x, F.lit(7)))).otherwise(x)


def plausible_movement(c: Column) -> Column:
    """An 18-character movement identifier: year in the twenties, known country, and digits as the
    country writes them."""
    runs = F.transform(F.regexp_extract_all(F.substr(c, F.lit(5)), F.lit("([A-Z]+)"), F.lit(1)), F.length)
    shape = c.rlike("^2[0-9][A-Z]{2}[A-Z0-9]{14}$") & F.substring(c, 3, 2).isin(COUNTRIES)
    many = F.length(digits(c)) * 2 >= F.length(c)
    return F.when(F.substring(c, 3, 2) == "CH", shape & F.substring(c, 5, 2).rlike(r"^\d\d$")).otherwise(shape & many & (F.coalesce(F.array_max(runs), F.lit(0)) <= 3))


def movement_candidates(text: Column) -> Column:
    """Every plausible identifier in any window of the text's letters and digits, first seen first."""
    x = F.upper(F.regexp_replace(text, "[^0-9A-Za-z]", ""))
    # repair leaves the year and the country as they are; the look-ahead takes windows that overlap
    windows = F.transform(F.regexp_extract_all(x, F.lit("(?=(2[0-9][A-Z]{2}[0-9A-Z]{14}))"), F.lit(1)), normalise_movement)
    return F.array_distinct(F.filter(windows, plausible_movement))


def bounded_distance(a: Column, b: Column, most: int = 4) -> Column:
    """Edit distance; 99 for an empty side or lengths further apart than ``most``."""
    far = (a == "") | (b == "") | (F.abs(F.length(a) - F.length(b)) > most)
    return F.when(far, 99).otherwise(F.levenshtein(a, b))


def confusion_distance(a: Column, b: Column) -> Column:
    return bounded_distance(confusion_key(a), confusion_key(b))


def choose_movement(candidates: Column, reference: Column) -> Column:
    """The candidate for a known reference: of those within 4 confusion-neutral edits (of all, if none
    is) the nearest if it is within 3, else, or without a reference, the one with most digits; the
    earlier on ties. Null without candidates."""
    ref = F.coalesce(reference, F.lit(""))
    rated = F.transform(candidates, lambda c, i: F.struct(confusion_distance(c, ref).alias("d"), i.alias("i"), c.alias("c")))

    def pick(rows: Column) -> Column:
        near = F.filter(rows, lambda x: x["d"] <= 4)
        known = F.when((ref != "") & (F.size(near) > 0), near).otherwise(rows)
        best = F.array_min(known)
        most = F.array_max(F.transform(known, lambda x: F.struct(F.length(digits(x["c"])).alias("n"), (-x["i"]).alias("i"), x["c"].alias("c"))))
        return F.when((ref != "") & (best["d"] <= 3), best["c"]).otherwise(most["c"])

    return F.get(F.transform(F.array(rated), pick), F.lit(0))


def plausible_designation(c: Column) -> Column:
    """Whether a text can name goods: six characters with a word of four letters, neither a number nor
    a label."""
    v = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return (F.length(v) >= 6) & v.rlike("[A-Za-z]{4,}") & ~v.rlike(r"^[\d\s.,]+$") & ~v.rlike(NOT_GOODS)


def is_value(c: Column) -> Column:
    """Whether a cell holds data rather than a form's own words."""
    return F.coalesce(~c.rlike(NOISE), F.lit(False))


def date_fr(c: Column) -> Column:
    """ISO or day-first dates at the start to dd.mm.yyyy; other text unchanged."""
    iso = F.regexp_replace(F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2})", 1), r"(\d{4})-(\d{2})-(\d{2})", "$3.$2.$1")
    day = F.regexp_replace(F.regexp_extract(c, r"^\s*(\d{2}[./]\d{2}[./]\d{4})", 1), "/", ".")
    return F.coalesce(F.nullif(iso, F.lit("")), F.nullif(day, F.lit("")), c)


def parse_packages(c: Column) -> Column:
    """``3 PX`` or ``4 colis`` to 3 or 4; anything else beside the count is ambiguous and null."""
    return F.regexp_extract(c, r"^\s*(\d+)\s*(?:colis|[A-Z]{2,3})?\s*$", 1).try_cast("int")


def slug(c: Column) -> Column:
    x = F.btrim(F.regexp_replace(c, r"[^0-9A-Za-z._-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("NCT"))


def fold_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def parse_announcement(c: Column) -> Column:
    """``DM PMP 20260012`` to struct(year, sequence, prefixed), null if malformed."""
    shape = r"^\s*(?:DM\s+)?(PMP\s+)?(20\d{2})(\d{4})\s*$"
    year = F.regexp_extract(c, shape, 2).try_cast("int")
    return F.when(year.isNotNull(), F.struct(year.alias("year"), F.regexp_extract(c, shape, 3).try_cast("int").alias("sequence"), (F.regexp_extract(c, shape, 1) != "").alias("prefixed")))


def identity(refs: Column) -> Column:
    """The sorted, joined key of a set of references; null unless there are 1 to 100, all well-formed
    and distinct."""
    clean = F.array_sort(F.transform(refs, lambda r: F.upper(F.trim(r))))
    good = F.size(clean).between(1, 100) & F.forall(clean, lambda r: r.rlike("^[0-9]{2}[A-Z]{2}[A-Z0-9]{14}$")) & (F.size(F.array_distinct(clean)) == F.size(clean))
    return F.when(good, F.array_join(clean, "|"))


def model_text(c: Column) -> Column:
    """A model's reading; what it writes for nothing is null (a person's zero is kept elsewhere)."""
    return F.when(~F.lower(F.trim(c)).isin(MODEL_NOTHING), F.trim(c))


def model_mass(c: Column) -> Column:
    return format_kg(parse_number(model_text(c)))


def page_number(c: Column) -> Column:
    """A whole number above zero, whether text or number; a boolean is none."""
    n = F.when(c.cast("string").rlike(r"^\s*\d+\s*$"), c.cast("string").try_cast("int"))
    return F.when(n > 0, n)


def package_cell(c: Column) -> Column:
    """``PK 3``, ``PK-3`` or ``PK,3`` to ``3 PK`` for the known kinds of package; at most three digits."""
    shape = r"\b(PK|PC|PX|PLT|CTN|CAR|COL)\s*[,\s-]\s*(\d{1,3})\b"
    return F.nullif(F.concat_ws(" ", found(c, shape, 2), found(c, shape, 1)), F.lit(""))


def after_label(line: Column, label: str) -> Column:
    """What follows a label (the whole line, if it is not there), box numbers skipped."""
    rest = F.regexp_replace(F.regexp_replace(line, rf"(?s)^.*?(?i:{label})", ""), r"^[\s\[\]\d]{0,12}", "")
    return F.nullif(clean_text(rest), F.lit(""))


def year_in_zurich(ts: Column) -> Column:
    return F.year(F.from_utc_timestamp(ts, "Europe/Zurich"))


def json_soft(c: Column) -> Column:
    """The text as a variant, or else its outermost braces."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0)))


def clean_announcement(c: Column) -> Column:
    """An announcement number as scans show it: tidied, no colon between digits, ``PMP n`` where it is one."""
    x = F.regexp_replace(clean_digits(clean_text(c)), r"(?<=\d)\s*:\s*(?=\d)", "")
    number = found(F.replace(x, F.lit(" "), F.lit("")), r"(?i)\bPMP[\s_\-]?(\d{4,})")
    return F.coalesce(F.concat(F.lit("PMP "), number), x)


def transport_label(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The first label whose pattern matches; null if none does."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(F.lower(c).rlike(pattern), label).otherwise(out)
    return out


def json_balanced(c: Column) -> Column:
    """The first balanced object of an answer as a variant, fences of code aside; braces are counted
    within strings too. A fold over braces and what lies between, so it keeps counts, not texts."""
    x = F.regexp_replace(F.trim(c), r"(?m)^```(?:json)?|```$", "")
    x = F.regexp_extract(x, r"(?s)\{.*", 0)
    parts = F.regexp_extract_all(x, F.lit(r"[{}]|[^{}]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))

    def step(s: Column, p: Column) -> Column:
        depth = s["depth"] + F.when(p == "{", 1).when(p == "}", -1).otherwise(0)
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), (s["length"] + F.length(p)).alias("length"), (depth == 0).alias("done")))

    end = F.aggregate(parts, start, step)
    return F.when(end["done"], F.try_parse_json(F.substr(x, F.lit(1), end["length"])))


def _bare(text: str) -> str:
    letters = (x for x in unicodedata.normalize("NFD", text) if unicodedata.category(x) != "Mn")
    return " ".join("".join(letters).casefold().split())


def accent_key(c: Column) -> Column:
    """Text without accents and case, one space between words, as a value. Letters are decomposed in
    Arrow batches, as no built-in function does; to compare only, the collation UNICODE_CI_AI is cheaper."""

    def key(texts: pd.Series) -> pd.Series:
        return texts.map(_bare, na_action="ignore")

    key.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(key, "string")(c)
