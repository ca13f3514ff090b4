"""Page classification as one projection: no function leaves the generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

#: White space that Java's patterns do not take for it.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u0085\u001c\u001d\u001e\u001f"


def _spaced(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def _sum(text: Column, table: list[tuple[str, int]]) -> Column:
    out = F.lit(0)
    for pattern, weight in table:
        out = out + F.when(_has(text, pattern), weight).otherwise(0)
    return out


def families() -> list[str]:
    return list(dict.fromkeys(f for f, _, _ in rules.TITLES))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body and later projections refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def verdict(text: Column) -> Column:
    """struct(family, score_pos, score_neg) of a page's text. A family's title score is its best
    title's; titles and, beside one, anchors add up; an ordered list of rules decides."""
    raw = _spaced(text)
    low = F.lower(raw)
    best = {f: F.greatest(F.lit(0), F.lit(0), *[F.when(_has(low, p), w).otherwise(0) for g, p, w in rules.TITLES if g == f]) for f in families()}
    scores = F.struct(
        *[c.alias(f) for f, c in best.items()], *[_sum(low, t).alias(k) for k, t in rules.AGAINST.items()], _sum(low, rules.ANCHORS).alias("anchors"),
        F.when(_has(raw, rules.TYPE_BOX), rules.TYPE_WEIGHT).otherwise(0).alias("box"), (_has(low, rules.LIST_TOTALS) & _has(low, rules.LIST_HEADER)).alias("first_page"), raw.rlike(r"^\s*$").alias("blank"),
    )

    def total(s: Column) -> Column:
        titles = sum((s[f] for f in best), F.lit(0))
        return F.struct(s.alias("s"), (titles + F.when(titles > 0, s["anchors"]).otherwise(0) + s["box"]).alias("pos"))

    def decide(x: Column) -> Column:
        s, pos = x["s"], x["pos"]
        family = F.when(s["blank"], "INDETERMINE").when(s["export"] >= 7, "EXPORT")
        family = family.when((s["TRANSIT_LISTE"] > 0) & s["first_page"], "TRANSIT_TAD").when(s["TRANSIT_LISTE"] > 0, "TRANSIT_LISTE")
        for f in ("ANNONCE_CW_LISTE", "ANNONCE_CW_INV", "ANNONCE_CW"):
            family = family.when(s[f] > 0, f)
        family = family.when((s["cover"] >= 4) & (pos < 6), "ENVELOPPE")
        for f in ("TRANSIT_TCH", "TRANSIT_FR", "TRANSIT_TAD"):
            family = family.when(s[f] >= 6, f)
        family = family.when(pos >= 6, "TRANSIT_TAD").when(s["annex"] >= 4, "ANNEXE").otherwise("INDETERMINE")
        return F.struct(family.alias("family"), pos.alias("pos"), s.alias("s"))

    def score(x: Column) -> Column:
        s, f = x["s"], x["family"]
        neg = F.when(s["blank"], 0).when(f == "EXPORT", s["export"]).when(f == "ENVELOPPE", s["cover"]).when(f == "ANNEXE", s["annex"]).otherwise(s["export"] + s["annex"])
        return F.struct(f.alias("family"), F.when(s["blank"], 0).otherwise(x["pos"]).alias("score_pos"), neg.alias("score_neg"))

    return _let(_let(_let(scores, total), decide), score)


def classify(pages: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """pages with family, score_pos and score_neg."""
    df = pages.withColumn("_v", verdict(F.col(text_col)))
    return df.withColumns({f"{prefix}{c}": F.col(f"_v.{c}") for c in ("family", "score_pos", "score_neg")}).drop("_v")


def rank(family: Column) -> Column:
    out = F.lit(3)
    for f, r in rules.RANK.items():
        out = F.when(family == f, r).otherwise(out)
    return out


def with_fallback(pages: DataFrame, read_again, short: int = 40) -> DataFrame:
    """Pages whose text is short or undecided are read again by ``read_again`` (a DataFrame function
    that adds second_text); the second verdict holds if it ranks or scores higher. The costly reader
    only ever sees the pages that need it."""
    cheap = classify(pages)
    need = (F.length(F.regexp_replace(_spaced(F.col("text")), r"^\s+|\s+$", "")) < short) | (F.col("family") == "INDETERMINE")
    again = classify(read_again(cheap.filter(need)), "second_text", "b_")
    wins = (rank(F.col("b_family")) > rank(F.col("family"))) | (F.col("b_score_pos") > F.col("score_pos"))
    pick = {c: F.when(wins, F.col(f"b_{c}")).otherwise(F.col(c)) for c in ("family", "score_pos", "score_neg")}
    again = again.withColumns(pick | {"source": F.when(wins, "second").otherwise("text")}).select(*cheap.columns, "source")
    return cheap.filter(~need).withColumn("source", F.lit("text")).unionByName(again)


def richness(text: Column) -> Column:
    """How many different goods-table words a page has."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rules.RICH), F.lit(1))))


def useful(family: Column) -> Column:
    return ~family.isin(*rules.OFF_TOPIC)


def transport(family: Column) -> Column:
    return family.startswith("TRANSIT") | family.startswith("ANNONCE_CW")


def four_classes(text: Column) -> Column:
    """struct(class, kind, score_pos, score_neg) by the older finder: titles of exports first, then
    transit by its marks (fewer do beside a movement), then other papers."""
    raw = _spaced(text)
    low = F.lower(raw)
    scores = F.struct(
        (_sum(low, rules.FOUR_FOR) + F.when(_has(low, rules.FOUR_TYPE), rules.FOUR_TYPE_WEIGHT).otherwise(0)).alias("pos"), _sum(low, rules.FOUR_EXPORT).alias("export"), _sum(low, rules.FOUR_OTHER).alias("other"),
        _has(raw, rules.FOUR_MOVEMENT).alias("movement"), _has(low, rules.FOUR_SWISS).alias("swiss"),
    )

    def decide(s: Column) -> Column:
        transit = (s["pos"] >= 6) | ((s["pos"] >= 4) & s["movement"])
        name = F.when(s["export"] >= 7, "EXPORT").when(transit, "TRANSIT").when(s["other"] >= 4, "AUTRE").otherwise("INDETERMINE")
        kind = F.when((s["export"] < 7) & transit, F.when(s["swiss"], "TCH").otherwise("T1/T2"))
        neg = F.when((s["export"] < 7) & ~transit & (s["other"] >= 4), s["other"]).otherwise(s["export"] + s["other"])
        return F.struct(name.alias("class"), kind.alias("kind"), s["pos"].alias("score_pos"), neg.alias("score_neg"))

    return _let(scores, decide)
