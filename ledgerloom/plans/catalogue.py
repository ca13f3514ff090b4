"""The registered queries: each operator on the driver's tables, with the same result as SQL.

Results are scalars (arrays are joined to strings) and every column is named on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, scalars
from ..operators import aggregates, announce, classify, gate, joins, layout, registry
from ..session import table
from ..streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Page texts made from orders: a phrase, a second one and a remark by the key's remainders.
_FIRST = ["Document d'accompagnement transit", "Liste d'articles", "Commercial invoice 12", "", "Annonce arrivage", "EU export declaration", "Type de déclaration T1", "Transit list of items", "nombre d'enregistrements 4", "Bureau de destination", "plain note"]
_SECOND = ["masse brute 12 kg", "GDRN", "unione europea totale articoli", "air waybill", "goods description total", "ex 1", "délai de transit", "", "gross weight net"]


def _quoted(texts: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda texts, k: F.element_at(F.array(*[F.lit(t) for t in texts]), (F.pmod(F.floor(F.col("o_orderkey") / k), F.lit(len(texts))) + 1).cast("int"))
    o = table(spark, sf, "orders").select("o_orderkey")
    return o.select(F.col("o_orderkey").alias("page_id"), F.concat(pick(_FIRST, 1), F.lit("\n"), pick(_SECOND, 4)).alias("text"))


_PAGES_SQL = f"""SELECT o_orderkey AS page_id, ({_quoted(_FIRST)})[CAST(o_orderkey % {len(_FIRST)} + 1 AS INTEGER)] || chr(10) || ({_quoted(_SECOND)})[CAST((o_orderkey // 4) % {len(_SECOND)} + 1 AS INTEGER)] AS text FROM orders"""


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _classify_sql(source: str) -> str:
    hit = lambda p, w, t="low": f"CASE WHEN regexp_matches({t}, {_re(p)}) THEN {w} ELSE 0 END"
    total = lambda tab: " + ".join(hit(p, w) for p, w in tab)
    best = ", ".join(f"greatest(0, {', '.join(hit(p, w) for g, p, w in rules.TITLES if g == f)}) AS t_{f}" for f in classify.families())
    titles = " + ".join(f"t_{f}" for f in classify.families())
    against = ", ".join(f"{total(t)} AS n_{k}" for k, t in rules.AGAINST.items())
    named = " ".join(f"WHEN t_{f} > 0 THEN '{f}'" for f in ("ANNONCE_CW_LISTE", "ANNONCE_CW_INV", "ANNONCE_CW"))
    strong = " ".join(f"WHEN t_{f} >= 6 THEN '{f}'" for f in ("TRANSIT_TCH", "TRANSIT_FR", "TRANSIT_TAD"))
    return f"""(
WITH a AS (SELECT *, lower(text) AS low FROM ({source})),
b AS (SELECT *, {best}, {against} FROM a),
c AS (SELECT *, {titles} + CASE WHEN {titles} > 0 THEN {total(rules.ANCHORS)} ELSE 0 END + {hit(rules.TYPE_BOX, rules.TYPE_WEIGHT, "text")} AS pos FROM b),
d AS (SELECT *, CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 'INDETERMINE' WHEN n_export >= 7 THEN 'EXPORT'
 WHEN t_TRANSIT_LISTE > 0 AND regexp_matches(low, {_re(rules.LIST_TOTALS)}) AND regexp_matches(low, {_re(rules.LIST_HEADER)}) THEN 'TRANSIT_TAD'
 WHEN t_TRANSIT_LISTE > 0 THEN 'TRANSIT_LISTE' {named} WHEN n_cover >= 4 AND pos < 6 THEN 'ENVELOPPE' {strong}
 WHEN pos >= 6 THEN 'TRANSIT_TAD' WHEN n_annex >= 4 THEN 'ANNEXE' ELSE 'INDETERMINE' END AS family FROM c)
SELECT page_id, text, family, CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 0 ELSE pos END AS score_pos,
 CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 0 WHEN family = 'EXPORT' THEN n_export WHEN family = 'ENVELOPPE' THEN n_cover WHEN family = 'ANNEXE' THEN n_annex ELSE n_export + n_annex END AS score_neg
FROM d)"""


@query("page_classify", f"SELECT page_id, family, score_pos, score_neg FROM {_classify_sql(_PAGES_SQL)}")
def page_classify(spark, sf):
    return classify.classify(_pages(spark, sf)).select("page_id", "family", "score_pos", "score_neg")


_RANK_SQL = "CASE {f} " + " ".join(f"WHEN '{f}' THEN {r}" for f, r in rules.RANK.items()) + " ELSE 3 END"
_SECOND_SQL = f"({_quoted(_FIRST)})[CAST((page_id // 7) % {len(_FIRST)} + 1 AS INTEGER)]"
_WINS = f"({_RANK_SQL.format(f='b.family')} > {_RANK_SQL.format(f='a.family')} OR b.score_pos > a.score_pos)"


@query(
    "page_rank_fallback",
    f"""WITH a AS (SELECT * FROM {_classify_sql(_PAGES_SQL)}), s AS (SELECT page_id, {_SECOND_SQL} AS text FROM a), b AS (SELECT * FROM {_classify_sql("SELECT * FROM s")}),
j AS (SELECT a.page_id, a.family AS fa, a.score_pos AS pa, b.family AS fb, b.score_pos AS pb, (length(regexp_replace(a.text, '^\\s+|\\s+$', '', 'g')) < 40 OR a.family = 'INDETERMINE') AND {_WINS} AS wins FROM a JOIN b USING (page_id))
SELECT page_id, CASE WHEN wins THEN fb ELSE fa END AS family, CASE WHEN wins THEN pb ELSE pa END AS score_pos, CASE WHEN wins THEN 'second' ELSE 'text' END AS source FROM j""",
)
def page_rank_fallback(spark, sf):
    def again(df):
        return df.withColumn("second_text", F.element_at(F.array(*[F.lit(t) for t in _FIRST]), (F.pmod(F.floor(F.col("page_id") / 7), F.lit(len(_FIRST))) + 1).cast("int")))

    return classify.with_fallback(_pages(spark, sf), again).select("page_id", "family", "score_pos", "source")


@query("page_richness", f"SELECT page_id, CAST(len(list_distinct(regexp_extract_all(lower(text), {_re(rules.RICH)}, 1))) AS INTEGER) AS richness FROM ({_PAGES_SQL})")
def page_richness(spark, sf):
    return _pages(spark, sf).select("page_id", classify.richness(F.col("text")).alias("richness"))


_MRN_TEXT = "'ref: 2' || CAST(o_orderkey % 10 AS VARCHAR) || ' CH ' || CASE WHEN o_orderkey % 3 = 0 THEN 'O7' ELSE '07' END || 'ST-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || ' end'"
# written out once more: the SQL must not read the list that the plan reads
_ISSUERS_SQL = "string_split('AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LT LU LV MT NL NO PL PT RO SE SI SK TR', ' ')"
_SWISS_FROM, _SWISS_TO = "".join(scalars.SWISS_DIGITS), "".join(scalars.SWISS_DIGITS.values())


def _mrn_text():
    k = F.col("o_orderkey")
    return F.concat(F.lit("ref: 2"), (k % 10).cast("string"), F.lit(" CH "), F.when(k % 3 == 0, "O7").otherwise("07"), F.lit("ST-"), F.lpad(k.cast("string"), 10, "0"), F.lit(" end"))


@query(
    "mrn_from_text",
    f"""WITH t AS (SELECT o_orderkey, regexp_replace(upper({_MRN_TEXT}), '[^0-9A-Z]', '', 'g') AS x FROM orders),
w AS (SELECT o_orderkey, i, substr(x, i, 18) AS c FROM t, LATERAL (SELECT unnest(range(1, length(x) - 16)) AS i)),
r AS (SELECT o_orderkey, i, CASE WHEN substr(c, 3, 2) = 'CH' AND NOT regexp_full_match(substr(c, 5, 2), '[0-9][0-9]') THEN substr(c, 1, 4) || translate(substr(c, 5, 2), '{_SWISS_FROM}', '{_SWISS_TO}') || substr(c, 7) ELSE c END AS c FROM w),
p AS (SELECT o_orderkey, min(i) AS i, c FROM r WHERE regexp_full_match(c, '2[0-9][A-Z]{{2}}[A-Z0-9]{{14}}') AND list_contains({_ISSUERS_SQL}, substr(c, 3, 2))
 AND CASE WHEN substr(c, 3, 2) = 'CH' THEN regexp_full_match(substr(c, 5, 2), '[0-9][0-9]') ELSE length(regexp_replace(c, '[^0-9]', '', 'g')) * 2 >= length(c) AND NOT regexp_matches(substr(c, 5), '[A-Z]{{4}}') END GROUP BY o_orderkey, c)
SELECT o_orderkey, coalesce(string_agg(c, ',' ORDER BY i), '') AS candidates FROM orders LEFT JOIN p USING (o_orderkey) GROUP BY o_orderkey""",
)
def mrn_from_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(scalars.movement_candidates(_mrn_text()), ",").alias("candidates"))


_CONF = {x: g[0] for g in scalars.CONFUSED for x in g[1:]}


@query("confusion_key", f"SELECT p_partkey, translate(upper(p_name), '{''.join(_CONF)}', '{''.join(_CONF.values())}') AS conf_key, replace(translate(p_name, '{''.join(scalars.DIGIT_REPAIR)}', '{''.join(scalars.DIGIT_REPAIR.values())}'), ' ', '') AS repaired, upper(regexp_replace(p_name, '[ -]', '', 'g')) AS ident FROM part")
def confusion_key(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", scalars.confusion_key(n).alias("conf_key"), scalars.repair_digits(n).alias("repaired"), scalars.repair_identifier(n).alias("ident"))


_KEY_SQL = f"translate(upper(x), '{''.join(_CONF)}', '{''.join(_CONF.values())}')"


@query(
    "fuzzy_unique",
    f"""WITH r AS (SELECT c_custkey, 'N' || lpad(CAST((c_custkey * 7919) % 99991 AS VARCHAR), 5, '0') || 'KZ' || lpad(CAST(c_custkey % 97 AS VARCHAR), 3, '0') AS x FROM customer),
l AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN x WHEN 1 THEN substr(x, 1, 3) || 'X' || substr(x, 5) WHEN 2 THEN replace(x, '0', 'O') ELSE x || 'QQQ' END AS x FROM r),
lk AS (SELECT c_custkey, x AS a, {_KEY_SQL} AS ka FROM l), rk AS (SELECT x AS b, {_KEY_SQL} AS kb, count(*) AS m FROM r GROUP BY ALL),
p AS (SELECT c_custkey, a, b, m FROM lk JOIN rk ON abs(length(ka) - length(kb)) <= 2 WHERE levenshtein(ka, kb) <= 2),
g AS (SELECT c_custkey, max(CASE WHEN a = b AND m = 1 THEN b END) AS ex, sum(m) AS n, min(b) AS one FROM p GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN ex IS NOT NULL THEN ex WHEN n = 1 THEN one END AS matched, CASE WHEN ex IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'fuzzy' ELSE 'none' END AS how FROM customer LEFT JOIN g USING (c_custkey)""",
)
def fuzzy_unique(spark, sf):
    k = F.col("c_custkey")
    x = F.concat(F.lit("N"), F.lpad((k * 7919 % 99991).cast("string"), 5, "0"), F.lit("KZ"), F.lpad((k % 97).cast("string"), 3, "0"))
    right = table(spark, sf, "customer").select("c_custkey", x.alias("x"))
    y = F.when(k % 4 == 0, F.col("x")).when(k % 4 == 1, F.concat(F.substring("x", 1, 3), F.lit("X"), F.substr(F.col("x"), F.lit(5)))).when(k % 4 == 2, F.replace(F.col("x"), F.lit("0"), F.lit("O"))).otherwise(F.concat("x", F.lit("QQQ")))
    return joins.fuzzy_unique(right.withColumn("x", y), right, "c_custkey", "x")


@query(
    "choose_best",
    """WITH c AS (SELECT l_orderkey, l_linenumber, 'P' || CAST(l_partkey AS VARCHAR) AS cand, 'P' || CAST(l_orderkey AS VARCHAR) AS ref FROM lineitem),
d AS (SELECT *, CASE WHEN abs(length(cand) - length(ref)) > 4 THEN 99 ELSE levenshtein(cand, ref) END AS dist FROM c),
k AS (SELECT *, length(regexp_replace(cand, '[^0-9]', '', 'g')) AS nd, min(dist) OVER (PARTITION BY l_orderkey) AS lo FROM d)
SELECT l_orderkey, CASE WHEN min(dist) <= 3 THEN first(cand ORDER BY dist, l_linenumber, cand) ELSE first(cand ORDER BY nd DESC, l_linenumber, cand) END AS chosen FROM k WHERE dist <= 4 OR lo > 4 GROUP BY l_orderkey""",
)
def choose_best(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("P"), "l_partkey").alias("cand"), F.concat(F.lit("P"), "l_orderkey").alias("ref"))
    d = li.groupBy("l_orderkey", "ref").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "cand"))).alias("c"))
    return d.select("l_orderkey", scalars.choose_movement(F.transform("c", lambda x: x["cand"]), F.col("ref")).alias("chosen"))


@query(
    "parse_number",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, l_linenumber % 4 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(format('{:.2f}', v) AS DOUBLE) AS n, translate(format('{:,.2f}', v), ',.', ' ,') || ' kg' AS kg FROM t""",
)
def parse_number(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
    grouped, k = F.format_number("v", 2), F.col("l_linenumber") % 4
    plain = F.replace(grouped, F.lit(","), F.lit(""))
    text = F.when(k == 0, F.translate(grouped, ",.", ".,")).when(k == 1, F.translate(grouped, ",.", " ,")).when(k == 2, F.concat(plain, F.lit(" kg"))).otherwise(F.replace(plain, F.lit("."), F.lit(",")))
    n = scalars.parse_number(text)
    return li.select("l_orderkey", "l_linenumber", n.alias("n"), scalars.format_kg(n).alias("kg"))


@query(
    "clean_text",
    r"""WITH t AS (SELECT p_partkey, '  ' || p_name || ' ,' || p_brand || '  ;' || p_type || ' .' AS x, CAST(p_size AS VARCHAR) AS s FROM part),
a AS (SELECT *, regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), ' ?([.,;:]) ?', '\1 ', 'g') AS y FROM t)
SELECT p_partkey, trim(y, ' .;:-') AS cleaned, regexp_replace(x, '[^0-9]', '', 'g') AS digits, trim(regexp_replace(x, '[^0-9A-Za-z._-]+', '_', 'g'), '_') AS slug,
 CASE p_partkey % 3 WHEN 2 THEN NULL ELSE CAST(s AS INTEGER) END AS packages FROM a""",
)
def clean_text(spark, sf):
    x = F.concat(F.lit("  "), "p_name", F.lit(" ,"), "p_brand", F.lit("  ;"), "p_type", F.lit(" ."))
    k, s = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    packs = F.when(k == 0, F.concat(s, F.lit(" PX"))).when(k == 1, F.concat(F.lit(" "), s, F.lit(" colis "))).otherwise(F.concat(s, F.lit(" PX marques 1")))
    return table(spark, sf, "part").select("p_partkey", scalars.clean_text(x).alias("cleaned"), scalars.digits(x).alias("digits"), scalars.slug(x).alias("slug"), scalars.parse_packages(packs).alias("packages"))


@query("date_normalise", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day FROM orders")
def date_normalise(spark, sf):
    k = F.col("o_orderkey") % 3
    d = F.col("o_orderdate").cast("date")
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(F.concat(F.date_format(d, "dd.MM.yyyy"), F.lit(", 07:16")))
    return table(spark, sf, "orders").select("o_orderkey", scalars.date_fr(text).alias("day"))


_HOLES = "CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN NULL ELSE l_quantity END"


def _holes():
    return F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 17 != 0, F.col("l_quantity"))


@query("sum_all_or_nothing", f"SELECT l_orderkey, CASE WHEN count(q) = count(*) THEN sum(q) END AS gross, CAST(CASE WHEN count(q) = count(*) THEN sum(q) ELSE 0 END AS DOUBLE) AS packages, sum(coalesce(q, 0)) AS measured FROM (SELECT l_orderkey, {_HOLES} AS q FROM lineitem) GROUP BY l_orderkey")
def sum_all_or_nothing(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", _holes().alias("q"))
    q = F.col("q")
    return li.groupBy("l_orderkey").agg(aggregates.sum_or_null(q).alias("gross"), aggregates.sum_or_zero(q).cast("double").alias("packages"), F.sum(F.coalesce(q, F.lit(0.0))).alias("measured"))


@query(
    "cross_check_totals",
    f"""WITH s AS (SELECT l_orderkey, CASE WHEN count(q) = count(*) THEN CAST(sum(q) AS BIGINT) END AS total, count(*) AS n FROM (SELECT l_orderkey, {_HOLES} AS q FROM lineitem) GROUP BY l_orderkey),
d AS (SELECT o_orderkey, total, n, CASE WHEN o_orderkey % 5 = 0 THEN total + 1 ELSE total END AS declared, CASE WHEN o_orderkey % 7 = 0 THEN n + 2 ELSE n END AS declared_n FROM orders JOIN s ON l_orderkey = o_orderkey)
SELECT o_orderkey, concat_ws(' | ', CASE WHEN abs(declared - total) > 0.05 THEN 'gross: ' || declared || ' / ' || total END, CASE WHEN abs(declared_n - n) > 0 THEN 'lines: ' || declared_n || ' / ' || n END) AS discrepancy FROM d""",
)
def cross_check_totals(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", _holes().alias("q"))
    s = li.groupBy("l_orderkey").agg(aggregates.sum_or_null(F.col("q")).cast("bigint").alias("total"), F.count("*").alias("n"))
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").select("o_orderkey").join(s, F.col("l_orderkey") == k)
    d = d.withColumns({"declared": F.when(k % 5 == 0, F.col("total") + 1).otherwise(F.col("total")), "declared_n": F.when(k % 7 == 0, F.col("n") + 2).otherwise(F.col("n"))})
    return aggregates.cross_check(d, {"gross": ("declared", "total", 0.05), "lines": ("declared_n", "n", 0)}).select("o_orderkey", "discrepancy")


_GATE_LINE = """CASE WHEN l_linenumber % 6 = 0 THEN 'line ' || no || ': designation missing' END, CASE WHEN l_partkey % 11 = 0 THEN 'line ' || no || ': commodity code missing or invalid' END,
CASE WHEN gross IS NULL THEN 'line ' || no || ': gross mass missing or invalid' END, CASE WHEN net > gross THEN 'line ' || no || ': net mass over gross mass' END, CASE WHEN l_suppkey % 13 = 0 THEN 'line ' || no || ': packages missing or ambiguous' END"""


@query(
    "quality_gate",
    f"""WITH l AS (SELECT *, {_HOLES} AS gross, l_quantity * CASE WHEN l_linenumber = 2 THEN 2 ELSE 0.5 END AS net, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS no FROM lineitem),
r AS (SELECT l_orderkey, string_agg(nullif(concat_ws(' ; ', {_GATE_LINE}), ''), ' ; ' ORDER BY no) AS lines, count(gross) = count(*) AS whole, sum(gross) AS total, bool_and(l_suppkey % 13 <> 0) AS packs, count(*) AS n FROM l GROUP BY l_orderkey)
SELECT o_orderkey, concat_ws(' ; ', CASE WHEN o_orderkey % 9 = 0 THEN 'identifier missing or malformed' END, CASE WHEN o_orderkey % 4 = 0 THEN 'identifier not corroborated' END, lines,
 CASE WHEN o_orderkey % 5 = 0 AND whole THEN 'gross masses differ from the total' END, CASE WHEN o_orderkey % 3 = 0 AND packs THEN 'packages differ from the total' END, CASE WHEN o_orderkey % 10 = 0 THEN 'model reading needs a person' END) AS reasons
FROM orders JOIN r ON l_orderkey = o_orderkey""",
)
def quality_gate(spark, sf):
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    li = table(spark, sf, "lineitem")
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.when(F.col("l_linenumber") % 6 != 0, "goods").alias("designation"), F.when(F.col("l_partkey") % 11 != 0, "12345678").otherwise("12").alias("code"),
        text(_holes()).alias("gross"), text(F.col("l_quantity") * F.when(F.col("l_linenumber") == 2, 2).otherwise(0.5)).alias("net"),
        F.when(F.col("l_suppkey") % 13 != 0, "1 PK").otherwise("1 PK of 2").alias("packages"),
    )
    grouped = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    d = table(spark, sf, "orders").select("o_orderkey").join(grouped, F.col("l_orderkey") == k)
    d = d.withColumns({
        "mrn": F.when(k % 9 != 0, "26CH07STTEST000010").otherwise("26CH"), "verified": k % 4 != 0, "dm": F.lit("DM 20260041"), "parties": F.array(F.lit("p")),
        "total_gross": text(F.col("q") + F.when(k % 5 == 0, 1).otherwise(0)), "total_packages": F.concat(text(F.col("n") + F.when(k % 3 == 0, 1).otherwise(0)), F.lit(" colis")),
        "discrepancy": F.lit(""), "model_used": k % 10 == 0, "evidence": F.array(F.lit("e")), "blockers": F.array().cast("array<string>"), "warnings": F.array().cast("array<string>"),
    })
    return gate.gate(d).select("o_orderkey", F.array_join("reasons", " ; ").alias("reasons"))


@query("incomplete", f"SELECT l_orderkey, bool_or(l_partkey % 19 = 0 OR (gross IS NULL AND l_suppkey % 2 = 0)) AS incomplete FROM (SELECT *, {_HOLES} AS gross FROM lineitem) GROUP BY l_orderkey")
def incomplete(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 19 != 0, "12345678").alias("code"), _holes().alias("gross"), F.when(F.col("l_suppkey") % 2 != 0, 1.0).alias("net"))
    return gate.incomplete(li, "l_orderkey")


@query(
    "interval_owner",
    """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner FROM events""",
)
def interval_owner(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return joins.interval_owner(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id")).select("event_id", "owner")


@query(
    "block_totals",
    """WITH b AS (SELECT user_id, ts, event_id, value, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS block FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, block ORDER BY ts, event_id) AS k FROM b)
SELECT user_id, block, max(CASE WHEN k = 1 THEN value END) AS value_1, max(CASE WHEN k = 2 THEN value END) AS value_2 FROM n GROUP BY user_id, block""",
)
def block_totals(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    b = layout.blocks(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return layout.nth_in_block(b, ["user_id", "block"], ["ts", "event_id"], "value", 2)


@query(
    "gap_islands",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN date_diff('second', lag(ts) OVER w, ts) > 14400 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_event FROM c GROUP BY user_id, island""",
)
def gap_islands(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    second = F.unix_seconds(F.date_trunc("second", "ts").cast("timestamp"))
    fresh = F.coalesce((second - F.lag(second).over(w) > 14400).cast("int"), F.lit(1))
    e = e.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(
    "anchor_group",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, value, k, value AS anchor, 1 AS g FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.event_id, e.value, e.k, CASE WHEN abs(e.value - f.anchor) > 5.0 THEN e.value ELSE f.anchor END, CASE WHEN abs(e.value - f.anchor) > 5.0 THEN f.g + 1 ELSE f.g END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, CAST(g AS INTEGER) AS line_no FROM f""",
)
def anchor_group(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("value", "event_id"))).alias("w"))
    g = g.withColumn("line_no", layout.anchor_groups(F.col("w"), "value", 5.0))
    return g.select(F.inline(F.arrays_zip("w", "line_no"))).select("w.event_id", "line_no")


@query(
    "session_batches",
    """WITH s AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_type <> 'refund' AS ready, event_id FROM events),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 7200 SECOND THEN 1 ELSE 0 END AS fresh FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS opened, count(*) AS n, bool_and(ready) AS complete FROM b GROUP BY user_id, k""",
)
def session_batches(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "refund").alias("ready"))
    return watch.sessions(e, "user_id", "at", "ready", 7200).select("user_id", F.unix_micros("opened").alias("opened"), "n", "complete")


_NAME_SQL = "CASE doc_id % 6 WHEN 0 THEN '.' || doc_id || '.pdf' WHEN 1 THEN doc_id || '.pdf.part' WHEN 2 THEN '~$' || doc_id || '.pdf' ELSE doc_id || '.pdf' END"


@query("ready_filter", f"SELECT doc_id, name FROM (SELECT doc_id, {_NAME_SQL} AS name, octet_length(encode(text)) AS size, doc_id % 11 AS age FROM documents) WHERE NOT regexp_matches(name, '(?i)^(\\.|~\\$)|\\.(tmp|temp|part|partial|crdownload|download|filepart|swp|lock)$') AND size >= 64 AND age >= 3")
def ready_filter(spark, sf):
    from ..sources.files import ready

    k = F.col("doc_id")
    s = k.cast("string")
    name = F.when(k % 6 == 0, F.concat(F.lit("."), s, F.lit(".pdf"))).when(k % 6 == 1, F.concat(s, F.lit(".pdf.part"))).when(k % 6 == 2, F.concat(F.lit("~$"), s, F.lit(".pdf"))).otherwise(F.concat(s, F.lit(".pdf")))
    d = table(spark, sf, "documents").select("doc_id", name.alias("name"), F.octet_length("text").alias("size"), (k % 11).alias("age"))
    return d.filter(ready(F.col("name"), F.col("size"), F.col("age"))).select("doc_id", "name")


@query("dedup_first", "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS skipped, sha256(text) AS sha FROM documents WHERE text IS NOT NULL")
def dedup_first(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = d.groupBy("sha").agg(F.min("doc_id").alias("first"))
    return d.join(first, "sha").select("doc_id", (F.col("doc_id") != F.col("first")).alias("skipped"), "sha")


@query(
    "unique_lookup",
    """WITH k AS (SELECT s_nationkey AS key, min(s_suppkey) AS v, min(s_suppkey) <> max(s_suppkey) AS many FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY 1)
SELECT c_custkey, CASE WHEN many THEN NULL ELSE v END AS s_suppkey, CASE WHEN many IS NULL THEN 'absent' WHEN many THEN 'ambiguous' ELSE 'found' END AS status FROM customer LEFT JOIN k ON key = c_nationkey""",
)
def unique_lookup(spark, sf):
    right = table(spark, sf, "supplier").filter("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey")
    return joins.unique_match(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), right, "c_nationkey", "s_suppkey").select("c_custkey", "s_suppkey", "status")


@query(
    "inverse_check",
    "SELECT l_orderkey, l_suppkey, clash FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 1) a JOIN (SELECT l_suppkey, min(l_orderkey) <> max(l_orderkey) AS clash FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) b USING (l_suppkey)",
)
def inverse_check(spark, sf):
    p = table(spark, sf, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_suppkey").distinct()
    return joins.inverse_unique(p, "l_orderkey", "l_suppkey").select("l_orderkey", "l_suppkey", "clash")


@query(
    "two_phase_confirm",
    """WITH c AS (SELECT l_orderkey AS o_orderkey, min(l_suppkey) AS supp, min(l_linestatus) AS st FROM lineitem GROUP BY 1),
j AS (SELECT c.o_orderkey, coalesce(o.o_orderstatus = c.st AND o.o_orderpriority NOT LIKE '1%', false) AS confirmed FROM c LEFT JOIN orders o USING (o_orderkey))
SELECT o_orderkey, confirmed, CASE WHEN confirmed THEN 'index' ELSE 'fallback' END AS path FROM j""",
)
def two_phase_confirm(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("st"))
    j = joins.confirm(c, table(spark, sf, "orders"), "o_orderkey", [("st", "o_orderstatus")], ~F.col("o_orderpriority").startswith("1"))
    return j.select("o_orderkey", "confirmed", F.when(F.col("confirmed"), "index").otherwise("fallback").alias("path"))


@query(
    "path_join",
    """WITH p AS (SELECT r_name, n_name, c_custkey, count(o_orderkey) AS n, min(o_orderkey) AS k FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
 LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 8 = 0) o ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey, r_name, n_name, CASE WHEN n = 1 THEN k END AS arrival, CASE WHEN n = 1 THEN 'found' WHEN n = 0 THEN 'absent' ELSE 'ambiguous' END AS status FROM p""",
)
def path_join(spark, sf):
    # region and nation have fixed sizes (5 and 25 rows)
    places = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf, "orders").filter("o_orderkey % 8 = 0").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("arrival"))
    return joins.unique_match(c, o, "c_custkey", "arrival").select("c_custkey", "r_name", "n_name", "arrival", "status")


@query(
    "outer_merge",
    """WITH l AS (SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS k, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0),
r AS (SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS k, 'R' || c_custkey AS name, lower(c_mktsegment) AS seg FROM customer WHERE c_custkey % 2 = 0)
SELECT CAST(coalesce(l.k, r.k) AS VARCHAR) AS k, coalesce(l.name, r.name) AS name, coalesce(r.seg, l.seg) AS seg FROM l FULL JOIN r ON l.k = r.k""",
)
def outer_merge(spark, sf):
    c = table(spark, sf, "customer")
    k = F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey").cast("string")).alias("k")
    left = c.filter("c_custkey % 3 <> 0").select(k, F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    right = c.filter("c_custkey % 2 = 0").select(k, F.concat(F.lit("R"), "c_custkey").alias("name"), F.lower("c_mktsegment").alias("seg"))
    return joins.outer_merge(left, right, "k", ["name", "seg"], ("seg",))


@query(
    "merge_fragments",
    """WITH f AS (SELECT conv_id, role, turn, CASE WHEN turn % 2 = 1 THEN substr(text, 1, 8) END AS a, CASE WHEN turn >= 2 THEN substr(text, 2, 5) END AS b, nullif(substr(text, 300, 4), '') AS c FROM conversations),
m AS (SELECT conv_id, role, arg_min(a, CASE WHEN a <> '' THEN turn END) AS a, arg_min(b, CASE WHEN b <> '' THEN turn END) AS b, arg_min(c, CASE WHEN c <> '' THEN turn END) AS c, min(turn) AS pos FROM f GROUP BY 1, 2),
s AS (SELECT *, CAST(CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END AS INTEGER) AS filled FROM m)
SELECT conv_id, role, a, b, c, filled FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY filled DESC, pos) AS k FROM s) WHERE k = 1""",
)
def merge_fragments(spark, sf):
    t = F.col("text")
    f = table(spark, sf, "conversations").select("conv_id", "role", "turn", F.when(F.col("turn") % 2 == 1, F.substring(t, 1, 8)).alias("a"), F.when(F.col("turn") >= 2, F.substring(t, 2, 5)).alias("b"), F.nullif(F.substring(t, 300, 4), F.lit("")).alias("c"))
    return aggregates.best_group(f, ["conv_id"], "role", "turn", ["a", "b", "c"])


@query(
    "reading_merge",
    """SELECT conv_id, count(*) AS n, count(DISTINCT turn) = count(*) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS complete, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS merged FROM conversations WHERE conv_id % 5 <> 0 OR turn <> 1 GROUP BY conv_id""",
)
def reading_merge(spark, sf):
    c = table(spark, sf, "conversations").filter("conv_id % 5 <> 0 OR turn <> 1")
    merged = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    texts = c.groupBy("conv_id").agg(F.sha2(merged, 256).alias("merged"))
    return aggregates.complete_sequence(c, ["conv_id"], "turn").join(texts, "conv_id").select("conv_id", "n", "complete", "merged")


@query(
    "fill_by_name",
    """WITH r AS (SELECT lower(trim(p_name)) AS k, count(*) AS n, min(p_brand) AS brand FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_brand END, CASE WHEN n = 1 THEN brand END) AS brand FROM part LEFT JOIN r ON k = lower(trim(p_name))""",
)
def fill_by_name(spark, sf):
    p = table(spark, sf, "part")
    left = p.select("p_partkey", "p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("").alias("brand"))
    right = p.filter("p_partkey % 3 = 0").select("p_name", F.col("p_brand").alias("brand"))
    return joins.fill_empty(left, right, F.lower(F.trim("p_name")), ["brand"]).select("p_partkey", "brand")


@query("kv_first", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def kv_first(spark, sf):
    return announce.keep_first(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("json_soft", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_soft(spark, sf):
    k = F.col("event_id") % 2
    text = F.when(k == 0, F.col("props")).otherwise(F.concat(F.lit("answer: "), "props", F.lit(" done")))
    return table(spark, sf, "events").select("event_id", F.try_variant_get(scalars.json_soft(text), "$.k", "bigint").alias("k"))


@query(
    "line_flatten",
    """SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS no,
 'part ' || l_partkey || CASE WHEN min(l_orderkey) OVER (PARTITION BY o_custkey) <> max(l_orderkey) OVER (PARTITION BY o_custkey) THEN ' [' || l_orderkey || ']' ELSE '' END AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def line_flatten(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = li.join(o, "l_orderkey").withColumn("name", F.concat(F.lit("part "), "l_partkey"))
    out = announce.flatten_lines(rows, ["o_custkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "name", "l_orderkey")
    return out.select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("no").cast("bigint").alias("no"), "name")


@query("recap_pivot", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f_n, count(*) FILTER (o_orderstatus = 'O') AS o_n, count(*) FILTER (o_orderstatus = 'P') AS p_n FROM orders GROUP BY o_custkey")
def recap_pivot(spark, sf):
    p = table(spark, sf, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("o_custkey", *[F.coalesce(F.col(c), F.lit(0)).alias(f"{c.lower()}_n") for c in "FOP"])


@query("party_group", "SELECT c_mktsegment, c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS refs, count(DISTINCT c_custkey) AS n_refs FROM customer GROUP BY 1, 2")
def party_group(spark, sf):
    return announce.party_groups(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey")


@query(
    "topk_budget",
    f"""WITH r AS (SELECT page_id, family, page_id % 50 AS file_id, len(list_distinct(regexp_extract_all(lower(text), {_re(rules.RICH)}, 1))) AS rich FROM {_classify_sql(_PAGES_SQL)} WHERE family NOT IN ('ENVELOPPE', 'EXPORT')),
o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN family IN ('TRANSIT_TAD', 'TRANSIT_TCH', 'TRANSIT_FR', 'ANNONCE_CW', 'ANNONCE_CW_INV') THEN 0 WHEN family IN ('ANNONCE_CW_LISTE', 'TRANSIT_LISTE') THEN 1 ELSE 2 END, -rich, page_id) AS k, count(*) OVER (PARTITION BY file_id) > 12 AS truncated FROM r)
SELECT file_id, page_id, CAST(k AS INTEGER) AS k, truncated FROM o WHERE k <= 12""",
)
def topk_budget(spark, sf):
    p = classify.classify(_pages(spark, sf)).filter(~F.col("family").isin("ENVELOPPE", "EXPORT")).withColumn("file_id", F.col("page_id") % 50)
    first = F.when(F.col("family").isin("TRANSIT_TAD", "TRANSIT_TCH", "TRANSIT_FR", "ANNONCE_CW", "ANNONCE_CW_INV"), 0).when(F.col("family").isin("ANNONCE_CW_LISTE", "TRANSIT_LISTE"), 1).otherwise(2)
    w = W.partitionBy("file_id")
    ranked = p.select("file_id", "page_id", first.alias("r"), (-classify.richness(F.col("text"))).alias("x"))
    top = ranked.withColumn("k", F.row_number().over(w.orderBy("r", "x", "page_id"))).filter("k <= 12")
    sizes = ranked.groupBy("file_id").agg((F.count("*") > 12).alias("truncated"))
    return top.join(sizes, "file_id").select("file_id", "page_id", "k", "truncated")


@query(
    "sequence_alloc",
    """WITH f AS (SELECT year(o_orderdate) AS year, o_custkey AS ident, min(o_orderkey) AS first FROM orders GROUP BY 1, 2)
SELECT CAST(year AS INTEGER) AS year, ident, CAST(row_number() OVER (PARTITION BY year ORDER BY first, ident) + CASE WHEN year = 1995 THEN 40 ELSE 0 END AS INTEGER) AS sequence FROM f""",
)
def sequence_alloc(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("ident"), "o_orderkey")
    last = spark.createDataFrame([(1995, 40)], "year int, last int")
    return registry.allocate_batch(o, "year", "ident", ["o_orderkey"], last=last).select("year", "ident", "sequence")


_REF_SQL = "'26CH07ST' || lpad(CAST({k} AS VARCHAR), 10, '0')"


@query(
    "identity_set",
    f"""WITH r AS (SELECT l_orderkey, {_REF_SQL.format(k="CASE WHEN l_orderkey % 6 = 0 THEN l_suppkey % 3 ELSE l_partkey END")} AS ref FROM lineitem)
SELECT l_orderkey, CASE WHEN count(*) = count(DISTINCT ref) THEN string_agg(ref, '|' ORDER BY ref) END AS identity FROM r GROUP BY l_orderkey""",
)
def identity_set(spark, sf):
    k = F.when(F.col("l_orderkey") % 6 == 0, F.col("l_suppkey") % 3).otherwise(F.col("l_partkey"))
    li = table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit(" 26ch07st"), F.lpad(k.cast("string"), 10, "0")).alias("ref"))
    return li.groupBy("l_orderkey").agg(F.collect_list("ref").alias("refs")).select("l_orderkey", scalars.identity(F.col("refs")).alias("identity"))


@query(
    "paginate",
    """WITH RECURSIVE e AS (SELECT l_suppkey AS doc, l_quantity AS h, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS k FROM lineitem),
f AS (SELECT doc, k, h AS room, 1 AS n, 1 AS page FROM e WHERE k = 1
 UNION ALL SELECT e.doc, e.k, CASE WHEN f.n >= 8 OR f.room + e.h > 120.0 THEN e.h ELSE f.room + e.h END, CASE WHEN f.n >= 8 OR f.room + e.h > 120.0 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 8 OR f.room + e.h > 120.0 THEN f.page + 1 ELSE f.page END FROM f JOIN e ON e.doc = f.doc AND e.k = f.k + 1)
SELECT doc, CAST(page AS INTEGER) AS page, count(*) AS lines FROM f GROUP BY doc, page""",
)
def paginate(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("h"))
    d = li.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "h"))).alias("w"))
    pages = d.select("doc", F.explode(announce.paginate(F.transform("w", lambda x: x["h"]), 8, 120.0)).alias("page"))
    return pages.groupBy("doc", "page").agg(F.count("*").alias("lines"))


@query("paginate_all")
def paginate_all(spark, sf):
    """All lines, a document for each supplier, with a closing block of 30 on the last page."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("h"))
    d = li.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "h"))).alias("w"))
    pages = d.select("doc", F.explode(announce.paginate(F.transform("w", lambda x: x["h"]), 8, 120.0, 30.0)).alias("page"))
    return pages.groupBy("doc", "page").agg(F.count("*").alias("lines"))


@query(
    "corpus_accuracy",
    """WITH j AS (SELECT l.doc_id, CASE WHEN regexp_matches(d.text, '!!|\\|') THEN 0 ELSE 1 END AS predicted, l.quality FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL AND d.text IS NOT NULL)
SELECT quality, count(*) AS evaluated, count(*) FILTER (predicted = quality) AS concordant FROM j GROUP BY quality""",
)
def corpus_accuracy(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("text").rlike(r"!!|\|"), 0).otherwise(1).alias("predicted")).join(table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    j = table(spark, sf, "labels").filter("quality IS NOT NULL").join(d, "doc_id")
    return j.groupBy("quality").agg(F.count("*").alias("evaluated"), F.count_if(F.col("predicted") == F.col("quality")).alias("concordant"))


@query(
    "html_fields",
    r"""SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, nullif(regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1), '') AS lang, nullif(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '') AS host FROM pages""",
)
def html_fields(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", scalars.found(h, r"(?is)<title[^>]*>(.*?)</title>").alias("title"), scalars.found(h, r'(?i)<html[^>]*lang="([^"]*)"').alias("lang"), scalars.found(F.col("url"), r"^[a-z]+://([^/]+)").alias("host"))


@query("announcement_json")
def announcement_json(spark, sf):
    """Orders as declarations, customers as batches, to nested documents."""
    line = F.struct("l_linenumber", F.concat(F.lit("part "), "l_partkey").alias("designation"), "l_quantity")
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"), aggregates.sum_or_null(_holes()).alias("gross"), F.count("*").cast("int").alias("packages"))
    d = table(spark, sf, "orders").join(li, "o_orderkey").select("o_custkey", "o_orderkey", F.concat(F.lit("26CH07ST"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("mrn"), F.lit("DM 20260041").alias("dm"), "lines", "gross", "packages", F.array("o_orderpriority").alias("parties"))
    return announce.to_json_documents(announce.merge_declarations(d, "o_custkey", "o_orderkey"), "o_custkey")


_MADE_UP = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'Total ' || p_name WHEN 2 THEN '12.5' WHEN 3 THEN 'Consignee ' || p_name ELSE 'ab ' || p_size END"


@query(
    "designations",
    f"""WITH t AS (SELECT p_partkey, {_MADE_UP} AS v FROM part)
SELECT p_partkey, length(v) >= 6 AND regexp_matches(v, '[A-Za-z]{{4,}}') AND NOT starts_with(v, 'Total ') AND v <> '12.5' AS plausible, p_partkey % 5 <> 3 AND NOT starts_with(lower(v), 'no ') AS is_value FROM t""",
)
def designations(spark, sf):
    """Names, labels, numbers and codes as cells of a goods table."""
    k = F.col("p_partkey") % 5
    v = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("Total "), "p_name")).when(k == 2, "12.5").when(k == 3, F.concat(F.lit("Consignee "), "p_name")).otherwise(F.concat(F.lit("ab "), F.col("p_size").cast("string")))
    return table(spark, sf, "part").select("p_partkey", scalars.plausible_designation(v).alias("plausible"), scalars.is_value(v).alias("is_value"))


@query("stream_watch", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def stream_watch(spark, sf):
    """The events file as a watched folder: one batch, written once, read again."""
    import tempfile

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="ledgerloom-watch-")
    import uuid

    out = f"{root}/watch-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def work(batch, batch_id):
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/result/batch={batch_id}")

    watch.watch(spark, f"{sf}/events*.parquet", schema, work, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/result").groupBy("event_type").agg(F.sum("n").alias("n"))


from . import combined, completed, printed  # noqa: E402, F401  (they register their queries here)
