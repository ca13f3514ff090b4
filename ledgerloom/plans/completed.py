"""Model completion, staged lookups, a person's confirmation and the checks of rendered documents, on
made-up declarations; the SQL states what each should become."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import classify, completion
from ..session import table
from .catalogue import _PAGES_SQL, _pages, query

_LINE = "struct<no:string,designation:string,code:string,gross:string,net:string,packages:string,previous:string>"
_PARTY = "struct<role:string,name:string,address:string>"
_FACT = "struct<label:string,value:string>"


def _struct(kind: str, **values):
    """A struct of the given type, absent fields null."""
    names = [x.split(":")[0] for x in kind[len("struct<") : -1].split(",")]
    lift = lambda v: v if not isinstance(v, str | type(None)) else F.lit(v)
    return F.struct(*[lift(values.get(n)).cast("string").alias(n) for n in names])


def _empty(kind: str):
    return F.array().cast(f"array<{kind}>")


def _movement(k):
    return F.concat(F.lit("26CH07"), F.lpad(k.cast("string"), 12, "0"))


_MOVEMENT = "'26CH07' || lpad(CAST({0} AS VARCHAR), 12, '0')"


@query(
    "reading_wanted",
    """WITH d AS (SELECT o_orderkey, o_orderkey % 4 IN (0, 1) OR o_orderkey % 5 = 0 AS short, count(*) OVER (PARTITION BY o_orderkey // 3) > 1 AS many, o_orderkey % 7 = 0 AS notes FROM orders)
SELECT o_orderkey AS decl_id, short AND NOT many AND NOT notes AS wanted, CASE WHEN short AND many THEN 'several declarations in the file' WHEN short AND notes THEN 'several shipments annexed' END AS why_not FROM d""",
)
def reading_wanted(spark, sf):
    """Three order numbers make a file; goods, codes and parties are missing at other remainders."""
    k = F.col("o_orderkey")
    lines = F.when(k % 4 == 0, _empty(_LINE)).when(k % 4 == 1, F.array(_struct(_LINE, designation="goods", gross="1"))).otherwise(F.array(_struct(_LINE, designation="goods", code="847130", net="1")))
    parties = F.when(k % 5 == 0, _empty(_PARTY)).otherwise(F.array(_struct(_PARTY, name="a")))
    d = table(spark, sf, "orders").select(F.floor(k / 3).alias("file_id"), k.alias("decl_id"), lines.alias("lines"), parties.alias("parties"), (k % 7 == 0).alias("several_notes"))
    return completion.reading_wanted(d).select("decl_id", "wanted", "why_not")


@query(
    "fill_from_reading",
    """WITH d AS (SELECT o_orderkey AS k, o_orderkey % 4 AS r FROM orders)
SELECT k AS decl_id, CASE r WHEN 0 THEN 'Cigarettes 84713000|Tea' ELSE 'Goods' END AS names, CASE r WHEN 0 THEN '84713000|' || '1 200,50 kg' WHEN 1 THEN '84713000|' || '1 200,50 kg' ELSE '' END AS first_line,
 CASE r WHEN 3 THEN 0 ELSE 1 END AS parties, CASE r WHEN 3 THEN 'Scellés=1' ELSE 'Scellés=1;Véhicule / mode=camion 7;Masse brute totale=10,00 kg' END AS transport,
 CASE r WHEN 3 THEN NULL ELSE '4 colis' END AS total_packages, CASE WHEN k % 5 = 0 THEN '9 kg' WHEN r = 3 THEN NULL ELSE '12,00 kg' END AS total_gross, r <> 3 AS changed,
 CASE r WHEN 0 THEN 'designations from a model (2 lines): to check;model: ' || repeat('x', 160) WHEN 3 THEN '' ELSE 'model: ' || repeat('x', 160) END AS warnings FROM d""",
)
def fill_from_reading(spark, sf):
    """No readable line, one with gaps, one whose name was read twice, and no reading at all."""
    k = F.col("o_orderkey")
    r = k % 4
    own = F.array(F.when(r == 0, _struct(_LINE, designation=" ")).otherwise(_struct(_LINE, designation="Goods")))
    d = table(spark, sf, "orders").select(k.alias("decl_id"), own.alias("lines"), _empty(_PARTY).alias("parties"), F.array(_struct(_FACT, label="Scellés", value="1")).alias("transport"), F.when(k % 5 == 0, "9 kg").alias("total_gross"), F.lit(None).cast("string").alias("total_packages"), F.lit("document").alias("goods_source"), F.array().cast("array<string>").alias("warnings"))
    full = _struct(_LINE, designation="goods", code="84713000", gross="1200,5", net="0")
    read = F.when(r == 0, F.array(_struct(_LINE, designation="Cigarettes 84713000, tc: 84713000", code="84713000", gross="1200,5"), _struct(_LINE, designation="Tea"), _struct(_LINE, designation="n/a")))
    read = read.when(r == 1, F.array(full)).otherwise(F.array(full, full))
    facts = [("seal no", "2"), ("mode", "waybill 12"), ("Mode of travel", "camion 7"), ("vehicle mode", "rail"), ("gross mass", "10"), ("net mass", "none"), ("page", "1")]
    readings = table(spark, sf, "orders").filter(r != 3).select(
        k.alias("decl_id"), read.alias("lines"), F.array(_struct(_PARTY, name="-"), _struct(_PARTY, role="consignee", name="B")).alias("parties"), F.array(*[_struct(_FACT, label=a, value=b) for a, b in facts]).alias("transport"),
        F.lit("12 kg").alias("total_gross"), F.lit("4 packages").alias("total_packages"), F.repeat(F.lit("x"), 200).alias("comment"),
    )
    out = completion.fill_from_reading(d, readings)
    one = F.get("lines", F.lit(0))
    return out.select(
        "decl_id", F.array_join("lines.designation", "|").alias("names"), F.concat_ws("|", one["code"], one["gross"]).alias("first_line"), F.size("parties").alias("parties"),
        F.array_join(F.transform("transport", lambda t: F.concat(t["label"], F.lit("="), t["value"])), ";").alias("transport"), "total_packages", "total_gross", "changed", F.array_join("warnings", ";").alias("warnings"),
    )


@query(
    "read_within_budget",
    """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS page, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
q AS (SELECT *, CASE part % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS first FROM p WHERE part % 11 <> 0),
c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY first, part % 7 DESC, page) AS n, count(*) OVER (PARTITION BY k) AS total FROM q),
s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY k, part % 3 ORDER BY n) > 1 THEN 'copy' WHEN page % 5 = 0 THEN 'failed' ELSE 'read' END AS status FROM c WHERE n <= 4)
SELECT k AS decl_id, count(*) FILTER (status = 'read') AS n_read, count(*) FILTER (status = 'copy') AS n_copy, max(CASE WHEN status = 'copy' THEN NULL ELSE page END) AS last_page,
 concat_ws(';', CASE WHEN max(total) > 4 THEN 'reading limited to 4 of ' || max(total) || ' pages' END, string_agg('page ' || page || ': reading failed', ';' ORDER BY page) FILTER (status = 'failed')) AS blockers FROM s GROUP BY k""",
)
def read_within_budget(spark, sf):
    """Orders as declarations, their lines as pages; pages whose number is five cannot be read."""
    part = F.col("part")
    p = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("decl_id"), F.col("l_linenumber").alias("page")).agg(F.min("l_partkey").alias("part"))
    family = F.when(part % 11 == 0, "ENVELOPPE").when(part % 4 == 0, "TRANSIT_TAD").when(part % 4 == 1, "TRANSIT_LISTE").otherwise("ANNEXE")
    pages = p.select("decl_id", "page", family.alias("family"), (part % 7).alias("richness"), (part % 3).cast("string").alias("image"))
    log, blockers = completion.read_within_budget(pages, lambda df: df.withColumn("reading", F.when(F.col("page") % 5 != 0, F.concat(F.lit("page "), F.col("page").cast("string")))), 4)
    counts = log.groupBy("decl_id").agg(F.count_if(F.col("status") == "read").alias("n_read"), F.count_if(F.col("status") == "copy").alias("n_copy"), F.max(F.when(F.col("status") != "copy", F.col("page"))).alias("last_page"))
    return counts.join(blockers, "decl_id", "left").select("decl_id", "n_read", "n_copy", "last_page", F.coalesce(F.array_join("blockers", ";"), F.lit("")).alias("blockers"))


@query(
    "staged_lookup",
    f"""WITH o AS (SELECT o_orderkey AS k FROM orders), m AS (SELECT k, {_MOVEMENT.format("k")} AS mrn FROM o WHERE k % 13 <> 0 UNION ALL SELECT k, 'x' || k FROM o WHERE k % 13 = 0),
a AS (SELECT *, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 4 = 0 THEN 'I' || k WHEN k % 4 = 1 AND k % 5 <> 0 THEN 'B' || k WHEN k % 4 < 3 THEN 'S' || (k // 40) END AS key FROM m),
b AS (SELECT *, min(CASE WHEN key IS NOT NULL THEN mrn END) OVER (PARTITION BY key) AS owner FROM a),
c AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'malformed' WHEN key IS NULL THEN 'absent' WHEN owner <> mrn THEN 'key of another movement' ELSE 'found' END AS status FROM b)
SELECT mrn, CASE WHEN status = 'found' THEN key END AS key, CASE WHEN status = 'found' THEN CASE key[1] WHEN 'I' THEN 'index' WHEN 'B' THEN 'documents' ELSE 'search' END END AS stage, status FROM c""",
)
def staged_lookup(spark, sf):
    """An index, documents (ambiguous for some, whom the search then answers), a search whose keys several share."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.when(k % 13 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(_movement(k)).alias("mrn"))
    key = lambda letter, x=k: F.concat(F.lit(letter), x.cast("string")).alias("key")
    documents = o.filter(k % 4 == 1).select("mrn", key("B")).unionByName(o.filter((k % 4 == 1) & (k % 5 == 0)).select("mrn", key("C")))
    stages = [("index", o.filter(k % 4 == 0).select("mrn", key("I"))), ("documents", documents), ("search", o.filter(k % 4 < 3).select("mrn", key("S", F.floor(k / 40))))]
    return completion.staged_lookup(o.select("mrn"), stages)


@query(
    "confirm_by_person",
    """WITH b AS (SELECT o_custkey AS batch, bool_or(o_orderkey % 9 = 0) AS doubt, count(*) AS n FROM orders GROUP BY 1)
SELECT batch, CASE WHEN batch % 11 = 0 THEN 'no sources' WHEN batch % 5 = 0 THEN 'sources changed' WHEN batch % 8 = 0 AND n > 1 THEN 'movement repeated' WHEN doubt THEN 'reasons left' ELSE 'accepted' END AS status, n AS declarations FROM b""",
)
def confirm_by_person(spark, sf):
    """Customers as batches; numbers, sources and movements are wrong at other remainders. What machines
    had said (not verified, read by a model, blocked) no longer counts."""
    k, b = F.col("o_orderkey"), F.col("o_custkey")
    line = F.array(F.struct(F.lit("goods").alias("designation"), F.lit("847130").alias("code"), F.lit("2").alias("gross"), F.lit("1").alias("net"), F.lit("1 PX").alias("packages")))
    d = table(spark, sf, "orders").select(
        b.alias("batch"), k.alias("decl_id"), F.when(b % 8 == 0, _movement(b)).otherwise(_movement(k)).alias("mrn"), F.lit(False).alias("verified"), F.when(k % 9 != 0, "PMP 20260001").alias("dm"), F.array(F.lit("a")).alias("parties"), line.alias("lines"),
        F.lit("2").alias("total_gross"), F.lit("1").alias("total_packages"), F.lit("gap").alias("discrepancy"), F.lit(True).alias("model_used"), F.array().cast("array<string>").alias("evidence"), F.array(F.lit("blocked")).alias("blockers"), F.array(F.lit("page illisible")).alias("warnings"),
    )
    c = d.select("batch").distinct()
    path = F.concat(F.lit("in/"), F.col("batch").cast("string"), F.lit(".pdf")).alias("path")
    recorded = c.filter(F.col("batch") % 11 != 0).select("batch", path, F.lit("aa").alias("sha256"))
    present = c.select(path, F.when(F.col("batch") % 5 == 0, "bb").otherwise("aa").alias("sha256"))
    return completion.confirm_by_person(d, recorded, present, "someone").groupBy("batch", "status").agg(F.count("*").alias("declarations"))


@query(
    "review_sheets",
    """WITH d AS (SELECT o_custkey AS batch, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'M' || o_orderkey END AS mrn, '<' || o_orderstatus || ' & "' AS note FROM orders),
t AS (SELECT *, '{"decl_id":' || k || ',"mrn":"' || mrn || '","note":"' || replace(note, '"', '\\"') || '"}' AS j FROM d),
e AS (SELECT *, replace(replace(replace(j, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS h FROM t),
s AS (SELECT batch, string_agg('<h2>' || CASE WHEN mrn = '' THEN 'movement unknown' ELSE mrn END || '</h2><ul><li>a &gt; b</li></ul><pre>' || h || '</pre>', '' ORDER BY k) AS body, string_agg(j, ',' ORDER BY k) AS forms, string_agg('{"mrn":"' || mrn || '","reasons":["a > b"]}', ',' ORDER BY k) AS why FROM e GROUP BY batch)
SELECT batch, '{"version":1,"sources":[{"path":"' || batch || '.pdf","sha256":"aa"}],"reasons":[' || why || '],"declarations":[' || forms || ']}' AS form,
 '<!doctype html><meta charset="utf-8"><title>To verify</title><h1>To verify: not released</h1>' || body || '<h2>Source: ' || batch || '.pdf</h2>' AS sheet FROM s""",
)
def review_sheets(spark, sf):
    k, b = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf, "orders")
    d = o.select(b.alias("batch"), k.alias("decl_id"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("M"), k.cast("string"))).alias("mrn"), F.concat(F.lit("<"), "o_orderstatus", F.lit(' & "')).alias("note"), F.array(F.lit("a > b")).alias("reasons"))
    sources = o.select(b.alias("batch"), F.concat(b.cast("string"), F.lit(".pdf")).alias("path"), F.lit("aa").alias("sha256"))
    return completion.review_sheets(d, sources, "batch", "decl_id")


@query(
    "render_checks",
    """SELECT o_orderkey AS doc_id, concat_ws(';', CASE WHEN o_orderkey % 4 = 0 THEN 'fewer than two pages' END, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 'control box missing on the last page' END,
 CASE WHEN o_orderkey % 7 = 0 THEN 'text missing: no ' || o_orderkey || ' x' END, CASE WHEN o_orderkey % 5 = 0 THEN 'text off page 1' END) AS errors, o_orderkey % 6 <> 0 AS accents,
 o_orderkey % 6 <> 0 AND o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AS ok FROM orders""",
)
def render_checks(spark, sf):
    """One page or two; boxes, expected texts (broken over lines) and accents missing, words off the page."""
    k = F.col("doc_id")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    number = k.cast("string")
    first = F.concat(F.when(k % 6 != 0, "réf ").otherwise("ref "), F.when(k % 7 != 0, F.concat(F.lit("no\n"), number, F.lit(" x"))).otherwise(""))
    pages = o.select("doc_id", F.lit(1).alias("page"), first.alias("text"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"))
    pages = pages.unionByName(o.filter(k % 4 != 0).select("doc_id", F.lit(2).alias("page"), F.when(k % 3 != 0, "CONTRÔLE").otherwise("end").alias("text"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height")))
    words = o.select("doc_id", F.lit(1).alias("page"), F.lit(1.0).alias("x0"), F.lit(1.0).alias("y0"), F.when(k % 5 == 0, 100.5).otherwise(100.0).alias("x1"), F.lit(9.0).alias("y1"))
    expected = o.select("doc_id", F.concat(F.lit("no "), number, F.lit(" x")).alias("text")).unionByName(o.select("doc_id", F.lit(" ").alias("text")))
    return completion.render_checks(pages, words, expected).select("doc_id", F.array_join("errors", ";").alias("errors"), "accents", "ok")


@query(
    "corpus_cases",
    """SELECT 'c' || o_orderkey || '.pdf' AS source, CASE WHEN o_orderkey % 5 < 2 THEN 'not evaluated' WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 'differences' ELSE 'concordant' END AS status,
 CASE WHEN o_orderkey % 5 >= 2 THEN 2 END AS fields, CASE WHEN o_orderkey % 5 >= 2 THEN 2 - CAST(o_orderkey % 3 = 0 AS INTEGER) - CAST(o_orderkey % 7 = 0 AS INTEGER) END AS concordant,
 CASE WHEN o_orderkey % 5 >= 2 THEN concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'mass' END, CASE WHEN o_orderkey % 3 = 0 THEN 'mrn' END) END AS differing FROM orders""",
)
def corpus_cases(spark, sf):
    """Sources that are absent, there twice and there once; identifiers not read, masses a little off."""
    k = F.col("o_orderkey")
    source = F.concat(F.lit("c"), k.cast("string"), F.lit(".pdf")).alias("source")
    o = table(spark, sf, "orders")
    fields = lambda mrn, mass, value: F.explode(F.map_from_arrays(F.array(F.lit("mrn"), F.lit("mass")), F.array(mrn, mass))).alias("field", value)
    mass = o["o_totalprice"]
    cases = o.select(source, fields(_movement(k), mass.cast("string"), "expected"))
    read = o.select(source, fields(F.when(k % 3 != 0, _movement(k)), (mass.cast("double") + F.when(k % 7 == 0, 0.01).otherwise(0.000001)).cast("string"), "value"))
    files = o.filter(k % 5 != 0).select(F.concat(F.lit("/a/"), source).alias("path")).unionByName(o.filter(k % 5 == 1).select(F.concat(F.lit("/b/c/"), source).alias("path")))
    out = completion.corpus_cases(cases, files, read)
    return out.withColumn("differing", F.array_join("differing", ","))


def _four_sql() -> str:
    """The finder's rules written out again for the texts at hand."""
    has = lambda *p: " OR ".join(f"regexp_matches(low, '{x}')" for x in p)
    add = lambda *w: " + ".join(f"CASE WHEN {has(p)} THEN {n} ELSE 0 END" for p, n in w)
    pos = add(("document d.accompagnement[- ]?transit", 6), (r"\bgdrn\b", 3), ("d[ée]lai de transit", 3), ("bureau de destination", 2), (r"d[ée]claration de marchandises en transit", 6), (r"\btype\b[^\n]{0,40}\b(t1|t2|t2l|t2f)\b", 5))
    return f"""WITH a AS (SELECT page_id, lower(text) AS low FROM ({_PAGES_SQL})),
b AS (SELECT page_id, low, {pos} AS pos, {add(("eu export declaration", 8))} AS export, {add(("proforma invoice|commercial invoice|packing list", 5), ("air waybill", 3))} AS other FROM a)
SELECT page_id, CASE WHEN export >= 7 THEN 'EXPORT' WHEN pos >= 6 THEN 'TRANSIT' WHEN other >= 4 THEN 'AUTRE' ELSE 'INDETERMINE' END AS class,
 CASE WHEN export < 7 AND pos >= 6 THEN CASE WHEN {has(r"\bgdrn\b")} THEN 'TCH' ELSE 'T1/T2' END END AS kind, pos AS score_pos, export + other AS score_neg FROM b"""


@query("four_classes", _four_sql())
def four_classes(spark, sf):
    return _pages(spark, sf).select("page_id", classify.four_classes(F.col("text")).alias("v")).select("page_id", "v.class", "v.kind", "v.score_pos", "v.score_neg")


@query("json_balanced", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey + 1 END AS a FROM orders")
def json_balanced(spark, sf):
    """A fenced answer, one of two objects, one that never closes, and no object."""
    k = F.col("o_orderkey").cast("string")
    fenced = F.concat(F.lit('```json\n{"b": {"c": [{}]}, "a": '), k, F.lit("}\n```"))
    two = F.concat(F.lit('so {"a": '), (F.col("o_orderkey") + 1).cast("string"), F.lit('} and {"a": 0}'))
    r = F.col("o_orderkey") % 4
    text = F.when(r == 0, fenced).when(r == 1, two).when(r == 2, F.concat(F.lit('{"a": {'), k, F.lit("}"))).otherwise("nothing } here")
    return table(spark, sf, "orders").select("o_orderkey", F.try_variant_get(scalars.json_balanced(text), "$.a", "bigint").alias("a"))


@query("accent_key", "SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN lower(c_name) || ' eleve ' || lower(c_mktsegment) END AS key FROM customer")
def accent_key(spark, sf):
    name = F.concat(F.lit(" "), "c_name", F.lit("  \nÉlève "), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", scalars.accent_key(F.when(F.col("c_custkey") % 6 != 0, name)).alias("key"))
