"""Declarations made from orders and completed from other sources; the SQL states what each should become."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import announce, layout, reconcile
from ..session import table
from .catalogue import query

_K12 = "lpad(CAST(o_orderkey AS VARCHAR), 12, '0')"


def _orders(spark, sf, *more):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("decl_id"), *more), F.lpad(F.col("decl_id").cast("string"), 12, "0")


@query(
    "header_apply",
    f"""SELECT o_orderkey AS decl_id, o_orderkey % 3 <> 0 AS verified, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN 'L' || o_orderkey ELSE 'DM 1' END AS dm,
 CASE WHEN o_orderkey % 3 <> 0 THEN 'Date d''arrivée=' || strftime(o_orderdate, '%d.%m.%Y') || ' 10:20;Statut douane=' || o_orderstatus || ';Type de mouvement=AV (arrivée)' ELSE '' END AS facts,
 CASE WHEN o_orderkey % 3 = 0 THEN 'announcement number missing;no header of this movement' WHEN o_orderkey % 5 = 0 THEN 'announcement number missing;header completed' ELSE 'header completed' END AS warnings FROM orders""",
)
def header_apply(spark, sf):
    """One header in three is of another movement, one in five names no announcement."""
    d, n = _orders(spark, sf)
    d = d.select("decl_id", F.concat(F.lit("26CH07"), n).alias("mrn"), F.lit("DM 1").alias("dm"), F.array(F.lit("announcement number missing")).alias("warnings"))
    h, n = _orders(spark, sf, "o_orderdate", "o_orderstatus")
    k = F.col("decl_id")
    h = h.select(
        F.concat(F.when(k % 3 == 0, "25").otherwise("26"), F.lit("CH07"), n).alias("mrn"), k.cast("string").alias("key"), F.when(k % 5 != 0, F.concat(F.lit("L"), k.cast("string"))).alias("lrn"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:20:00")).alias("arrival"), F.col("o_orderstatus").alias("customs_status"), F.lit("").alias("phase"), F.lit(None).cast("string").alias("office"), F.lit("AV").alias("movement"),
    )
    facts = F.array_join(F.transform("facts", lambda x: F.concat(x["label"], F.lit("="), x["value"])), ";")
    return reconcile.apply_headers(d, h).select("decl_id", "verified", "dm", facts.alias("facts"), F.array_join("warnings", ";").alias("warnings"))


@query(
    "waybill_fallback",
    """SELECT o_orderkey AS decl_id, CASE WHEN o_custkey % 4 = 1 THEN '987654' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS waybill, o_custkey % 4 = 2 AS several_notes FROM orders""",
)
def waybill_fallback(spark, sf):
    """Files (customers) without a note, with one, with two, and with one beside two national pages."""
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("decl_id"), F.concat(F.lit("26CH07ST"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("mrn"), F.lit("").alias("reference"))
    files = table(spark, sf, "customer").select(F.col("c_custkey").alias("file_id"))
    kind = F.col("file_id") % 4
    page = F.explode(F.when(kind == 2, F.array(F.lit(1), F.lit(2))).when(kind == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))))
    notes = files.select("file_id", page.alias("page")).select("file_id", "page", F.concat(F.when(F.col("page") == 1, "987654").otherwise("876543"), F.lpad(F.col("file_id").cast("string"), 6, "0")).alias("waybill"), F.lit("").alias("reference"), F.lit("goods").alias("designation"), F.lit("1").alias("net"), F.lit("2").alias("gross"))
    pages = files.select("file_id", F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("page"), F.lit("TRANSIT_TCH").alias("family"))
    return reconcile.waybill_fallback(d, notes, pages).select("decl_id", "waybill", "several_notes")


@query(
    "finalise",
    f"""SELECT o_orderkey AS decl_id, CASE WHEN o_orderkey % 4 > 1 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN 'high' ELSE 'low' END AS confidence,
 CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'abc' ELSE '26CH07' || {_K12} END AS file, strftime(o_orderdate, '%d.%m.%Y') AS date,
 CASE WHEN o_orderkey % 4 < 2 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS warnings FROM orders""",
)
def finalise(spark, sf):
    """Movements missing, malformed and good; numbers, goods and totals missing at other remainders."""
    d, n = _orders(spark, sf, "o_orderdate")
    k, none = F.col("decl_id"), F.lit(None).cast("string")
    d = d.select(
        "decl_id", F.when(k % 4 == 0, none).when(k % 4 == 1, "abc").otherwise(F.concat(F.lit("26CH07"), n)).alias("mrn"), F.when(k % 5 != 0, "DM 1").alias("dm"), none.alias("date"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("file_date"),
        none.alias("file"), F.array(F.struct(F.when(k % 3 == 0, " ").otherwise("goods").alias("designation"))).alias("lines"), none.alias("goods_source"), (k % 7 == 0).alias("incomplete"), (k % 11 == 0).alias("gap"), F.array().cast("array<string>").alias("warnings"),
    )
    return reconcile.finalise(d).select("decl_id", "confidence", "file", "date", F.size("warnings").alias("warnings"))


@query(
    "keep_new",
    """WITH f AS (SELECT l_suppkey, l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'MRN' ELSE l_returnflag END AS label, l_linestatus AS value FROM lineitem)
SELECT l_suppkey, label, value, CASE WHEN label = 'MRN' THEN count(*) ELSE 1 END AS n, min(l_orderkey) AS first_order FROM f GROUP BY l_suppkey, label, value""",
)
def keep_new(spark, sf):
    """Suppliers as batches, flags as labels: one of them stands for identifiers and always stays."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "MRN").otherwise(F.col("l_returnflag")).alias("label"), F.col("l_linestatus").alias("value"))
    return announce.keep_new(li, "l_suppkey", ["l_orderkey", "l_linenumber"]).groupBy("l_suppkey", "label", "value").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


@query(
    "words_from_xml",
    """SELECT o_orderkey, CAST(1.5 AS DOUBLE) AS x0, CAST(o_orderkey AS DOUBLE) AS y0, 'A & "' || o_orderstatus || '" <' || o_orderkey || '>' AS text FROM orders UNION ALL SELECT o_orderkey, CAST(30 AS DOUBLE), CAST(o_orderkey AS DOUBLE), 'l''or &lt;' FROM orders""",
)
def words_from_xml(spark, sf):
    """Two words of every order, all five entities, one of them written twice over."""
    k = F.col("o_orderkey").cast("string")
    box = lambda x, text: F.concat(F.lit(f'<word xMin="{x}" yMin="'), k, F.lit('.0" xMax="50.0" yMax="60.0">'), text, F.lit("</word>\n"))
    xml = F.concat(F.lit("<page>"), box("1.5", F.concat(F.lit("A &amp; &quot;"), F.col("o_orderstatus"), F.lit("&quot; &lt;"), k, F.lit("&gt;"))), box("30.0", F.lit("l&apos;or &amp;lt;")), F.lit("</page>"))
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), F.lit(1).alias("page"), xml.alias("xml"))
    return layout.words_from_xml(pages).select(F.col("file_id").alias("o_orderkey"), "x0", "y0", "text")


@query(
    "clean_announcement",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'PMP 2026' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') WHEN 1 THEN 'DM PMP 2026' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') ELSE 'S 1230' || (o_orderkey % 10) END AS number FROM orders",
)
def clean_announcement(spark, sf):
    """Numbers with a colon read into them, alone and after other letters (which stay), and others."""
    k = F.col("o_orderkey")
    pmp = F.concat(F.lit("PMP 20: 26"), F.lpad(k.cast("string"), 7, "0"))
    raw = F.when(k % 3 == 0, pmp).when(k % 3 == 1, F.concat(F.lit("DM "), pmp)).otherwise(F.concat(F.lit(" S 123 : 0"), (k % 10).cast("string"), F.lit(" .")))
    return table(spark, sf, "orders").select("o_orderkey", scalars.clean_announcement(raw).alias("number"))


@query("route", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Prets_a_remettre' ELSE 'A_verifier' END || '/n' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '_0900' ELSE '' END || '.pdf' AS path FROM orders")
def route(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", announce.route(F.when(F.col("o_orderstatus") == "F", "ready").otherwise("to verify"), F.concat(F.lit("n"), k.cast("string")), k % 2 == 0, F.lit("0900")).alias("path"))


@query("journal", "SELECT o_custkey, string_agg('order ' || o_orderkey || ' ' || o_orderstatus, chr(10) ORDER BY o_orderkey) AS report FROM orders GROUP BY o_custkey")
def journal(spark, sf):
    line = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderstatus")
    return announce.journal(table(spark, sf, "orders").select("o_custkey", "o_orderkey", line.alias("line")), "o_custkey", ["o_orderkey"])


@query("wrap")
def wrap(spark, sf):
    """Names of parts in lines of 9 characters; tested against a loop in Python."""
    return table(spark, sf, "part").select("p_partkey", "p_name", F.array_join(announce.wrap(F.col("p_name"), 9), "\n").alias("lines"))
