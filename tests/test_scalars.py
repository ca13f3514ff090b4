from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as s


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


CASES = [
    (s.parse_number, [("2 126,0", 2126.0), ("1.3", 1.3), ("0,800", 0.8), ("144", 144.0), ("2.126", 2.126), ("1.234,5 kg", 1234.5), ("12d", None), ("", None), (None, None), ("abc", None)]),
    (s.parse_packages, [("2 PX", 2), ("3 colis", 3), ("2 PX marques 123", None), ("4", 4), (None, None)]),
    (s.date_fr, [("2026-07-24", "24.07.2026"), ("06.08.2026, 07:16", "06.08.2026"), ("24/07/2026", "24.07.2026"), ("soon", "soon")]),
    (s.clean_digits, [("30. 07. 2026", "30.07.2026"), ("14: 21: 51", "14:21:51"), ("2 126 kg", "2126 kg")]),
    (s.normalise_movement, [("26CHO7STTEST 000099", "26CH07STTEST000099"), ("26nl07sttest000018", "26NL07STTEST000018"), ("26CH|7STTEST", "26CH75TTEST"), ("26CHO7S", "26CHO7S")]),
    (s.clean_text, [(" a ,b ;  c. ", "a, b; c")]),
    (s.slug, [("DM 1/2", "DM_1_2"), ("///", "NCT")]),
    (s.confusion_key, [("OIZS", "0125")]),
    (s.repair_digits, [("O1 l8B", "01188")]),
    (s.model_text, [("N/A", None), ("0,00", None), ("5 kg", "5 kg")]),
    (s.package_cell, [("PK 3", "3 PK"), ("PK-3", "3 PK"), ("PC,1,1234500004", "1 PC"), ("PC 1234500004", None), ("nothing", None)]),
    (s.page_number, [("2", 2), ("0", None), ("x", None), ("true", None)]),
    (s.plausible_movement, [("26IS00000012345678", True), ("26TR00000012345678", True), ("26LI00000012345678", False), ("26XI00000012345678", False)]),
    (s.plausible_designation, [("steel pipes", True), ("abc", False), ("12 345,6", False), ("Gross weight", False), (None, False)]),
    (s.is_value, [("steel pipes", True), ("Consignee ACME", False), ("[12 01]", False), ("|||", False), (None, False)]),
]


@pytest.mark.parametrize("f,cases", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_scalars(spark, f, cases):
    for value, want in cases:
        assert one(spark, f, value) == want, value


def test_format_kg(spark):
    assert one(spark, s.format_kg, 1234567.891, "double") == "1 234 567,89 kg"
    assert one(spark, s.format_kg, 2.675, "double") == "2,67 kg"


def test_candidates(spark):
    get = lambda t: one(spark, s.movement_candidates, t)
    assert get("GDRN: 26CHO7STTEST 000099 ok") == ["26CH07STTEST000099"]
    assert get("21 IT REFERENTE 02074") == [] and get("short") == [] and get("") == []


def test_after_label(spark):
    get = lambda t: one(spark, lambda c: s.after_label(c, r"previous\s+document"), t)
    assert get("x Previous document [12 01] N821 ; 5") == "N821; 5" and get("plain") == "plain" and get("previous document") is None


def test_choose_movement(spark):
    def choose(candidates, reference):
        df = spark.createDataFrame([(candidates, reference)], "c array<string>, r string")
        return df.select(s.choose_movement(F.col("c"), F.col("r")).alias("y")).first().y

    far, near, other = "26IT99999999999999", "26IT00000001S00001", "26ITAB000001500001"
    assert choose([far, near, other], "26IT00000001500001") == near
    assert choose([other, far], None) == far and choose([other, far], "26FR11111111111111") == far and choose([], "x") is None


def test_spaces_of_all_kinds(spark):
    from ledgerloom.operators.classify import verdict

    v = lambda t: one(spark, verdict, t)
    assert v("transit\u00a0accompanying document").family == "TRANSIT_TAD"
    assert v("\u00a0\n\f").family == "INDETERMINE" and v("scan of swiss-app.dhl.com").family == "ENVELOPPE"


def test_announcement_and_identity(spark):
    a = one(spark, s.parse_announcement, "DM PMP 20260012")
    assert (a.year, a.sequence, a.prefixed) == (2026, 12, True)
    assert one(spark, s.parse_announcement, "DM 12") is None
    m, n = "26CH07STTEST000010", "26CH07STTEST000011"
    assert one(spark, s.identity, [n.lower(), m], "array<string>") == f"{m}|{n}"
    for bad in ([], [m, m], ["x"]):
        assert one(spark, s.identity, bad, "array<string>") is None


def test_distance(spark):
    df = spark.createDataFrame([("abc", "abd", 1), ("", "a", 99), ("a", "abcdef", 99)], "a string, b string, d int")
    assert all(r.d == r.x for r in df.withColumn("x", s.bounded_distance(F.col("a"), F.col("b"))).collect())
    assert spark.sql("SELECT timestamp'2025-12-31 23:30:00' AS t").select(s.year_in_zurich(F.col("t")).alias("y")).first().y == 2026
