from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import extract, layout, reconcile

TCH = """GDRN: 26CHO7STTEST 000099
Déclaration acceptée : 30. 07. 2026
Référence: REF 12
Total emballages: 1O
Total masse brute (kg): 12,5
Expéditeur: Acme SA
Rue 1
1200 Genève
Destinataire: Beta
Bureau de destination: Centre"""


def first(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_national(spark):
    x = first(spark, extract.national, TCH)
    assert (x.mrn, x.packages, x.gross, x.office) == ("26CH07STTEST000099", "10", "12.5", "Centre")
    assert x.sender == ["Acme SA", "Rue 1", "1200 Genève"] and x.receiver == ["Beta"]
    assert first(spark, extract.national, "nothing").mrn is None


def test_waybill_and_forms(spark):
    x = first(spark, extract.waybill, "Shipment Content: Cotton shirts packages\nNet weight: 4.0\nGross weight 4.50 KG\nWAYBILL 12 3456 7890\nCustoms value: 10.00 CHF")
    assert (x.designation, x.net, x.gross, x.waybill, x.value) == ("Cotton shirts", "4.0", "4.50", "1234567890", "10. 00 CHF")
    x = first(spark, extract.arrival, "Annonce arrivage\nNo annonce DA 20260041\nNo. position 1\nMRN 26CH07STTEST000010\nNo. position 2\n MRN 26CH07STTEST000011\nDossier: S1")
    assert [(p.no, p.mrn) for p in x.positions] == [("1", "26CH07STTEST000010"), ("2", "26CH07STTEST000011")] and x.number == "20260041" and x.file == "S1"
    x = first(spark, extract.inventory, "Inventory request report 26CH07STTEST000010\nTotal packages 1O\nTotal items 2\n3.5000 4.12345")
    assert (x.mrn, x.packages, x.lines, x.page_masses) == ("26CH07STTEST000010", "10", "2", ["3.5000", "4.12345"])
    x = first(spark, extract.from_file_name, "DM PMP 20990102 - 26CH07STD0TEST0001.pdf")
    assert (x.mrn, x.dm) == ("26CH07STD0TEST0001", "DM PMP 20990102")
    x = first(spark, extract.remote_header, '{"MRN": "m", "movement_type": {"code": "A"}, "Customs-Status": {"code": "CL1"}, "arrival_date": null}')
    assert (x.mrn, x.movement, x.customs_status, x.arrival) == ("m", "A", "CL1", None)


def boxes(spark, rows):
    return layout.group_lines(spark.createDataFrame([("f", 1, x, y, x + 20, y + 5, t) for x, y, t in rows], "file_id string, page int, x0 double, y0 double, x1 double, y1 double, text string"))


def test_lines_of_both_lists(spark):
    page = spark.createDataFrame([("f", 1, 595.0, 842.0)], "file_id string, page int, width double, height double")
    rows = [(60.0, 110.0, "1"), (180.0, 110.0, "PC,3,1234500001"), (320.0, 110.0, "Cigares"), (510.0, 185.0, "1.s00000"), (510.0, 198.0, "0.960000"), (470.0, 210.0, "0.000000")]
    out = extract.form_lines(boxes(spark, rows), page, "(?i)label").collect()
    assert [(r.no, r.designation, r.packages, r.marks, r.gross, r.net) for r in out] == [("1", "Cigares", "3 PC", "1234500001", None, "0,96 kg")]
    rows = [(140.0, 260.0, "4;PX;1000001"), (285.0, 260.0, "IMPLANTS MEDICAUX"), (285.0, 270.0, "1;EXPO;26CH07STTEST000011;"), (285.0, 280.0, "1;N380;100001;"), (455.0, 369.0, "216"), (285.0, 386.0, "902190"), (455.0, 386.0, "180.2"), (455.0, 401.0, "0")]
    r = extract.list_lines(layout.split_cells(boxes(spark, rows)), page, "(?i)label").first()
    assert (r.designation, r.packages, r.code, r.gross, r.net) == ("IMPLANTS MEDICAUX", "4 PX", "902190", "216,00 kg", "180,20 kg")
    assert "EXPO" in r.prev_doc and "N380" in r.supporting


def test_code_check(spark):
    d = spark.createDataFrame([("a", 1, "M", None), ("b", 2, "x", "N"), ("c", 3, "x", None), ("d", 4, "P", None), ("d", 5, "z", None), ("e", 6, "Q", None)], "file_id string, decl_id int, mrn string, name_mrn string")
    c = spark.createDataFrame([("a", "M"), ("b", "N"), ("c", "K"), ("d", "P"), ("d", "R")], "file_id string, code string").withColumn("family", F.lit("TRANSIT_TAD"))
    out = {r.decl_id: (r.mrn, r.verified, r.blocked) for r in reconcile.code_check(d, c).collect()}
    assert out == {1: ("M", True, False), 2: ("N", True, False), 3: ("x", False, True), 4: ("P", True, False), 5: ("z", False, True), 6: ("Q", False, False)}


def test_waybill_for(spark):
    d = spark.createDataFrame([("f", 1, "26CH07STTEST000010", "ref 12345678901"), ("f", 2, "26NL", "")], "file_id string, decl_id int, mrn string, reference string")
    w = spark.createDataFrame([("f", 2, "9912345678", "", "x", "1", "2"), ("f", 3, "12345678", "", "y", "1", "2")], "file_id string, page int, waybill string, reference string, designation string, net string, gross string")
    assert {r.decl_id: r.designation for r in reconcile.waybill_for(d, w).collect()} == {1: "x", 2: None}


def test_merge_readings(spark):
    d = spark.createDataFrame([(k, "M", ["1234567890"]) for k in range(1, 5)], "decl_id int, mrn string, references array<string>")
    kind = "decl_id int, page int, type string, reference string, mrn string, awb string, printed string, pages string, lines array<string>, parties array<string>, total_gross string, total_packages string"
    read = lambda k, page, printed, ref="F1", awb="1234567890", total="12": (k, page, "facture", ref, "", awb, printed, "2", [f"l{printed}"], [], total, "")
    rows = [read(1, 5, "2"), read(1, 6, "1"), read(2, 1, "1"), read(3, 1, "1"), read(3, 2, "2", ref="F2"), read(4, 1, "1", awb="9999999999"), read(4, 2, "2", awb="999")]
    out = {r.decl_id: (r.status, r.lines, r.total_gross) for r in reconcile.merge_readings(spark.createDataFrame(rows, kind), d).collect()}
    assert out == {1: ("merged", ["l1", "l2"], "12"), 2: ("pages missing or repeated", None, None), 3: ("several documents", None, None), 4: ("none", None, None)}


def test_identifiers_and_batches(spark):
    d = spark.createDataFrame([(1, "a", "b", "DM 1", None), (2, "", "b", "", "DM 2"), (3, None, None, None, None)], "id int, mrn string, name_mrn string, dm string, name_dm string")
    out = {r.id: (r.mrn, r.dm, len(r.warnings)) for r in reconcile.resolve_identifiers(d).collect()}
    assert out == {1: ("a", "DM 1", 1), 2: ("b", "DM 2", 2), 3: (None, None, 2)}
    b = spark.createDataFrame([("x", 1, "M", []), ("x", 2, "M", []), ("y", 1, "M", []), ("z", 1, "M", ["r"]), ("w", None, None, [])], "batch string, decl_id int, mrn string, reasons array<string>")
    assert {r.batch: r.status for r in reconcile.batch_guard(b, "batch").collect()} == {"x": "refused", "y": "ready", "z": "to verify", "w": "nothing produced"}
