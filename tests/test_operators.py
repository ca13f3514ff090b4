from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import aggregates, announce, classify, gate, joins, layout, registry
from ledgerloom.sources import files
from ledgerloom.streaming import watch

PAGES = [
    ("", "INDETERMINE"), ("Document d'accompagnement transit", "TRANSIT_TAD"), ("Elenco degli articoli - transito", "TRANSIT_LISTE"),
    ("Elenco degli articoli - transito UNIONE EUROPEA totale articoli 3", "TRANSIT_TAD"), ("EU export declaration", "EXPORT"), ("Annonce arrivage", "ANNONCE_CW"),
    ("Commercial invoice", "ANNEXE"), ("nombre d'enregistrements 4", "ENVELOPPE"), ("bureau de destination", "INDETERMINE"), ("bureau de destination GDRN", "TRANSIT_TAD"), ("GDRN", "INDETERMINE"),
    ("Déclaration de marchandises en transit national", "TRANSIT_TCH"),
]


def test_classifier(spark):
    df = classify.classify(spark.createDataFrame(PAGES, "text string, want string"))
    assert [(r.want, r.text) for r in df.collect() if r.family != r.want] == []


def test_fallback_reads_only_what_needs_it(spark):
    seen = []

    def again(df):
        seen.append({r.id for r in df.select("id").collect()})
        return df.withColumn("second_text", F.lit("EU export declaration"))

    rows = [(1, "Document d'accompagnement transit " + "x" * 40), (2, "note"), (3, None)]
    out = {r.id: (r.family, r.source) for r in classify.with_fallback(spark.createDataFrame(rows, "id int, text string"), again).collect()}
    assert seen == [{2, 3}] and out == {1: ("TRANSIT_TAD", "text"), 2: ("EXPORT", "second"), 3: ("EXPORT", "second")}


def words(spark, rows):
    return spark.createDataFrame([("f", 1, x, y, x + 20, y + 5, t) for x, y, t in rows], "file_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")


def test_lines_keep_their_first_anchor(spark):
    rows = words(spark, [(10.0, 100.0, "a"), (40.0, 104.0, "b"), (70.0, 106.0, "c"), (200.0, 100.0, "d"), (10.0, 112.0, "e")])
    lines = layout.group_lines(rows)
    by = {}
    for r in lines.collect():
        by.setdefault(r.line_no, []).append(r.text)
    assert sorted(map(sorted, by.values())) == [["a", "b", "d"], ["c"], ["e"]]
    cells = {r.text: r.x for r in layout.split_cells(lines).filter("line_no = 1").collect()}
    assert cells == {"a b": 10.0, "d": 200.0}


def test_column_band_and_page_size(spark):
    cells = layout.split_cells(layout.group_lines(words(spark, [(510.0, 185.0, "1.s00000"), (510.0, 198.0, "0.960000"), (60.0, 198.0, "5")])))
    assert [r.text for r in layout.column_band(cells, (500, 600)).collect()] == ["0.960000"]
    p = spark.range(1).select(layout.page_size(F.lit(841.68), F.lit(595.2), F.lit(90)).alias("p")).first().p
    assert (p.width, p.height) == (595.2, 841.68)


def test_interval_owner(spark):
    rows = [("f", 1, "TAD"), ("f", 2, "LISTE"), ("f", 3, "TAD"), ("f", 4, "LISTE")]
    out = joins.interval_owner(spark.createDataFrame(rows, "f string, page int, k string"), ["f"], ["page"], F.col("k") == "TAD", F.col("page"))
    assert [r.owner for r in out.orderBy("page").collect()] == [1, 1, 3, 3]


def test_unique_and_fuzzy_matches(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, k string")
    right = spark.createDataFrame([("a", 10), ("a", 10), ("b", 20), ("b", 21), (None, 5)], "k string, v int")
    assert {r.id: (r.v, r.status) for r in joins.unique_match(left, right, "k", "v").collect()} == {1: (10, "found"), 2: (None, "ambiguous"), 3: (None, "absent"), 4: (None, "absent")}
    a = spark.createDataFrame([(1, "26CH07STTEST000010"), (2, "26CH07STTEST0000I0"), (3, "26CH07STTEST000019"), (4, "zz")], "id int, n string")
    b = spark.createDataFrame([("26CH07STTEST000010",), ("26CH07STTEST555555",)], "n string")
    out = {r.id: (r.matched, r.how) for r in joins.fuzzy_unique(a, b, "id", "n").collect()}
    assert out == {1: ("26CH07STTEST000010", "exact"), 2: ("26CH07STTEST000010", "fuzzy"), 3: ("26CH07STTEST000010", "fuzzy"), 4: (None, "none")}


def test_outer_merge(spark):
    s = "k string, a string, d string"
    out = joins.outer_merge(spark.createDataFrame([("x", "1", "L"), ("", "2", None)], s), spark.createDataFrame([("x", "9", "R"), ("", "3", None)], s), "k", ["a", "d"], ("d",))
    assert sorted((r.k or "", r.a, r.d or "") for r in out.collect()) == [("", "2", ""), ("", "3", ""), ("x", "1", "R")]


def test_sums_are_all_or_nothing(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 1.0), (2, None)], "k int, v double")
    out = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(aggregates.sum_or_null(F.col("v")).alias("a"), aggregates.sum_or_zero(F.col("v")).alias("b")).collect()}
    assert out == {1: (3.0, 3.0), 2: (None, 0.0)}
    assert df.filter("k = 9").agg(aggregates.sum_or_null(F.col("v")).alias("a")).first().a is None


LINE = "array<struct<designation:string,code:string,gross:string,net:string,packages:string>>"
DECL = f"mrn string, verified boolean, dm string, parties array<string>, lines {LINE}, total_gross string, total_packages string, discrepancy string, model_used boolean, evidence array<string>, blockers array<string>, warnings array<string>"
GOOD = ("26CH07STTEST000010", True, "DM 123", ["p"], [("TEST", "12345678", "12 kg", "10 kg", "2")], "12 kg", "2", "", False, ["e"], [], [])


def test_gate(spark):
    def reasons(**change):
        names = [x.split()[0] for x in DECL.replace(LINE, "L").split(", ")]
        row = tuple(change.get(n, v) for n, v in zip(names, GOOD, strict=True))
        return gate.gate(spark.createDataFrame([row], DECL)).first().reasons

    assert reasons() == []
    assert reasons(verified=False, model_used=True) == ["identifier not corroborated", "model reading needs a person"]
    assert reasons(lines=[]) == ["no lines"]
    for mass in ("nan", "inf", "-1", "0", None):
        assert "line 1: gross mass missing or invalid" in reasons(lines=[("TEST", "12345678", mass, "10", "2")])
    assert reasons(total_gross="20", total_packages="3") == ["gross masses differ from the total", "packages differ from the total"]
    assert reasons(blockers=["x", "x"], warnings=["ok", "page illisible"]) == ["x", "page illisible"]
    assert reasons(lines=[("TEST", "12345678", "12", "13", "2 PX marques 1")], total_gross="12") == ["line 1: net mass over gross mass", "line 1: packages missing or ambiguous"]


def test_merge_and_paginate(spark):
    line = "array<struct<designation:string>>"
    rows = [("b", 1, "M1", "DM 1", [("x",)], 8.0, 4, ["p"]), ("b", 2, "M2", "DM 2", [("y",), ("z",)], None, 4, ["p", "q"])]
    out = announce.merge_declarations(spark.createDataFrame(rows, f"batch string, seq int, mrn string, dm string, lines {line}, gross double, packages int, parties array<string>"), "batch", "seq").first()
    assert [(x.no, x.designation) for x in out.lines] == [(1, "x [M1]"), (2, "y [M2]"), (3, "z [M2]")]
    assert (out.dm, out.mrns, out.gross, out.packages, out.parties) == ("DM 1", ["M1", "M2"], None, 8, ["p", "q"])
    pages = spark.createDataFrame([([10.0] * 10 + [95.0, 10.0, 200.0],)], "h array<double>").select(announce.paginate(F.col("h"), 8, 100.0).alias("p")).first().p
    assert pages == [1] * 8 + [2, 2, 3, 4, 5]


def test_registry(spark):
    m = [f"26CH07STTEST0000{k:02d}" for k in range(10, 20)]
    s = registry.empty(spark)
    with pytest.raises(registry.RegistryError):
        registry.allocate(s, m[:1], 2026, "op")
    s = registry.activate(s, 2026, 40, "op")
    with pytest.raises(registry.RegistryError):
        registry.activate(s, 2026, 41, "op")
    s, number, reused = registry.allocate(s, m[:2], 2026, "op")
    assert (number, reused) == ("20260041", False)
    assert registry.allocate(s, m[1::-1], 2026, "op")[1:] == ("20260041", True)
    assert registry.allocate(s, m[2:3], 2026, "op", simulate=True)[1] == ""
    for refs, year, kw in ((m[:1], 2026, {}), (m[1:3], 2026, {}), (m[3:4], 2025, {}), ([], 2026, {}), ([m[3]] * 2, 2026, {}), (m[3:4], 2026, {"existing": (2026, 99, False)})):
        with pytest.raises(registry.RegistryError):
            registry.allocate(s, refs, year, "op", **kw)
    with pytest.raises(registry.RegistryError):
        registry.allocate(s, m[3:4], 2026, " ")
    s, number, _ = registry.allocate(s, m[3:4], 2027, "op")
    assert number == "20270001"
    s, number, _ = registry.allocate(s, m[4:5], 2027, "op", existing=(2026, 12, True))
    assert number == "20260012" and s.journal.count() == 4
    s = registry.set_prefix(s, m[4], False, "op")
    assert s.announcements.filter("prefix").count() == 0


def test_ready_files_and_page_source(spark, tmp_path):
    body = b"%PDF-" + b" " * 100
    for name, data in (("a.pdf", body + b"%%EOF"), ("b.PDF", body), ("._c.pdf", body), ("d.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    out = {r.name: r.ok for r in files.list_files(spark, str(tmp_path)).select("name", files.complete(F.col("content")).alias("ok")).collect()}
    assert out == {"a.pdf": True, "b.PDF": False}
    spark.dataSource.register(files.PageSource)
    df = spark.read.format("docpages").option("paths", "one\ntwo").option("decoder", "builtins:list").load()
    assert [(r.file_id, r.page, r.text) for r in df.orderBy("file_id", "page").collect()][:4] == [("one", 1, "o"), ("one", 2, "n"), ("one", 3, "e"), ("two", 1, "t")]


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, log = tmp_path / "in", []
    spark.createDataFrame([(1,)], "x int").write.parquet(str(folder))
    run = lambda: watch.watch(spark, str(folder), "x int", lambda df, i: log.append(sorted(r.x for r in df.collect())), str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([(2,)], "x int").write.mode("append").parquet(str(folder))
    run()
    run()
    assert log == [[1], [2]]
    tried = spark.createDataFrame([("p", 1, 5)], "path string, length int, modificationTime int")
    files_now = spark.createDataFrame([("p", 1, 5), ("p", 2, 6), ("q", 1, 5)], tried.schema)
    assert watch.not_yet_tried(files_now, tried).count() == 2
