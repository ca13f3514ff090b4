from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerloom.operators import announce, reconcile


def by_loop(text, most):
    words = [w[i : i + most] for w in text.split(" ") for i in range(0, len(w), most)]
    lines, line = [], ""
    for w in words:
        if not line or len(line) + 1 + len(w) <= most:
            line = f"{line} {w}".strip()
        else:
            lines.append(line)
            line = w
    return [*lines, line]


def test_wrap_equals_a_loop(spark):
    draw = random.Random(3)
    texts = ["", " ", "word", "exactly10c exactly10c", "averyveryverylongword x"] + ["".join(draw.choices("abcé   ", k=draw.randrange(80))) for _ in range(200)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", announce.wrap(F.col("t"), 10).alias("w")).collect()
    assert [(r.t, r.w) for r in out] == [(t, by_loop(t, 10)) for t in texts]


def test_fallback_prefers_the_own_note(spark):
    d = spark.createDataFrame([("f", 1, "26CH07ST0987654321", "")], "file_id string, decl_id int, mrn string, reference string")
    kind = "file_id string, page int, waybill string, reference string, designation string, net string, gross string"
    p = spark.createDataFrame([("f", 1, "TRANSIT_TCH"), ("f", 2, "TRANSIT_TCH")], "file_id string, page int, family string")
    own, other = ("f", 3, "987654321", "", "own", "1", "2"), ("f", 4, "11112222", "", "other", "1", "2")
    assert [(r.designation, r.several_notes) for r in reconcile.waybill_fallback(d, spark.createDataFrame([own], kind), p).collect()] == [("own", False)]
    assert [(r.designation, r.several_notes) for r in reconcile.waybill_fallback(d, spark.createDataFrame([own, other], kind), p).collect()] == [(None, True)]
    assert [(r.designation, r.several_notes) for r in reconcile.waybill_fallback(d, spark.createDataFrame([], kind), p).collect()] == [(None, False)]
