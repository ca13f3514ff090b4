from __future__ import annotations

import os
from collections import Counter, defaultdict

import pytest

from ledgerloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_every_line_gets_its_page(spark):
    docs = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        docs[r.l_suppkey].append((r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_quantity))
    want = Counter()
    for doc, lines in docs.items():
        page, n, room = 1, 0, 0.0
        for *_, h in sorted(lines):
            if n and (n >= 8 or room + h > 120.0):
                page, n, room = page + 1, 0, 0.0
            n, room = n + 1, room + h
            want[doc, page] += 1
        if n > 1 and room + 30.0 > 120.0:  # the closing block needs room below the last page's lines
            want[doc, page] -= 1
            want[doc, page + 1] += 1
    assert {(r.doc, r.page): r.lines for r in catalogue.QUERIES["paginate_all"](spark, SF).collect()} == dict(want)
