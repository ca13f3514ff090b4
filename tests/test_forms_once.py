from __future__ import annotations

import time

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as s


def test_candidates_overlap_and_long_texts_are_cleaned_once(spark):
    text = "26IT 26FR00000001500001 26CHO100000001500002 x26IT0000000150000"
    df = spark.createDataFrame([(text,), ("ab-" * 20_000 + "26IT00000001500003",), ("26IT0000",), (None,)], "t string")
    began = time.time()
    got = [r.c for r in df.select(s.movement_candidates(F.col("t")).alias("c")).collect()]
    # cleaning 60,000 characters anew at every start took minutes
    assert time.time() - began < 15
    assert got == [["26IT26FR0000000150", "26FR00000001500001", "26CH01000000015000"], ["26IT00000001500003"], [], None]
