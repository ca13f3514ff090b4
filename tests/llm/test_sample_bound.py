from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.llm import labelled


def test_sample_is_of_least_hash_and_one_row_a_document(spark):
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    words = F.concat_ws(" ", *[F.xxhash64("doc_id", F.lit(k)).cast("string") for k in range(6)])
    docs = labels.select("doc_id", words.alias("text"))
    got, _ = labelled.training_sample(docs.unionByName(docs), labels, "toxic", 100)
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 1)
    ok = docs.join(labels, "doc_id").filter(~labelled.held_out(F.col("doc_id")))
    want = {r.text for y in (0, 1) for r in ok.filter(F.col("toxic") == y).orderBy(h).limit(100).collect()}
    assert len(got) == 200 and {t for t, _ in got} == want
