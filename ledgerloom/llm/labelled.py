"""Bounded training samples of labelled documents, and the split into folds.

A sample has at most ``per_class`` rows of each class and, in order of the hash that picks them, as
many whole texts as ``SAMPLE_BYTES`` hold; of copies among them one counts."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labelled rows of each class that a classifier is fitted on, at most.
PER_CLASS = 2_000
#: Bytes of text of each class that go to the driver, at most.
SAMPLE_BYTES = 64 << 20


def held_out(doc_id: Column) -> Column:
    """Fold 0 of five by CRC-32 of the id as text; a null id is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int = PER_CLASS) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) of at most per_class rows of each class that are not held out, those of least
    hash of the doc_id, and how many rows each class has. The ids are taken before texts are joined,
    and a doc_id gives one text (the least of several), so what goes to the driver is bounded."""
    ok = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ok = ok.groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in ok.groupBy("label").count().collect()}
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 1)
    picked = None
    for label in sorted(counts):
        some = ok.filter(F.col("label") == label).orderBy(h, "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return [], counts
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    used = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(W.partitionBy("label").orderBy(h, "doc_id"))
    rows = texts.withColumn("_used", used).filter(F.col("_used") <= SAMPLE_BYTES).select("doc_id", "label", "text").collect()
    rows = sorted(((r.label, r.doc_id, r.text or "") for r in rows))
    out: list[tuple[str, int]] = []
    for label in counts:
        out += [(text, label) for x, _, text in rows if x == label]
    return without_copies(out), counts


def without_copies(sample: list[tuple[str, int]], shingle: int = 5, draws: int = 3) -> list[tuple[str, int]]:
    """The sample without texts that share one of their least shingle hashes with an earlier one: near
    copies would pass for many independent witnesses of the words in them."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, label in sample:
        words = text.split()
        hashes = [xxhash.xxh3_64_intdigest(" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))]
        keys = {(k, min((h * m) & 0xFFFFFFFFFFFFFFFF for h in hashes)) for k, m in zip(range(draws), (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), strict=True)}
        if not keys & seen:
            out.append((text, label))
        seen |= keys
    return out
