"""Documents to a training corpus in five stages, each written as Parquet and reread by the next.

Quality classifier (documents scored under its threshold go), exact dedup (of equal texts one stays),
SimHash near-dedup over five-word shingles (of each component one stays), mixing sources to target
weights (rows repeat as the mix takes them), BPE encoding (adds token_ids and n_tokens).

Every stage keeps the columns of documents, others too, whatever their names (only token_ids and
n_tokens are replaced by the last). A null or blank text scores like an empty line; of texts equal but
for white space the one with most code points stays, then the smallest doc_id (nulls last), of rows
alike in both one; a null source is a source; very long texts are worked on whole; an empty table
gives an empty result of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, exact_dedup, mixing, quality, simhash
from ledgerloom.llm.common import Scratch, documents, hide, shown


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden, names = hide(docs, ("doc_id", "text"))
    model = quality.fit(hidden, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_documents(hidden, model)
    return shown(scored.filter(scored["score"] >= quality.THRESHOLD), names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: A conditional random field, SimHash links and BPE have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what lies between stages is kept in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
