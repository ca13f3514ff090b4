"""The watched folder as a stream: batches of files, each tried once per content.

Single-document folders give one result a file; a multi-document folder is one session and waits
until all its files are ready. The checkpoint remembers files; outputs are keyed by batch id, so a
batch run again after a failure writes the same place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, fmt: str = "parquet", archive: str | None = None) -> StreamingQuery:
    """Runs ``work`` on each batch of new files; ``every`` polls, without it what is there is done and
    the query ends. An error in one batch is the query's error: the checkpoint keeps the batch open."""
    reader = spark.readStream.format(fmt).schema(schema)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    writer = reader.load(folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(work)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def sessions(files: DataFrame, folder: str, at: str, ready: str, gap_seconds: int) -> DataFrame:
    """Batches of a multi-document folder: files that came within the gap of each other, n of them, and
    whether all are ready; a batch with one that is not waits as a whole."""
    w = F.session_window(F.col(at), f"{gap_seconds} seconds")
    agg = files.groupBy(folder, w).agg(F.count("*").alias("n"), F.bool_and(ready).alias("complete"))
    return agg.select(folder, F.col("session_window.start").alias("opened"), "n", "complete")


def not_yet_tried(files: DataFrame, tried: DataFrame) -> DataFrame:
    """Files whose (path, length, time) was not tried; a changed file is a new attempt."""
    return files.join(tried, ["path", "length", "modificationTime"], "left_anti")
