"""One place for the session settings the engine is designed around."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: str = "*", memory: str = "6g", shuffle_partitions: int = 8) -> SparkSession:
    """A single-node session for tests and the bench; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("ledgerloom")
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    return (
        b.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """A driver table; the reader sees only columns a plan asks for."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
