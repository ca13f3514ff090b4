"""What the training-data operators share: scratch tables, draws, text rules."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators everywhere here: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or (only where that is unset, as in
    tests on one machine) a temporary folder that is set as the checkpoint folder."""
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir"):
        return at
    app = sc.applicationId
    if app not in _own:
        _own[app] = sc.getCheckpointDir() or ""
        if not _own[app]:
            folder = tempfile.mkdtemp(prefix="ledgerloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own[app] = f"file://{folder}"
        sc.setCheckpointDir(_own[app])
    return _own[app]


def hide(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with every column that is not used renamed, so that no name of it can clash, and the
    names they had by the ones they have now."""
    safe = [c if c in used else f"_x_c{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*safe), dict(zip(safe, docs.columns, strict=True))


def shown(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of hidden docs under the names they had."""
    return df.select(*[F.col(s).alias(n) for s, n in names.items()])


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor costs a reread, not a rerun."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        try:
            drop_path(self.spark, self.path(name) if name else self.root)
        except Exception as e:  # the JVM is gone at exit
            if name:
                raise e


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps now rather than at some later collection. The
    cleaner works beside the driver: it is given a moment, and a second round for what the first freed."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def draw52(*parts: Column) -> Column:
    """A 52-bit integer drawn from md5 of the parts; null counts as the empty string."""
    key = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """The same draw as a double strictly between 0 and 1."""
    return (draw52(*parts).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def sql_draw52(*parts: str) -> str:
    key = " || '|' || ".join(f"coalesce(cast({p} AS VARCHAR), '')" for p in parts)
    return f"CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT)"


def sql_uniform(*parts: str) -> str:
    return f"((CAST({sql_draw52(*parts)} AS DOUBLE) + 0.5) / 4503599627370496.0)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
