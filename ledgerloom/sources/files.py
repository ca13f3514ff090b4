"""Files as rows, when they are ready, and the pages inside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Names of files still being written.
TEMPORARY = r"(?i)^(\.|~\$)|\.(tmp|temp|part|partial|crdownload|download|filepart|swp|lock)$"
MIN_BYTES, STABLE_SECONDS = 64, 3


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length, modificationTime, content, sha256, sorted by path."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return df.withColumns({"name": name, "sha256": F.sha2("content", 256)}).filter(~name.rlike(r"^\._")).orderBy("path")


def complete(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 5), "ISO-8859-1")
    tail = F.decode(F.right(content, F.lit(2048)), "ISO-8859-1")
    return (head == "%PDF-") & F.contains(tail, F.lit("%%EOF"))


def ready(name: Column, length: Column, age_seconds: Column, stable: int = STABLE_SECONDS) -> Column:
    """The cheap part of readiness, for rows whose content is checked by ``complete``."""
    return ~name.rlike(TEMPORARY) & (length >= MIN_BYTES) & (age_seconds >= stable)


class PageSource(DataSource):
    """``docpages``: pages of documents through a pluggable decoder. Options: path (a folder listing in
    a text file, one path a line), decoder ("module:function" from path to page texts)."""

    @classmethod
    def name(cls) -> str:
        return "docpages"

    def schema(self) -> str:
        return "file_id string, page int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)


class _Pages(DataSourceReader):
    def __init__(self, options):
        self.paths, self.decoder = options["paths"].split("\n"), options["decoder"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, function = self.decoder.partition(":")
        decode: Callable[[str], list[str]] = getattr(importlib.import_module(module), function)
        for k, text in enumerate(decode(partition.value), 1):
            yield partition.value, k, text


def overrides(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """files with the declarations a person has read for the same SHA-256; a file without one, with an
    empty one or with an identifier twice in it has none."""
    schema = "sha256 string, dossiers array<struct<mrn:string,dm:string>>, methode string, pages array<int>"
    read = spark.read.schema(schema).option("multiLine", True).json(folder)
    mrns = F.filter(F.transform("dossiers", lambda d: d["mrn"]), lambda m: m != "")
    good = read.filter((F.size("dossiers") > 0) & (F.size(mrns) == F.size(F.array_distinct(mrns)))).dropDuplicates(["sha256"])
    return files.join(good, "sha256", "left")
