"""Sharding by a hierarchical weighted hash tree (law ``key``).

A fleet is a tree of regions, racks and shards. A document descends it: at each level every child
draws -ln(u)/weight with u hashed from (doc_id, child) and the least draw wins, so a child gets
its share of the weight, and a changed weight moves documents only into or out of the subtree
whose weight changed. A shard that joins as a region of its own therefore takes documents only
into itself (``Fleet.grow``); one that joins an existing rack (``Fleet.grow_within``) raises that
rack's and that region's weight and movement stays confined to them.

Only doc_id and the fleet decide. Nulls: a null doc_id hashes as the empty string, a null text
has size 1 and the checksum of no bytes. Repeated rows go to the same shard and take slots of
their own. An empty table gives an empty result. Columns beside id and text are not looked at, so
clashing names cannot arise. Equal texts need not meet: under law ``key`` they may not.

Everything is a Column expression: no Python runs on executors. Slots are gapless without sorting
a shard in one task: a shard is cut into hash buckets, their counts (shards x buckets rows, a
bound set by the parameters) are summed into offsets, and rows are numbered inside a bucket.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, draw52, sql_draw52, sql_uniform, uniform

#: Buckets of a shard for numbering; raise it with the rows of a shard (about a million rows each).
BUCKETS = 1024


@dataclass(frozen=True)
class Fleet:
    """regions[r][k] = ((shard, weight), ...) of rack k in region r."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @classmethod
    def uniform(cls, shards: int = 8, racks: int = 2, per_rack: int = 2) -> Fleet:
        ids, per_region = list(range(shards)), racks * per_rack
        return cls(
            tuple(
                tuple(tuple((s, 1.0) for s in ids[k : min(k + per_rack, r + per_region, shards)]) for k in range(r, min(r + per_region, shards), per_rack))
                for r in range(0, shards, per_region)
            )
        )

    @property
    def shards(self) -> list[int]:
        return [s for region in self.regions for rack in region for s, _ in rack]

    def grow(self, weight: float = 1.0) -> Fleet:
        """One more shard, as a region of its own."""
        return replace(self, regions=(*self.regions, (((max(self.shards) + 1, weight),),)))

    def grow_within(self, region: int, rack: int, weight: float = 1.0) -> Fleet:
        """One more shard in an existing rack."""
        new = (max(self.shards) + 1, weight)
        racks = tuple((*x, new) if k == rack else x for k, x in enumerate(self.regions[region]))
        return replace(self, regions=tuple(racks if r == region else x for r, x in enumerate(self.regions)))

    def weights(self) -> tuple[list[float], list[list[float]]]:
        racks = [[sum(w for _, w in rack) for rack in region] for region in self.regions]
        return [sum(x) for x in racks], racks


def _choose(doc: Column, level: str, names: list[str], weights: list[float]) -> Column:
    """The position of the child with the least draw; the only child needs none."""
    if len(names) == 1:
        return F.lit(0)
    draws = [F.struct((-F.log(uniform(doc, F.lit(f"{level}{n}"))) / F.lit(float(w))).alias("d"), F.lit(i).alias("i")) for i, (n, w) in enumerate(zip(names, weights, strict=True))]
    return F.array_min(F.array(*draws)).getField("i")


def _switch(on: Column, cases: list[Column]) -> Column:
    if len(cases) == 1:
        return cases[0]
    out = F.when(on == 0, cases[0])
    for i, c in enumerate(cases[1:], 1):
        out = out.when(on == i, c)
    return out


def place(df: DataFrame, fleet: Fleet, out: str, id_col: str = "doc_id") -> DataFrame:
    """df with the shard of each row in column ``out``; a level's choice is a column of its own, so
    only the chosen subtree's draws are made."""
    top, racks = fleet.weights()
    doc = F.col(id_col)
    df = df.withColumn("_region", _choose(doc, "region", [str(r) for r in range(len(top))], top))
    df = df.withColumn("_rack", _switch(F.col("_region"), [_choose(doc, f"rack{r}.", [str(k) for k in range(len(x))], x) for r, x in enumerate(racks)]))
    leaf = [
        _switch(F.col("_rack"), [F.element_at(F.array(*[F.lit(s) for s, _ in rack]), _choose(doc, "shard", [str(s) for s, _ in rack], [w for _, w in rack]) + 1) for rack in region])
        for region in fleet.regions
    ]
    return df.withColumn(out, _switch(F.col("_region"), leaf).cast("int")).drop("_region", "_rack")


def shard_documents(docs: DataFrame, fleet: Fleet, grown: Fleet | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    assert buckets & (buckets - 1) == 0, "buckets must be a power of two"
    grown = grown or fleet.grow()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    base = place(base, fleet, "shard")
    base = base.withColumn("_bucket", F.shiftright(draw52(F.col("doc_id"), F.lit("slot")), 52 - buckets.bit_length() + 1).cast("int"))
    # at most shards x buckets rows: small enough to send to every task whatever the table's size
    counts = base.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = base.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(offsets), ["shard", "_bucket"])
    numbered = place(numbered, grown, "grown_shard")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_offset") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), Fleet.uniform(8))


def _sql_choose(level: str, names: list[str], weights: list[float]) -> str:
    if len(names) == 1:
        return "0"
    draws = [f"(-ln({sql_uniform('doc_id', f"'{level}{n}'")}) / {float(w)})" for n, w in zip(names, weights, strict=True)]
    least = f"least({', '.join(draws)})"
    return f"CASE {least} " + " ".join(f"WHEN {d} THEN {i}" for i, d in enumerate(draws)) + " END"


def _sql_switch(on: str, cases: list[str]) -> str:
    return cases[0] if len(cases) == 1 else f"CASE {on} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


def _sql_place(source: str, fleet: Fleet, out: str) -> str:
    top, racks = fleet.weights()
    rack = _sql_switch("_region", [_sql_choose(f"rack{r}.", [str(k) for k in range(len(x))], x) for r, x in enumerate(racks)])
    leaf = _sql_switch("_region", [_sql_switch("_rack", [f"([{', '.join(str(s) for s, _ in x)}])[({_sql_choose('shard', [str(s) for s, _ in x], [w for _, w in x])}) + 1]" for x in region]) for region in fleet.regions])
    one = f"(SELECT *, {_sql_choose('region', [str(r) for r in range(len(top))], top)} AS _region FROM {source})"
    two = f"(SELECT *, {rack} AS _rack FROM {one})"
    return f"(SELECT * EXCLUDE (_region, _rack), CAST({leaf} AS INTEGER) AS {out} FROM {two})"


#: CRC-32 byte by byte: eight shifts with the reflected polynomial 0xEDB88320.
_STEP = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
_BYTE_TABLE = "(SELECT list(crc ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda c, k: " + _STEP + ", b) AS crc FROM range(256) r(b)))"
_CRC = (
    "xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)), "
    "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
)


def op4_sql() -> str:
    fleet = Fleet.uniform(8)
    base = f"(SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, CAST({_CRC} AS BIGINT) AS text_crc32 FROM documents, {_BYTE_TABLE})"
    both = _sql_place(_sql_place(base, fleet, "shard"), fleet.grow(), "grown_shard")
    bucket = f"({sql_draw52('doc_id', "'slot'")} >> 42)"
    return (
        f"SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY {bucket}, doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard FROM {both}"
    )
