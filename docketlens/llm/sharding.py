"""Contiguous byte-balanced shards from global prefix sums, in DataFrame operations only.

Rows are range-partitioned by id as narrow rows (id, size, checksum), never as texts. Per-partition
totals (one row per partition) give each partition's global offset; a running sum inside the
partition completes every row's global byte position. A row goes to the shard in whose equal share
of all bytes its middle byte falls, so shards are contiguous in id order and differ by at most about
one row. The same totals per partition and shard number the slots of a shard without a gap.

The law is ``bytes``: sizes are near equal, and equal texts are not kept together across a cut. Size
is the text's UTF-8 bytes plus 1 (a null text has 1 and checksum 0). Null ids come first; ties of id
are ordered by size and checksum, and rows equal in all three are interchangeable. An empty table
gives an empty result; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common

SHARDS = 8


def _offsets(totals: DataFrame, order: list[str], within: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums over a table of one row per partition (and shard)."""
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    if within:
        before = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        "*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in sums.items()]
    )


def assign_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """``(doc_id, text)`` rows to ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32")
    )
    order = ["doc_id", "size", "text_crc32"]
    # The cut ranges must be the same for the totals and for the rows, so they are written once.
    ranged = cut_lineage(
        narrow.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"))
    placed = _offsets(totals, ["part"], [], {"bytes_before": "bytes"}).withColumn(
        "all_bytes", F.sum("bytes").over(W.partitionBy())
    )
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    running = ranged.withColumn("upto", F.sum("size").over(inside)).join(
        F.broadcast(placed.drop("bytes")), "part"
    )
    # Twice the middle byte against twice the total keeps the arithmetic in whole numbers.
    middle = (F.col("bytes_before") + F.col("upto")) * 2 - F.col("size")
    shard = F.least(
        F.expr("cast(middle * shards div (2 * all_bytes) as int)"), F.lit(shards - 1)
    )
    sharded = running.withColumns({"middle": middle, "shards": F.lit(shards).cast("long")}).withColumn(
        "shard", shard
    )
    counts = sharded.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("rows"))
    begins = _offsets(counts, ["part"], ["shard"], {"rows_before": "rows"}).drop("rows")
    rank = F.row_number().over(W.partitionBy("part", "shard").orderBy(*order))
    return (
        sharded.withColumn("rank", rank)
        .join(F.broadcast(begins), ["part", "shard"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("rows_before") + F.col("rank") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write ``docs`` below ``path`` as one folder per shard, each sorted by slot."""
    placed = assign_shards(docs, shards).select("doc_id", "shard", "slot").dropDuplicates(["doc_id"])
    joined = docs.join(placed, docs["doc_id"].eqNullSafe(placed["doc_id"])).select(
        *[docs[c] for c in docs.columns], placed["shard"], placed["slot"]
    )
    (
        joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot")
        .write.partitionBy("shard").parquet(path)
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(common.table(spark, sf_dir, "documents"))
