"""Incremental arrival of artifact observations as Structured Streaming jobs.

Each job reads new files, keeps its offsets below the shared checkpoint folder and writes a Parquet
table; ``availableNow`` processes what is there and stops, so a run equals the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.lifecycle import filled_dates, first_of
from ..session import fresh_path


def finished(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run ``stream`` over all that is available and read its output back."""
    out, offsets = fresh_path(spark, name), fresh_path(spark, f"{name}-offsets")
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", out).option("checkpointLocation", offsets)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def distinct_observations(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each ``keys`` combination once, for all time; the first that arrives stays."""
    return stream.dropDuplicates(keys)


def last_updates(stream: DataFrame, spark: SparkSession, name: str, keys: list[str]) -> DataFrame:
    """The last state of each key of an aggregate over all that is available, open windows included."""
    out, offsets = fresh_path(spark, name), fresh_path(spark, f"{name}-offsets")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", offsets)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.option("basePath", out).schema(stream.schema.add("batch", "long")).parquet(f"{out}/batch=*")
    return first_of(rows, keys, [F.desc("batch")]).select(*stream.columns)


def counts_per_window(stream: DataFrame, width: str, late: str | None, column: str) -> DataFrame:
    """Event counts in tumbling windows; rows later than ``late`` are not waited for, without it none is dropped."""
    timed = stream if late is None else stream.withWatermark("ts", late)
    return (
        timed.groupBy(F.window("ts", width), column)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("starts"), column, "n")
    )


KEYS = ("source_url", "sha256", "observed_at", "event_id")


def appended_versions(batch: DataFrame, latest: DataFrame | None) -> DataFrame:
    """Rows of a batch that change their URL's content, in order of observation.

    A row is a new version if its hash differs from the URL's previous one, in the batch or in ``latest``
    (one row per URL).
    """
    order = W.partitionBy("source_url").orderBy("observed_at", "event_id")
    before = F.lag("sha256").over(order)
    if latest is None:
        marked = batch.withColumn("_before", before)
    else:
        last = latest.select("source_url", F.col("sha256").alias("_last"))
        marked = batch.join(last, "source_url", "left").withColumn(
            "_before", F.coalesce(before, F.col("_last"))
        ).drop("_last")
    changed = F.col("_before").isNull() | (F.col("_before") != F.col("sha256"))
    return marked.filter(changed).drop("_before")


def versions(stream: DataFrame, spark: SparkSession, name: str = "versions") -> DataFrame:
    """New versions of every URL, batch by batch, each batch compared with the latest version per URL.

    A batch writes its versions and the next snapshot of latest rows to folders of its own, so a
    repeated batch replaces its rows instead of adding them, and only one snapshot is read per batch.
    """
    out, offsets = fresh_path(spark, name), fresh_path(spark, f"{name}-offsets")
    snapshots = fresh_path(spark, f"{name}-latest")

    def keep(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        latest = session.read.parquet(f"{snapshots}/{number - 1}") if number else None
        appended_versions(batch, latest).write.mode("overwrite").parquet(f"{out}/batch={number}")
        rows = session.read.schema(batch.schema).parquet(f"{out}/batch={number}").select(*KEYS)
        merged = rows if latest is None else latest.unionByName(rows)
        first_of(merged, ["source_url"], [F.desc("observed_at"), F.desc("event_id")]).write.mode(
            "overwrite"
        ).parquet(f"{snapshots}/{number}")

    query = (
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", offsets)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def backfilled(found: DataFrame, meetings: DataFrame, spark: SparkSession, name: str = "backfill") -> DataFrame:
    """``meetings`` with missing dates filled from a stream of ``(meeting_id, place, starts_on, ends_on)``.

    All dates that arrived are kept; of a meeting's dates the one with the smallest place counts, whatever
    the order of arrival. Known dates stay.
    """
    arrived = finished(found, spark, name)
    first = arrived.groupBy("meeting_id").agg(
        F.min_by(F.struct("starts_on", "ends_on"), "place").alias("d")
    ).select("meeting_id", "d.*")
    return filled_dates(meetings, first)
