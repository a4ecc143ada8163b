"""Content-addressed store: every content once, under its own SHA-256.

Contents are rows ``sha256, size, content`` below a folder, partitioned by the first two digits of the
digest. Writing is idempotent: contents that are there already, or come several times, add nothing.
Reading recomputes every digest; what does not match is a reject, not a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

_STORED = "sha256 string, size long, content binary, prefix string"


def object_key(sha256: Column, name: Column) -> Column:
    """``sha256/ab/<digest>/<name>``; path separators in the name give way."""
    return F.concat_ws("/", F.lit("sha256"), F.substring(sha256, 1, 2), sha256, F.regexp_replace(name, r"[/\\]", "_"))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``name, path, size, content, sha256`` of every file below a folder; Spark's reader passes over empty files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size"), "content",
        F.sha2("content", 256).alias("sha256"),
    )


def stored(spark: SparkSession, root: str) -> DataFrame:
    """All contents; none before the first write."""
    try:
        return spark.read.schema(_STORED).parquet(root)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], _STORED)


def put(contents: DataFrame, root: str) -> int:
    """Add the ``content`` rows whose digest is not stored yet; gives their number. Null contents are left out.

    Digests are compared first, and a content counts once per digest, so a repeated batch writes nothing.
    """
    spark = contents.sparkSession
    rows = contents.filter("content is not null").select(F.sha2("content", 256).alias("sha256"), "content")
    fresh = rows.join(stored(spark, root).select("sha256"), "sha256", "left_anti")
    once = fresh.groupBy("sha256").agg(F.first("content").alias("content"))
    new = cut_lineage(once.select("sha256", F.octet_length("content").cast("long").alias("size"), "content",
                                  F.substring("sha256", 1, 2).alias("prefix")))
    count = new.count()
    if count:
        new.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(root)
    return count


def checked(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """``manifest`` (``key, sha256, size``) with ``problem``: null, ``missing``, ``digest`` or ``size``.

    Digests and sizes are recomputed from the stored bytes, and only they are joined, not the contents.
    """
    found = stored(spark, root).select(
        F.col("sha256").alias("named"), F.sha2("content", 256).alias("actual"), F.octet_length("content").alias("bytes")
    ).distinct()
    joined = manifest.join(found, F.col("sha256") == F.col("named"), "left")
    problem = (
        F.when(F.col("named").isNull(), "missing").when(F.col("actual") != F.col("sha256"), "digest")
        .when(F.col("size") != F.col("bytes"), "size")
    )
    return joined.select(*manifest.columns, problem.alias("problem"))
