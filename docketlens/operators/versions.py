"""Versioned tables: one partition per version, and one small row that says which version is active.

Rows of all versions lie below ``<root>/data``, partitioned by ``version``, so reading the active version
prunes to its folder. States are an append-only table below ``<root>/states``; every change is one file, so it is
seen whole or not at all, and an activation that dies leaves the version that was active before. Data is
written first, its state after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUILDING, VALIDATED, ACTIVE, SUPERSEDED, FAILED = "building", "validated", "active", "superseded", "failed"
_STATES = "step long, version string, state string"


def _log(spark: SparkSession, root: str) -> DataFrame:
    """All state changes; none before the first one is written."""
    try:
        return spark.read.schema(_STATES).parquet(f"{root}/states")
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], _STATES)


def states(spark: SparkSession, root: str) -> DataFrame:
    """``version, state``: the last state of each version."""
    return _log(spark, root).groupBy("version").agg(F.max_by("state", "step").alias("state"))


def _record(spark: SparkSession, root: str, *changes: tuple[str, str]) -> None:
    step = (_log(spark, root).agg(F.max("step")).first()[0] or 0) + 1
    rows = [(step, version, state) for version, state in changes]
    spark.createDataFrame(rows, _STATES).coalesce(1).write.mode("append").parquet(f"{root}/states")


def _state(spark: SparkSession, root: str, version: str) -> str | None:
    row = states(spark, root).filter(F.col("version") == version).first()
    return row["state"] if row else None


def active_version(spark: SparkSession, root: str) -> str | None:
    row = states(spark, root).filter(F.col("state") == ACTIVE).first()
    return row["version"] if row else None


def write_version(rows: DataFrame, root: str, version: str) -> None:
    """Build or rebuild a version that is not active; repeating it replaces its rows and nothing else."""
    spark = rows.sparkSession
    if _state(spark, root, version) == ACTIVE:
        raise ValueError(f"version {version} is active and stays as it is")
    _record(spark, root, (version, BUILDING))
    rows.write.mode("overwrite").parquet(f"{root}/data/version={version}")


def record_validation(spark: SparkSession, root: str, version: str, faults: DataFrame) -> bool:
    """A version without a row in ``faults`` becomes validated, another one failed."""
    if _state(spark, root, version) != BUILDING:
        raise ValueError(f"version {version} is not being built")
    sound = not faults.limit(1).count()
    _record(spark, root, (version, VALIDATED if sound else FAILED))
    return sound


def activate(spark: SparkSession, root: str, version: str) -> None:
    """Make a validated version the active one; the version before it is superseded by the same write."""
    state = _state(spark, root, version)
    if state == ACTIVE:
        return
    if state not in (VALIDATED, SUPERSEDED):
        raise ValueError(f"version {version} is {state or 'unknown'}, only a validated one can become active")
    before = active_version(spark, root)
    _record(spark, root, *([(before, SUPERSEDED)] if before else []), (version, ACTIVE))


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """Rows of a version, by default of the active one; the scan is pruned to its partition."""
    wanted = version or active_version(spark, root)
    if wanted is None:
        raise ValueError("no version is active")
    # Versions look like numbers or dates at times, so their type is not left to guessing.
    rows = spark.read.parquet(f"{root}/data")
    return rows.filter(F.col("version") == F.lit(wanted)).withColumn("version", F.col("version").cast("string"))
