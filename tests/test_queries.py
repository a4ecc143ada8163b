"""Every registered query of the library against its SQL, over the smallest tables."""

import pytest

from docketlens.plans import dataset_queries as queries

from .compare import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    columns, rows = spark_rows(queries.QUERIES[name](spark, sf))
    assert rows == sql_rows(queries.SQL[name], sf, columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_window_counts_equal_batch(spark, sf):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{sf}/events.parquet")
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").count()
    streamed = queries.QUERIES["stream_counts"](spark, sf)
    want = {(r["window"]["start"], r["event_type"]): r["count"] for r in batch.collect()}
    got = {(r["starts"], r["event_type"]): r["n"] for r in streamed.collect()}
    assert got and got == want


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
