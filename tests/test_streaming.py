"""Arrival jobs over several files and batches against batch results."""

from pyspark.sql import functions as F

from docketlens.streaming import arrivals

SCHEMA = "event_id long, source_url string, sha256 string, observed_at long"


def stream_of(spark, folder, batches):
    """A stream that reads one file per batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


BATCHES = [
    [(1, "u", "a", 1), (2, "u", "a", 2), (3, "u", "b", 3), (4, "v", "a", 1)],
    [(5, "u", "b", 4), (6, "v", "c", 5), (7, "w", None, 1)],
    [(8, "u", "a", 9), (9, "v", "c", 9), (10, "x", "z", 9)],
]


def test_versions_over_batches(spark, tmp_path):
    got = arrivals.versions(stream_of(spark, tmp_path, BATCHES), spark)
    assert sorted(r["event_id"] for r in got.collect()) == [1, 3, 4, 6, 7, 8, 10]


def test_dedupe_over_batches(spark, tmp_path):
    keys = ["source_url", "sha256"]
    once = arrivals.distinct_observations(stream_of(spark, tmp_path, BATCHES).select(*keys), keys)
    got = [tuple(r) for r in arrivals.finished(once, spark, "once").collect()]
    want = {(u, s) for rows in BATCHES for _, u, s, _ in rows}
    assert len(got) == len(want) and set(got) == want


def test_backfill_keeps_known_dates(spark, tmp_path):
    meetings = spark.createDataFrame(
        [("u", None, None), ("v", "2001-01-01", None), ("n", None, None)], "id string, starts_on string, ends_on string"
    ).withColumns({c: F.col(c).cast("date") for c in ("starts_on", "ends_on")})
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("observed_at").cast("int"))
    found = stream_of(spark, tmp_path, BATCHES[::-1]).select(
        F.col("source_url").alias("meeting_id"), F.col("observed_at").alias("place"), day.alias("starts_on"), day.alias("ends_on")
    )
    got = {r["id"]: (str(r["starts_on"]), str(r["ends_on"]), r["conflict"]) for r in arrivals.backfilled(found, meetings, spark).collect()}
    assert got == {"u": ("2020-01-02", "2020-01-02", False), "v": ("2001-01-01", "2020-01-02", True), "n": ("None", "None", False)}


def test_counts_hold_every_window_out_of_order(spark, tmp_path):
    hours = [[(1, 9), (2, 9), (3, 9)], [(4, 2), (5, 9)], [(6, 2)]]
    for i, rows in enumerate(hours):
        spark.createDataFrame(rows, "id long, h long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    ts = F.timestamp_seconds(F.col("h") * 3600)
    stream = spark.readStream.schema("id long, h long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    counts = arrivals.counts_per_window(stream.withColumn("ts", ts), "1 hour", None, "h")
    got = arrivals.last_updates(counts, spark, "counts", ["starts", "h"])
    assert sorted((r["h"], r["n"]) for r in got.collect()) == [(2, 2), (9, 4)]


def test_event_stream_of_a_folder(spark, sf, tmp_path):
    from docketlens.plans import queries

    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["stream_counts"](spark, str(tmp_path))
    want = spark.read.parquet(f"{sf}/events.parquet")
    assert got.agg(F.sum("n")).first()[0] == want.count() > 0
