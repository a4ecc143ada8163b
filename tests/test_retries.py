"""Retry accounting against a plain fold, in batch and over several micro-batches."""

import datetime as dt
import random

import pytest

from docketlens.streaming import retries

START = dt.datetime(2024, 5, 1)


def plain(rows, most):
    out = {}
    for key, ts, _, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        attempts, state, at = out.get(key, (0, "pending", None))
        if state == "pending":
            if ok:
                state, at = "complete", None
            else:
                attempts += 1
                state, at = ("dead_letter", None) if attempts >= most else ("pending", ts + dt.timedelta(seconds=min(3600, 30 * 2**attempts)))
        out[key] = (attempts, state, at)
    return out


def rows_of(seed, n=400):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(40)}", START + dt.timedelta(seconds=i // 3), i, rng.random() < 0.1) for i in range(n)]


SCHEMA = "key string, ts timestamp, event_id long, ok boolean"


@pytest.mark.parametrize("most", [1, 4, 12])
def test_batch(spark, most):
    rows = rows_of(most)
    found = retries.retry_states(spark.createDataFrame(rows, SCHEMA).repartition(4), most).collect()
    assert {r["key"]: (r["attempts"], r["state"], r["available_at"]) for r in found} == plain(rows, most)
    assert retries.retry_states(spark.createDataFrame([], SCHEMA), most).count() == 0


def test_back_off_has_a_limit():
    assert [retries.delay_seconds(n) for n in (1, 2, 6, 7, 60)] == [60, 120, 1920, 3600, 3600]


def test_stream_over_several_batches_equals_the_fold(spark, tmp_path):
    rows, seen = rows_of(9), {}
    for part in range(4):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def keep(batch, _):
        seen.update({r["key"]: (r["attempts"], r["state"], r["available_at"]) for r in batch.collect()})

    query = retries.retry_stream(stream, 4).writeStream.foreachBatch(keep).outputMode("update").option(
        "checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 4 and seen == plain(rows, 4)
