"""Retry accounting per key: attempts, back-off and dead letters, as a batch fold and as a stateful stream.

Outcomes are rows ``key, ts, event_id, ok`` in the order of ``ts`` and ``event_id``. A failure adds an attempt; the
``max_attempts``-th makes the key a dead letter, an earlier one puts it off by ``delay_seconds``. A success
completes the key. Completed keys and dead letters take no further outcome.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PENDING, COMPLETE, DEAD_LETTER = "pending", "complete", "dead_letter"
BASE_SECONDS, MOST_SECONDS = 30, 3600
RESULT = "attempts int, state string, available_at timestamp"


def delay_seconds(attempts: int) -> int:
    return min(MOST_SECONDS, BASE_SECONDS * 2**attempts)


def _delay(attempts: Column) -> Column:
    # Beyond twelve doublings the limit holds anyway.
    return F.least(F.lit(MOST_SECONDS), (BASE_SECONDS * F.pow(F.lit(2.0), F.least(attempts, F.lit(12)))).cast("int"))


def retry_states(outcomes: DataFrame, max_attempts: int) -> DataFrame:
    """``key, attempts, state, available_at`` after all outcomes.

    Only a key's first success and its first ``max_attempts`` failures can matter, so no more of a busy key
    leaves a task.
    """
    at = F.struct("ts", "event_id")
    success = outcomes.filter("ok").groupBy("key").agg(F.min(at).alias("done"))
    order = W.partitionBy("key").orderBy("ts", "event_id")
    failures = outcomes.filter("not ok").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_attempts)
    counted = failures.select("key", at.alias("at"), "n").join(success, "key", "left").filter("done is null or at < done")
    last = counted.groupBy("key").agg(F.max("n").alias("attempts"), F.max("at.ts").alias("last"))
    known = outcomes.select("key").distinct().join(success, "key", "left").join(last, "key", "left")
    attempts = F.coalesce("attempts", F.lit(0)).cast("int")
    state = F.when(attempts >= max_attempts, DEAD_LETTER).when(F.col("done").isNotNull(), COMPLETE).otherwise(PENDING)
    waits = F.timestamp_seconds(F.unix_micros("last") / 1_000_000 + _delay(attempts))
    return known.select("key", attempts.alias("attempts"), state.alias("state")).join(
        last.select("key", waits.alias("waits")), "key", "left"
    ).select("key", "attempts", "state", F.when(F.col("state") == PENDING, F.col("waits")).alias("available_at"))


def retry_stream(outcomes: DataFrame, max_attempts: int) -> DataFrame:
    """The same from a stream: each micro-batch gives the new state of the keys that it holds.

    A key's state is one small row, whatever its number of outcomes. Outcomes of a batch are taken in order.
    """
    import pandas as pd

    key_type = outcomes.schema["key"].dataType.simpleString()

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        attempts, state, available = held.get if held.exists else (0, PENDING, None)
        for row in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            if state != PENDING:
                break
            if row.ok:
                state, available = COMPLETE, None
                continue
            attempts += 1
            if attempts >= max_attempts:
                state, available = DEAD_LETTER, None
            else:
                available = (row.ts + pd.Timedelta(seconds=delay_seconds(attempts))).to_pydatetime()
        held.update((attempts, state, available))
        yield pd.DataFrame({"key": [key[0]], "attempts": [attempts], "state": [state],
                            "available_at": pd.Series([available], dtype="datetime64[us]")})

    return outcomes.groupBy("key").applyInPandasWithState(
        fold, f"key {key_type}, {RESULT}", RESULT, "update", GroupStateTimeout.NoTimeout
    )
