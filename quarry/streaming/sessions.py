"""Conversation sessions as a stream: a turn log, keyed state with a time to live and bounded retention, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources.files import TURN, parsed_lines


def turn_log(spark: SparkSession, folder: str, schema: str = TURN) -> DataFrame:
    """The append-only log as a stream; corrupt lines are skipped."""
    return parsed_lines(spark.readStream.text(folder), schema).where("conversation_id is not null")


def append_log(turns: DataFrame, folder: str, checkpoint: str):
    """An append sink of JSON lines, exactly once by its checkpoint."""
    return turns.writeStream.format("json").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_sessions(turns: DataFrame, idle_minutes: int = 60, keep: int = 50) -> DataFrame:
    """(conversation_id, turns, last_active, dropped, expired): state of each conversation after each trigger that touches it.

    State holds at most keep turns' times; older turns are counted as dropped. A conversation without turns for idle_minutes of
    processing time ends: it comes out once more as expired and its state goes. With 0 minutes sessions never end.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, dropped = state.get if state.exists else ([], 0)
        held = list(held)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"conversation_id": [key[0]], "turns": [len(held)], "last_active": [pd.Timestamp(max(held, default=0), unit="us")], "dropped": [dropped], "expired": [True]})
            return
        for b in batches:
            held += [int(x.value // 1000) for x in b.timestamp.dropna()]
        held.sort()
        dropped += max(0, len(held) - keep)
        held = held[-keep:]
        state.update((held, dropped))
        if idle_minutes:
            state.setTimeoutDuration(idle_minutes * 60_000)
        yield pd.DataFrame({"conversation_id": [key[0]], "turns": [len(held)], "last_active": [pd.Timestamp(max(held, default=0), unit="us")], "dropped": [dropped], "expired": [False]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_minutes else GroupStateTimeout.NoTimeout
    return turns.groupBy("conversation_id").applyInPandasWithState(update, "conversation_id string, turns int, last_active timestamp, dropped int, expired boolean", "held array<bigint>, dropped int", "update", timeout)


def event_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "60 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions by event time with a watermark: rows later than late are dropped, finished sessions are appended once."""
    stamped = events.where(F.col(user).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def workflow_events(queries: DataFrame, steps: list[str]) -> DataFrame:
    """(query_id, seq, event, payload): the steps of each query in order, then exactly one of done or error."""
    named = F.array(*[F.struct(F.lit(s).alias("event"), F.lit(None).cast("string").alias("payload")) for s in steps])
    last = F.when(F.coalesce(F.trim("answer"), F.lit("")) != "", F.struct(F.lit("done").alias("event"), F.col("answer").alias("payload"))).otherwise(F.struct(F.lit("error").alias("event"), F.lit("no answer").alias("payload")))
    return queries.select("query_id", F.posexplode(F.concat(named, F.array(last))).alias("seq", "e")).select("query_id", "seq", "e.event", "e.payload")
