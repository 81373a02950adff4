"""Keyed conversation sessions, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recent(turns: DataFrame, session: str, order: list[str], keep: int = 10) -> DataFrame:
    """The latest keep turns of each session with their place from the latest, 1 first; null sessions have none."""
    w = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return turns.where(F.col(session).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def idle_sessions(events: DataFrame, user: str, ts: str, minutes: int = 60) -> DataFrame:
    """(user, session_start, last_seen, events): sessions end after minutes without an event."""
    windows = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).groupBy(user, F.session_window(ts, f"{minutes} minutes").alias("w"))
    return windows.agg(F.min(ts).alias("session_start"), F.max(ts).alias("last_seen"), F.count("*").alias("events")).select(user, "session_start", "last_seen", "events")


def history(turns: DataFrame, session: str, text: str, order: list[str], questions: int = 3, size: int = 50) -> DataFrame:
    """(session, summary): what the last questions were about, oldest first."""
    last = recent(turns, session, order, questions)
    parts = F.transform(F.sort_array(F.collect_list(F.struct(-F.col("place"), F.substring(text, 1, size).alias("t")))), lambda x: x.t)
    return last.groupBy(session).agg(F.concat(F.lit("Earlier questions covered: "), F.array_join(parts, "; ")).alias("summary"))
