"""Queries of conversation sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import sessions as S
from quarry.session import read
from quarry.streaming import sessions as W


def _turns(spark, d):
    return read(spark, d, "query_request").dropDuplicates(["request_id"])


_TURNS = "SELECT request_id, any_value(query) AS query, any_value(conversation_id) AS conversation_id, any_value(asked_at) AS asked_at FROM query_request GROUP BY request_id"


def recent_turns(spark, d):
    return S.recent(_turns(spark, d), "conversation_id", ["asked_at", "request_id"], 10).select("conversation_id", "request_id", "place")


def session_windows(spark, d):
    return S.idle_sessions(read(spark, d, "events"), "user_id", "ts").select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_seen"), "events")


WINDOWS = """
  WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, count(*) AS events FROM s GROUP BY user_id, n"""


def history_summary(spark, d):
    return S.history(_turns(spark, d).where("query is not null"), "conversation_id", "query", ["asked_at", "request_id"])


STEPS = ["plan", "retrieve", "select", "answer", "verify"]


def workflow_events(spark, d):
    """What a client is sent for each request: the steps, then done with the answer, or an error for a request without text."""
    q = read(spark, d, "query_request").select(F.col("request_id").alias("query_id"), F.col("query").alias("answer")).distinct()
    return W.workflow_events(q, STEPS)


EVENTS = """
  WITH q AS (SELECT DISTINCT request_id AS query_id, query AS answer FROM query_request), s AS (SELECT unnest(range(0, 5))::INT AS seq, unnest(['plan', 'retrieve', 'select', 'answer', 'verify']) AS event)
  SELECT query_id, seq, event, NULL::VARCHAR AS payload FROM q, s UNION ALL SELECT query_id, 5, CASE WHEN trim(coalesce(answer, ''), ' ') <> '' THEN 'done' ELSE 'error' END, CASE WHEN trim(coalesce(answer, ''), ' ') <> '' THEN answer ELSE 'no answer' END FROM q"""

QUERIES = {
    "workflow_events": (workflow_events, EVENTS),
    "recent_turns": (recent_turns, f"SELECT conversation_id, request_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY asked_at DESC NULLS LAST, request_id DESC) AS place FROM ({_TURNS}) WHERE conversation_id IS NOT NULL) WHERE place <= 10"),
    "session_windows": (session_windows, WINDOWS),
    "history_summary": (history_summary, f"SELECT conversation_id, 'Earlier questions covered: ' || string_agg(substr(query, 1, 50), '; ' ORDER BY place DESC) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY asked_at DESC NULLS LAST, request_id DESC) AS place FROM ({_TURNS}) WHERE conversation_id IS NOT NULL AND query IS NOT NULL) WHERE place <= 3 GROUP BY conversation_id"),
}
