"""Streaming queries over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.lineage import shared_folder
from verdigris.plans.base_sql import BASE
from verdigris.streaming import outcomes


def stream_outcome_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every step of every user, folded by a stream."""
    return outcomes.run_to_table(outcomes.last_outcome(outcomes.events(spark, f"{sf_dir}/events.parquet")), shared_folder(spark), ["user_id", "step_key"])


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.run_to_table(outcomes.windowed(outcomes.events(spark, f"{sf_dir}/events.parquet")), shared_folder(spark), ["start", "event_type"])


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))


QUERIES = {f.__name__: f for f in (stream_outcome_fold, stream_event_windows, event_sessions)}

ORACLES = {
    "stream_outcome_fold": BASE + "SELECT context_id AS user_id, step_key, event_type, o.event_id FROM outcome o JOIN events e ON e.event_id = o.event_id",
    "stream_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS events FROM s GROUP BY user_id, n""",
}
