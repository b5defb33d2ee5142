"""Queries that run a stream over the events to its end, with SQL of what their batch form gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..streaming import twins
from .registry import E, query, table


def stream(spark, d) -> DataFrame:
    """The events table as a stream of files. A pattern, as a stream takes no path of a single file."""
    held = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    return held.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def drained(spark, df: DataFrame, mode: str) -> DataFrame:
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    twins.drain(df, path, mode)
    return spark.read.schema(df.schema).parquet(path)


@query(E + " SELECT (ts - INTERVAL 4 HOUR)::DATE AS service_date, event_type, count(*) AS n FROM e GROUP BY ALL")
def stream_service_days(spark, d):
    return drained(spark, twins.service_day_counts(stream(spark, d), "ts", ["event_type"]), "complete")


@query(E + """, w AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR, true) AS nw FROM e),
s AS (SELECT *, sum(nw::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM w)
SELECT user_id, count(*) AS n, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS seconds FROM s GROUP BY user_id, s""")
def stream_sessions(spark, d):
    out = drained(spark, twins.inactive_sessions(stream(spark, d), "ts", ["user_id"], "12 hours"), "complete")
    return out.select("user_id", "n", (F.unix_timestamp("end") - 12 * 3600 - F.unix_timestamp("start")).alias("seconds"))


@query(E + " SELECT user_id::VARCHAR AS feed, service_date AS day, t AS ts, 1::BIGINT AS n_rows, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id, service_date ORDER BY t), false) AS frozen FROM e")
def stream_frozen_polls(spark, d):
    e = stream(spark, d)
    polls = e.select(F.col("user_id").cast("string").alias("feed"), F.to_date("ts").alias("day"), F.unix_timestamp("ts").alias("ts"), F.lit(1).cast("long").alias("n_rows"), F.col("event_type").alias("content"), "event_id")
    return drained(spark, twins.frozen_polls(polls, tie=["event_id"]), "append")
