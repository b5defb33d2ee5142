"""Structured Streaming twins: frozen polls, sessions, service-day windows and a closed-day guard."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship


def service_day_counts(events: DataFrame, ts: str, keys: list[str], late: str = "20 minutes", shift: str = "4 hours") -> DataFrame:
    """Rows per key and service day, which begins `shift` after midnight; a day is final once the watermark has passed it."""
    day = F.window(ts, "1 day", "1 day", shift)
    return events.withWatermark(ts, late).groupBy(day.alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("_w.start").alias("service_date"), *keys, "n")


def inactive_sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions by a pause in time: (keys, start, end, n)."""
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return s.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def frozen_polls(polls: DataFrame, feed: str = "feed", day: str = "day", tie: list[str] | None = None) -> DataFrame:
    """(feed, day, ts, n_rows, frozen) from polls (feed, day, ts, n_rows, content) as they come: a poll whose content is that of
    the one before on the same day is frozen, as in the batch. The state is the last poll's day and content; polls of one
    trigger are taken in order of time, those of one time by `tie`."""

    ship(polls.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(["ts", *(tie or [])], kind="stable")
        now = list(zip(pdf[day].astype(str), pdf["content"], strict=True))
        before = [tuple(state.get) if state.exists else None, *now[:-1]]
        state.update(now[-1])
        yield pd.DataFrame({feed: key[0], day: pdf[day], "ts": pdf["ts"], "n_rows": pdf["n_rows"], "frozen": [a == b for a, b in zip(before, now, strict=True)]})

    return polls.groupBy(feed).applyInPandasWithState(run, f"{feed} string, {day} date, ts bigint, n_rows bigint, frozen boolean", "day string, content string", "append", GroupStateTimeout.NoTimeout)


def upsert_days(path: str, by: str = "service_date"):
    """A foreachBatch function that replaces the days a batch has rows for; running it again gives the same table."""
    from ..sources.sinks import replace_partitions

    def write(batch: DataFrame, _: int) -> None:
        replace_partitions(batch, path, [by])

    return write


def drain(df: DataFrame, path: str, mode: str) -> None:
    """Runs a stream to the end of what is there, into the files of a folder: each trigger's rows beside those before, or, in
    mode complete, the whole result in place of the one before."""
    to = df.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if mode == "complete":
        to = to.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    else:
        to = to.outputMode(mode).format("parquet").option("path", path)
    to.start().awaitTermination()
