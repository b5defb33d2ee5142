"""Months derived night by night: what a night places, and when a month is placed anew as a whole.

The store of jobs.py, with fixes (line, track_id, ts, point, dist, terminus; partitions month and service_date) and, if there are any,
seen_stops (line, trip_id, stop_id, t; same partitions) as raw tables. A marker in raw_days/<date> says when a day was
written. Derived are placed and passages, a partition a day, then the cubes; derived_months/<month> holds the report.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs
from .operators import analysis, placement
from .sources import readers, sinks
from .sources.shared import delete

#: Changes whenever placement gives other rows.
VERSION = "1"
#: A month is placed as a whole again when it has so many times the days of its last whole run.
GROWTH = 2
RAW, SEEN = "fixes", "seen_stops"


def last_day(month: str) -> dt.date:
    y, m = map(int, month.split("-"))
    return dt.date(y, m, calendar.monthrange(y, m)[1])


def plan(month: str, written: dict[str, str], prev: dict | None, yesterday: dt.date, full: bool = False) -> dict:
    """{mode: full, incremental or current; days; why} for the days written so far ({date: time}) and the last report.

    New days are those not derived yet, or written after the last placement. The whole month is placed if it never was, if
    the code changed, the last run failed, a day was taken away, the month closes (its last day is new, or it ended without a
    whole run of its last state), or it has GROWTH times the days of its last whole run.
    """
    days, end = sorted(written), last_day(month).isoformat()
    whole = lambda why: {"mode": "full", "days": days, "why": why}
    if not days:
        return {"mode": "current", "days": [], "why": "no day yet"}
    if full:
        return whole("asked")
    if prev is None:
        return whole("not derived")
    if prev.get("version") != VERSION:
        return whole("code changed")
    if prev.get("failed"):
        return whole("the last run failed")
    if set(prev["dates"]) - set(days):
        return whole("days removed")
    if last_day(month) < yesterday and not prev["closed_full"]:
        return whole("month closed")
    new = [d for d in days if d not in prev["dates"] or written[d] > prev["placed_at"]]
    if not new:
        return {"mode": "current", "days": [], "why": "up to date"}
    if end in new:
        return whole("month closes")
    if len(days) >= GROWTH * prev["full_days"]:
        return whole(f"{len(days)} days, last whole run on {prev['full_days']}")
    return {"mode": "incremental", "days": new, "why": f"{len(new)} new days"}


def report(month: str, written: dict[str, str], todo: dict, prev: dict | None, started: str, yesterday: dt.date, failed: str | None = None) -> dict:
    """What a run leaves for the next one. A failed run keeps the days of the one before, so that they count as new."""
    whole = todo["mode"] == "full" and not failed
    days = sorted(written)
    closed = last_day(month).isoformat() in days or last_day(month) < yesterday
    return {
        "month": month, "version": VERSION, "mode": todo["mode"], "why": todo["why"], "days_placed": todo["days"], "failed": failed, "placed_at": started if not failed else (prev or {}).get("placed_at", ""),
        "dates": days if not failed else (prev or {}).get("dates", []), "full_days": len(days) if whole else (prev or {}).get("full_days", 0), "closed_full": closed if whole else (prev or {}).get("closed_full", False),
    }


def written_days(spark: SparkSession, store: str, month: str) -> dict[str, str]:
    """{date: time written} of a month's raw days, from their markers: 31 rows at most."""
    if not readers.exists(spark, f"{store}/raw_days"):
        return {}
    held = readers.manifests(spark, f"{store}/raw_days/*").select(F.col("date").cast("string").alias("date"), "written_at").filter(F.col("date").startswith(month))
    return {r["date"]: r["written_at"] for r in held.collect()}


def last_report(spark: SparkSession, store: str, month: str) -> dict | None:
    path = f"{store}/derived_months/{month}"
    if not readers.exists(spark, path):
        return None
    import json

    return json.loads(spark.read.text(path).first()[0])


def put_days(spark: SparkSession, store: str, name: str, df: DataFrame, month: str, days: list[str], whole: bool) -> None:
    """Replaces the days of a month: those that df has no row for go, and if `whole`, so do days that aren't asked for."""
    path = f"{store}/{name}"
    out = df.withColumn("month", F.lit(month))
    sinks.replace_partitions(out, path, ["month", "service_date"], ["line"])
    kept = spark.read.parquet(path).filter(F.col("month") == month).select(F.col("service_date").cast("string")).distinct()
    made = {r[0] for r in out.select(F.col("service_date").cast("string")).distinct().collect()}
    for day in (r[0] for r in kept.collect()):
        if day not in made and (whole or day in days):
            delete(spark, f"{path}/month={month}/service_date={day}")


def learned(spark: SparkSession, store: str, month: str, fixes: DataFrame, links: DataFrame, stops: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame]:
    """(aliases, lengths) from the fixes; a whole run keeps them for the month, later nights take the month's before their own."""
    paths = [f"{store}/{n}/month={month}" for n in ("aliases", "lengths")]
    own = placement.terminus_aliases(fixes, stops, ["line"])
    known = own if whole else _before(spark.read.parquet(paths[0]), own, ["line", "terminus"], "known")
    named = placement.with_pattern(placement.with_terminus(fixes, known, ["line"]), stops)
    flen = placement.learned_lengths(named, placement.chain(links, ["line", "pattern_uid"]), ["line", "pattern_uid"])
    if whole:
        for df, path in zip((own, flen), paths, strict=True):
            sinks.write(df, path)
        return tuple(spark.read.parquet(p) for p in paths)
    month_lengths = spark.read.parquet(paths[1]).filter(F.col("n") >= placement.LEAST_ROWS)
    return known, _before(month_lengths.drop("n"), flen.drop("n"), ["line", "pattern_uid", "link_idx"], "flen")


def _before(first: DataFrame, then: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of the first frame where it has one, else of the second."""
    return first.join(then.withColumnRenamed(value, "_then"), keys, "full").select(*keys, F.coalesce(value, "_then").alias(value))


def place_days(spark: SparkSession, store: str, month: str, days: list[str], whole: bool) -> None:
    """placed and passages of these days."""
    of = lambda name: spark.read.parquet(f"{store}/{name}").filter((F.col("month") == month) & F.col("service_date").cast("string").isin(days)).drop("month")
    links, patterns, run = (jobs.month_of(spark, store, n, month) for n in ("links", "patterns", "pattern_days"))
    stops = placement.pattern_stops(patterns, run)
    fixes = of(RAW)
    aliases, lengths = learned(spark, store, month, fixes, links, stops, whole)
    named = placement.with_pattern(placement.with_terminus(fixes, aliases, ["line"]), stops)
    keys = ["line", "pattern_uid"]
    found = placement.placed(named, links, keys, ["service_date", "track_id"], [F.col("ts"), F.col("dist")], lengths).filter("count")
    on = [*keys, "link_idx"]
    rows = found.join(links.select(*on, "link_key"), on).select("line", "track_id", "ts", "service_date", F.hour(F.timestamp_seconds("ts")).alias("hour"), "pattern_uid", "link_idx", "link_key", "pos_m", "s_m", F.col("dist").cast("int").alias("raw_dist_m"), (F.col("dist") <= 0).alias("at_stop"))
    put_days(spark, store, "placed", rows, month, days, whole)
    placed = of("placed")
    cell = ["line", "service_date", "hour", "link_key"]
    track = F.concat_ws("|", "line", "service_date", "track_id")
    feed = analysis.passages(placed.withColumn("_track", track), "_track", [F.col("ts"), F.col("raw_dist_m")], ["line", "pattern_uid", "link_idx", "link_key"])
    if readers.exists(spark, f"{store}/{SEEN}"):
        seen = of(SEEN).withColumnRenamed("service_date", "day")
        events = placement.event_passages(seen, links, ["line"], ["day", "trip_id"], [F.col("t"), F.col("stop_id")])
    else:
        events = feed.select(*cell, "pattern_uid", F.col("n_feed").alias("n_events")).limit(0)
    # by the clock, as the cubes file passages to service days themselves
    both = placement.merged_passages(feed, events, cell)
    put_days(spark, store, "passages", both.filter(F.col("service_date").cast("string").isin(days)), month, days, whole)


def derive(spark: SparkSession, store: str, month: str, yesterday: dt.date, full: bool = False, now: str | None = None) -> dict:
    """One night of a month: plans, places what is due, makes the month's cubes, and leaves the report. A run over an up-to-date month
    changes nothing. A run that fails is reported and raises; the next one places the whole month."""
    started = now or dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
    written, prev = written_days(spark, store, month), last_report(spark, store, month)
    todo = plan(month, written, prev, yesterday, full)
    if todo["mode"] == "current":
        return todo | {"month": month}
    try:
        place_days(spark, store, month, todo["days"], todo["mode"] == "full")
        jobs.cube(spark, store, month)
        if readers.exists(spark, f"{store}/stop_events"):
            jobs.regularity(spark, store, month)
    except Exception as e:
        sinks.commit(spark, f"{store}/derived_months/{month}", report(month, written, todo, prev, started, yesterday, repr(e)[:300]))
        raise
    out = report(month, written, todo, prev, started, yesterday)
    sinks.commit(spark, f"{store}/derived_months/{month}", out)
    return out
