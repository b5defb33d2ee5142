"""Hours and days that can be used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BANDS, FEED_BAD, GRID_HOURS, LINE_ABSENT, MAX_BAD_SHARE, MIN_COVERAGE, MIN_FEED_SHARE, PARTIAL_FEED, PRESENT_ROWS, TICK_S
from ..functions.exprs import has_flag, in_band, set_flag, tally, total

CELL = ["service_date", "hour"]


def hour_counts(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(keys or []), *CELL).agg(F.count(F.lit(1)).alias("n"))


def absent_hours(counts: DataFrame, dates: DataFrame, keys: list[str] | None = None, hours: tuple[int, int] = GRID_HOURS, present: int = PRESENT_ROWS) -> DataFrame:
    """(keys, service_date, hour) without rows, in hours whose median over all dates is at least `present`.

    The grid is dates times hours times keys; both lists are short, and it is made by exploding, not by a join of data.
    """
    keys = keys or []
    hour = F.explode(F.sequence(F.lit(hours[0]), F.lit(hours[1] - 1))).alias("hour")
    days = dates.select("service_date").distinct()
    grid = days.select("service_date", hour) if not keys else counts.select(*keys).distinct().crossJoin(F.broadcast(days)).select(*keys, "service_date", hour)
    full = grid.join(counts.select(*keys, *CELL, "n"), [*keys, *CELL], "left").fillna(0, ["n"])
    usual = full.groupBy(*keys, "hour").agg(F.median("n").alias("_usual")).filter(F.col("_usual") >= present)
    return full.join(usual, [*keys, "hour"], "left_semi").filter("n = 0").select(*keys, *CELL)


def with_absence(coverage: DataFrame, absent: DataFrame, keys: list[str] | None = None) -> DataFrame:
    on = [*(keys or []), *CELL]
    marked = coverage.join(absent.select(*on).distinct().withColumn("_a", F.lit(True)), on, "left")
    return marked.withColumn("flags", set_flag("flags", LINE_ABSENT, F.coalesce("_a", F.lit(False)))).drop("_a")


def with_partial_feed(coverage: DataFrame, passages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sets PARTIAL_FEED where positions saw less than MIN_FEED_SHARE of the passages."""
    on = [*(keys or []), *CELL]
    share = passages.groupBy(*on).agg((total("n_feed") < MIN_FEED_SHARE * total("n")).alias("_p"))
    return coverage.join(share, on, "left").withColumn("flags", set_flag("flags", PARTIAL_FEED, F.coalesce("_p", F.lit(False)))).drop("_p")


def day_quality(coverage: DataFrame, first_hour: int = BANDS["day"][0], end_hour: int = BANDS["day"][1], min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Per date over the day's hours: mean coverage, hours with a bad feed, without the line, and with either."""
    low = (F.col("coverage") < min_coverage) | has_flag("flags", FEED_BAD)
    gone = has_flag("flags", LINE_ABSENT)
    day = coverage.filter(in_band("hour", (first_hour, end_hour)))
    return day.groupBy("service_date").agg(F.avg("coverage").alias("coverage"), tally(low).alias("bad"), tally(gone).alias("absent"), tally(low | gone).alias("unusable"))


def day_status(days: DataFrame, hours: int = 15) -> DataFrame:
    """Adds `status`, the first that holds: not_ingested, not_derived, no_data, low_coverage, line_absent, ok.

    Needs ingested, derived, obs and day_quality's columns.
    """
    most = MAX_BAD_SHARE * hours + 1e-9
    status = (
        F.when(~F.col("ingested"), "not_ingested").when(~F.col("derived"), "not_derived")
        .when(F.coalesce("obs", F.lit(0)) == 0, "no_data").when(F.col("bad") > most, "low_coverage")
        .when(F.col("unusable") > most, "line_absent").otherwise("ok")
    )
    return days.withColumn("status", status)


def usable_hours(coverage: DataFrame, keys: list[str] | None = None, band: tuple[int, int] = BANDS["day"], min_coverage: float = MIN_COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(hours, days): good hours of usable days, and those days: at most MAX_BAD_SHARE of the day's hours are bad."""
    on = [*(keys or []), "service_date"]
    judged = coverage.withColumn("_ok", (F.col("coverage") >= min_coverage) & ~has_flag("flags", FEED_BAD | LINE_ABSENT))
    bad = judged.filter(in_band("hour", band)).groupBy(*on).agg(tally(~F.col("_ok")).alias("_bad"))
    days = bad.filter(F.col("_bad") / (band[1] - band[0]) <= MAX_BAD_SHARE + 1e-9).select(*on)
    return judged.filter("_ok").join(days, on, "left_semi").select(*on, "hour"), days


def report_weight(coverage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, service_date, hour, w): seconds that a poll stands for, in ticks."""
    return coverage.select(*(keys or []), *CELL, F.when(F.col("n_snapshots") > 0, F.col("covered_s") / F.col("n_snapshots") / TICK_S).otherwise(F.lit(1.0)).alias("w"))


def feed_coverage(snaps: DataFrame, cap_s: int = 60, keys: list[str] | None = None) -> DataFrame:
    """(service_date, hour, coverage, flags, covered_s, n_snapshots) from polls (service_date, hour, ts, frozen).

    A live poll covers the time to the next one, `cap_s` at most; bit 1: no live poll, bit 2: some are frozen.
    """
    from pyspark.sql import Window

    live = snaps.filter("not frozen").withColumn("_next", F.lead("ts").over(Window.partitionBy(*(keys or []), "service_date").orderBy("ts")))
    took = live.withColumn("_s", F.least(F.coalesce(F.col("_next") - F.col("ts"), F.lit(cap_s)), F.lit(cap_s)))
    sums = took.groupBy(*(keys or []), *CELL).agg(F.sum("_s").cast("double").alias("covered_s"), F.count(F.lit(1)).alias("n_snapshots"))
    froze = snaps.groupBy(*(keys or []), *CELL).agg(tally(F.col("frozen")).alias("_f"))
    out = froze.join(sums, [*(keys or []), *CELL], "left").fillna(0, ["covered_s", "n_snapshots"])
    flags = F.when(F.col("n_snapshots") == 0, 1).otherwise(0) + F.when(F.col("_f") > 0, 2).otherwise(0)
    return out.select(*(keys or []), *CELL, F.least(F.col("covered_s") / 3600, F.lit(1.0)).alias("coverage"), flags.alias("flags"), "covered_s", "n_snapshots")
