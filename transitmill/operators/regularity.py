"""Headways, waits and stop offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BREAK_S, BUNCH, GAP, STOP_SHARE
from ..functions.exprs import tally, total

STOP = ["line", "direction_id", "stop_id", "service_date"]
COUNTS, SUMS = ["n", "m", "nc", "bunch", "gap"], ["r1", "r2", "s1", "s2"]


def stop_times(events: DataFrame) -> DataFrame:
    """(line, direction_id, stop_id, service_date, trip_id, t, s): real and scheduled epoch seconds of regular trips.

    Arrivals count, else departures. Only observed rows of trips that run as planned; a trip's last stop, found among all
    its rows, has no one waiting and is left out. One row a trip and stop.
    """
    cols = set(events.columns)
    by_arrival = F.col("arrival_time").isNotNull() & F.col("arrival_delay").isNotNull()
    t = F.unix_timestamp(F.when(by_arrival, F.col("arrival_time")).otherwise(F.col("departure_time")))
    delay = F.when(by_arrival, F.col("arrival_delay")).otherwise(F.col("departure_delay")).cast("long")
    regular = F.coalesce(F.col("trip_schedule_relationship"), F.lit(0)) == 0 if "trip_schedule_relationship" in cols else F.lit(True)
    seen = F.coalesce(F.col("observed"), F.lit(False)) if "observed" in cols else F.lit(True)
    trip = Window.partitionBy("route_id", "trip_id", "start_date")
    own = events.withColumn("_last", F.max("stop_sequence").over(trip)).filter(regular & seen & (F.col("stop_sequence") != F.col("_last")))
    out = own.select(F.col("route_id").cast("string").alias("line"), F.col("direction_id").cast("int"), F.col("stop_id").cast("string"), F.to_date(F.col("start_date").cast("string"), "yyyyMMdd").alias("service_date"), F.col("trip_id").cast("string"), "stop_sequence", t.alias("t"), (t - delay).alias("s"))
    from .windows import first_of

    whole = out.na.drop(subset=["line", "stop_id", "service_date", "t", "s"])
    return first_of(whole, ["line", "trip_id", "stop_sequence", "service_date"], ["t", "s", "stop_id"]).drop("stop_sequence")


def covered_stops(times: DataFrame, share: float = STOP_SHARE) -> DataFrame:
    """The stop times of stops that saw at least `share` of the median number of trips of their line, direction and day."""
    trips = times.groupBy(*STOP).agg(F.count_distinct("trip_id").alias("_k"))
    usual = Window.partitionBy("line", "direction_id", "service_date")
    good = trips.withColumn("_usual", F.median("_k").over(usual)).filter(F.col("_k") >= share * F.col("_usual")).select(*STOP)
    return times.join(good, STOP, "left_semi")


def headways(times: DataFrame, break_s: int = BREAK_S, midnight=None) -> DataFrame:
    """Counts and sums per (line, direction, stop, date, hour), which add up over any set of hours, stops and days.

    Scheduled headways lie between neighbours in the timetable; one over break_s starts a new block, as after a pause of
    service. Real ones lie between neighbours in real time inside a block. m, s1, s2: number, sum and sum of squares of the
    scheduled, by scheduled hour; n, r1, r2: of the real, by real hour, and nc of those have a scheduled one to compare with,
    of which bunch are under half and gap over one and a half times it. `midnight` gives the epoch seconds of the date's start.
    """
    start = midnight if midnight is not None else F.unix_timestamp(F.col("service_date").cast("timestamp"))
    plan = Window.partitionBy(*STOP).orderBy("s", "t", "trip_id")
    x = times.withColumn("_d", F.col("s") - F.lag("s").over(plan))
    x = x.withColumn("_block", F.sum(F.when(F.col("_d") <= break_s, 0).otherwise(1)).over(plan.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_hs", F.when(F.col("_d") <= break_s, F.col("_d")))
    x = x.withColumn("_h", F.col("t") - F.lag("t").over(Window.partitionBy(*STOP, "_block").orderBy("t", "s", "trip_id")))
    hour = lambda c: F.floor((F.col(c) - start) / 3600).cast("int")
    known = F.col("_hs") > 0
    square = lambda c: F.col(c).cast("double") * F.col(c)
    real = x.filter("_h is not null").groupBy(*STOP, hour("t").alias("hour")).agg(F.count(F.lit(1)).alias("n"), total("_h").alias("r1"), total(square("_h")).alias("r2"), tally(known).alias("nc"), tally(known & (F.col("_h") < BUNCH * F.col("_hs"))).alias("bunch"), tally(known & (F.col("_h") > GAP * F.col("_hs"))).alias("gap"))
    planned = x.filter("_hs is not null").groupBy(*STOP, hour("s").alias("hour")).agg(F.count(F.lit(1)).alias("m"), total("_hs").alias("s1"), total(square("_hs")).alias("s2"))
    both = real.join(planned, [*STOP, "hour"], "full")
    return both.select(*STOP, "hour", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SUMS])


def summed(hw: DataFrame, keys: list[str]) -> DataFrame:
    return hw.groupBy(*keys).agg(*[total(c).alias(c) for c in COUNTS + SUMS])


def waits(sums: DataFrame) -> DataFrame:
    """Minutes and shares from summed headways: mean wait of someone who comes at random, real (wr), scheduled (ws) and their
    difference (ew, of the rounded values); mean headways hr and hs; percent bunched, gapped and neither; nh. Null without data."""
    wait = lambda a, b: F.when(F.col(a) > 0, F.round(F.col(b) / (2 * F.col(a)) / 60, 2))
    percent = lambda c: F.when(F.col("nc") > 0, F.round(100 * F.col(c) / F.col("nc"), 1))
    mean = lambda a, k: F.when(F.col(k) > 0, F.round(F.col(a) / F.col(k) / 60, 1))
    keys = [c for c in sums.columns if c not in COUNTS + SUMS]
    wr, ws, bunch, gap = wait("r1", "r2"), wait("s1", "s2"), percent("bunch"), percent("gap")
    return sums.select(*keys, wr.alias("wr"), ws.alias("ws"), F.round(wr - ws, 2).alias("ew"), mean("r1", "n").alias("hr"), mean("s1", "m").alias("hs"), bunch.alias("bunch"), gap.alias("gap"), F.round(100 - bunch - gap, 1).alias("ok"), F.col("n").cast("long").alias("nh"))


def offsets(times: DataFrame) -> DataFrame:
    """(line, direction_id, stop_id, service_date, off_s): median scheduled time after the trip's first stop."""
    trip = Window.partitionBy("line", "trip_id", "service_date")
    return times.withColumn("_o", F.col("s") - F.min("s").over(trip)).groupBy(*STOP).agg(F.median("_o").alias("off_s"))


def stop_offsets(daily: DataFrame) -> DataFrame:
    """(line, direction_id, stop_id, off_s, days): mean of the daily medians."""
    return daily.groupBy("line", "direction_id", "stop_id").agg(F.avg("off_s").alias("off_s"), F.count(F.lit(1)).alias("days"))
