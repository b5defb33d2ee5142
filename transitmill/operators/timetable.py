"""Timetables: services by date, planned km, service level and day exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EARTH_KM, GUARD_SHARE, HOLIDAY_RATIO, MIN_SIDE, PAD_DAYS, REDUCED_RATIO, REF_DAYS, REF_QUANTILE, RUN_DAYS, RUN_DROP
from ..functions.exprs import easter, nearest_rank, total
from .windows import first_of

WEEK = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def services(calendar: DataFrame, exceptions: DataFrame, first=None, last=None) -> DataFrame:
    """(service_id, date): calendar ranges by weekday, with dates added (type 1) and taken away (type 2)."""
    a = F.greatest("start_date", first) if first is not None else F.col("start_date")
    b = F.least("end_date", last) if last is not None else F.col("end_date")
    spread = calendar.withColumn("_a", a).withColumn("_b", b).filter("_a <= _b").withColumn("date", F.explode(F.sequence("_a", "_b")))
    runs = spread.filter(F.get(F.array(*WEEK), F.weekday("date")) == 1).select("service_id", "date")
    inside = F.lit(True)
    if first is not None:
        inside = inside & (F.col("date") >= first)
    if last is not None:
        inside = inside & (F.col("date") <= last)
    own = exceptions.filter(inside)
    added = own.filter("exception_type = 1").select("service_id", "date")
    gone = own.filter("exception_type = 2").select("service_id", "date")
    return runs.union(added).distinct().join(gone, ["service_id", "date"], "left_anti")


def trips_by_date(active: DataFrame, trips: DataFrame) -> DataFrame:
    """(date, trips)."""
    per = trips.groupBy("service_id").agg(F.count(F.lit(1)).alias("_n"))
    return active.join(per, "service_id").groupBy("date").agg(F.sum("_n").alias("trips"))


def path_length(points: DataFrame, keys: list[str], order: str | list[str], x: str, y: str, spherical: bool = True) -> DataFrame:
    """(keys, km): length of the polyline through the points in order; on the sphere with the later point's latitude, else plane."""
    w = Window.partitionBy(*keys).orderBy(order)  # by several columns where the first leaves ties
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    if spherical:
        step = EARTH_KM * F.sqrt(F.pow(F.radians(dx) * F.cos(F.radians(F.col(y))), 2) + F.pow(F.radians(dy), 2))
    else:
        step = F.sqrt(dx * dx + dy * dy)
    return points.withColumn("_s", step).groupBy(*keys).agg(total("_s").alias("km"))


def trip_hours(trips: DataFrame, start: str = "start_s", end: str = "end_s", km: str = "km", unit: int = 3600) -> DataFrame:
    """One row for each trip and hour that it runs in: km in proportion to the time inside, and trips 1 in its first hour.

    A trip without duration has all its km in its hour.
    """
    a, b = F.col(start), F.col(end)
    h0 = F.floor(a / unit)
    h1 = F.when(b > a, F.floor((b - 1) / unit)).otherwise(h0)
    x = trips.withColumn("hour", F.explode(F.sequence(h0, F.greatest(h0, h1))))
    inside = F.least(b, (F.col("hour") + 1) * unit) - F.greatest(a, F.col("hour") * unit)
    share = F.when(b > a, F.try_divide(inside.cast("double"), (b - a).cast("double"))).otherwise(F.lit(1.0))
    return x.withColumn(km, F.col(km) * share).withColumn("trips", (F.col("hour") == h0).cast("int"))


def plan_hours(active: DataFrame, per_hour: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, date, hour, km, trips) planned, from services by date and (service_id, keys, hour, km, trips)."""
    return active.join(per_hour, "service_id").groupBy(*keys, "date", "hour").agg(total("km").alias("km"), F.sum("trips").alias("trips"))


def holidays(years: DataFrame, year: str = "year") -> DataFrame:
    """(date): the ten public holidays of Belgium in each year."""
    e = easter(year)
    # fixed values: month and day, and days after Easter
    fixed = [(1, 1), (5, 1), (7, 21), (8, 15), (11, 1), (11, 11), (12, 25)]
    days = [F.make_date(F.col(year), F.lit(m), F.lit(d)) for m, d in fixed] + [F.date_add(e, n) for n in (1, 39, 50)]
    return years.select(F.explode(F.array(*days)).alias("date"))


def service_ratios(days: DataFrame, off: DataFrame | None = None, date: str = "date", trips: str = "trips", span: int = REF_DAYS) -> DataFrame:
    """(date, trips, ref, ratio): trips against the lesser of two references, the REF_QUANTILE by nearest rank over days of the same
    kind (weekdays, Saturday, Sunday) in the `span` days before and after, both with the day itself.

    Both sides need MIN_SIDE days. Days in `off` are left out altogether. A weekday's reference under which more than
    GUARD_SHARE of the judged weekdays around would be low isn't a normal day's, and the day isn't judged.
    """
    own = days.select(F.col(date).alias("date"), F.col(trips).cast("double").alias("trips"))
    if off is not None:
        own = own.join(off.select("date"), "date", "left_anti")
    wd = F.weekday("date")
    own = own.withColumn("_kind", F.when(wd < 5, 0).otherwise(wd)).withColumn("_n", F.datediff("date", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy("_kind").orderBy("_n")
    sides = [F.collect_list("trips").over(w.rangeBetween(-span, 0)), F.collect_list("trips").over(w.rangeBetween(0, span))]
    x = own.withColumn("_l", sides[0]).withColumn("_r", sides[1]).filter((F.size("_l") >= MIN_SIDE) & (F.size("_r") >= MIN_SIDE))
    x = x.withColumn("ref", F.least(nearest_rank(F.col("_l"), REF_QUANTILE), nearest_rank(F.col("_r"), REF_QUANTILE))).filter("ref > 0").drop("_l", "_r")
    around = F.collect_list("trips").over(w.rangeBetween(-span, span))
    low = F.size(F.filter("_around", lambda t: t < HOLIDAY_RATIO * F.col("ref")))
    x = x.withColumn("_around", around).filter((F.col("_kind") != 0) | (low <= GUARD_SHARE * F.size("_around")))
    return x.select("date", "trips", "ref", (F.col("trips") / F.col("ref")).alias("ratio"))


def day_classes(ratios: DataFrame, off: DataFrame | None = None) -> DataFrame:
    """(date, service): reduced_service or school_holiday; normal days are left out.

    Low weekdays (under HOLIDAY_RATIO) that follow each other make a run, which weekends don't break and days in `off`
    continue. A low weekday is reduced if it is under REDUCED_RATIO and its run is short or it falls well below the run's
    upper median; a weekend day is reduced under REDUCED_RATIO.
    """
    week = ratios.filter(F.weekday("date") < 5).select("date", "ratio")
    if off is not None:
        bounds = week.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
        pause = off.crossJoin(F.broadcast(bounds)).filter((F.col("date") >= F.col("_a")) & (F.col("date") <= F.col("_b")) & (F.weekday("date") < 5)).select("date").distinct()
        week = week.unionByName(pause.join(week.select("date"), "date", "left_anti"), allowMissingColumns=True)
    # working days since a Monday, so that Friday and Monday follow each other
    n = F.datediff("date", F.lit("1970-01-05").cast("date"))
    low = week.filter((F.col("ratio") < HOLIDAY_RATIO) | F.col("ratio").isNull()).withColumn("_k", F.floor(n / 7) * 5 + F.weekday("date"))
    w = Window.orderBy("_k")
    run = low.withColumn("_new", F.coalesce(F.col("_k") - F.lag("_k").over(w) > 1, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    vals = F.sort_array(F.collect_list("ratio").over(Window.partitionBy("_run")))
    long = run.withColumn("_vals", vals).filter("ratio is not null").select("date", "_vals")
    x = ratios.join(long, "date", "left")
    v, weekday = F.col("ratio"), F.weekday("date") < 5
    middle = F.element_at("_vals", F.floor(F.size("_vals") / 2).cast("int") + 1)
    reduced = (v < REDUCED_RATIO) & (~weekday | (F.size("_vals") < RUN_DAYS) | (v < RUN_DROP * middle))
    kind = F.when(reduced, "reduced_service").when(weekday & (v < HOLIDAY_RATIO), "school_holiday")
    return x.select("date", kind.alias("service")).filter("service is not null")


def exclusions(days: DataFrame, off: DataFrame, classes: DataFrame, periods: DataFrame, holidays_out: bool = True, classes_out: tuple[str, ...] = ("reduced_service",)) -> DataFrame:
    """(date, reason): one reason a day; a public holiday before the service class before a period of the user's."""
    found = periods.select(F.explode(F.sequence("first", "last")).alias("date"), F.lit(3).alias("_p"), F.lit("user_period").alias("reason"))
    found = found.union(classes.filter(F.col("service").isin(*classes_out)).select("date", F.lit(2), "service"))
    if holidays_out:
        found = found.union(off.select("date", F.lit(1), F.lit("holiday")))
    return first_of(found.join(days.select("date"), "date", "left_semi"), ["date"], ["_p", "reason"]).drop("_p")


def categories(days: DataFrame, off: DataFrame, first, last, date: str = "date", trips: str = "trips", pad: int = PAD_DAYS) -> DataFrame:
    """(date, service) of the days from first to last, judged with `pad` days of trips on either side; `off`: public holidays."""
    near = days.filter(F.col(date).between(F.date_sub(F.lit(first), pad), F.date_add(F.lit(last), pad)))
    return day_classes(service_ratios(near, off, date, trips), off).filter(F.col("date").between(first, last))
