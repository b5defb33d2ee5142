"""What a page shows: composite answers over the daily tables, each from one or two aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MIN_FIXES, MIN_STOP_DAYS, SPARSE_SHARE, TICK_S
from ..functions.exprs import in_band, ratio, title_case, total
from . import stretches
from .regularity import COUNTS, SUMS
from .windows import first_of, top_n


def regularity_scopes(hw: DataFrame, hours: tuple[int, int] | None = None) -> DataFrame:
    """(line, scope, hour, direction_id, stop_id, sums): summed headways of each line in all, of each hour and of each stop.

    One pass with grouping sets. The total and the stops count the hours asked for; the hours count every hour. What a scope
    doesn't split by is null.
    """
    asked = F.lit(True) if hours is None else in_band("hour", hours)
    cols = COUNTS + SUMS
    line, hour, stop = F.col("line"), F.col("hour"), [F.col("direction_id"), F.col("stop_id")]
    sets = hw.withColumn("_in", asked).groupingSets([[line], [line, hour], [line, *stop]], line, hour, *stop)
    x = sets.agg(F.grouping("hour").alias("_h"), F.grouping("stop_id").alias("_s"), F.max("_in").alias("_any"), *[total(c).alias(c) for c in cols], *[total(c, F.col("_in")).alias(f"_{c}") for c in cols])
    by_hour = F.col("_h") == 0
    scope = F.when(by_hour, "hour").when(F.col("_s") == 0, "stop").otherwise("total")
    return x.filter(by_hour | F.col("_any")).select("line", scope.alias("scope"), "hour", "direction_id", "stop_id", *[F.when(by_hour, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in cols])


def route_stops(stops: DataFrame, offsets: DataFrame, keys: Sequence[str] = ("line", "direction_id")) -> DataFrame:
    """The stops of a route by their mean time after its start, weighted by days; those seen on few days go.

    `stops` says which stops have headways, `offsets` has off_s and days of each period. A stop without an offset has no days.
    A stop stays if it has MIN_STOP_DAYS of the days that the best one of its direction has. Equal times are ordered by id.
    """
    at = [*keys, "stop_id"]
    mean = offsets.groupBy(*at).agg(ratio(total(F.col("off_s") * F.col("days")), total("days")).alias("off_s"), F.sum("days").alias("days"))
    x = stops.select(*at).distinct().join(mean, at, "left").withColumn("days", F.coalesce("days", F.lit(0)))
    route = Window.partitionBy(*keys)
    x = x.withColumn("_most", F.max("days").over(route)).filter(F.col("days") >= MIN_STOP_DAYS * F.col("_most")).drop("_most")
    return x.withColumn("place", F.row_number().over(route.orderBy(F.round("off_s", 3).asc_nulls_last(), "stop_id")))


def default_window(months: DataFrame, ingested: DataFrame, n: int = 1, month: str = "month", date: str = "date") -> DataFrame:
    """(first, last): the dates of the last n months in `months` (first days) that are ingested to their end. Null if there are none."""
    newest = ingested.agg(F.max(date)).scalar()
    whole = months.select(F.col(month).alias("_m")).distinct().filter(F.last_day("_m") <= newest)
    return top_n(whole, [F.col("_m").desc()], n).agg(F.min("_m").alias("first"), F.last_day(F.max("_m")).alias("last"))


def newest_lines(routes: DataFrame, line: str = "line", since: str = "since", tie: Sequence[str] = ()) -> DataFrame:
    """One row a line, from the newest feed that has it, and `gone`: the newest feed of all no longer does."""
    newest = routes.agg(F.max(since)).scalar()
    return first_of(routes, [line], [F.col(since).desc(), *tie]).withColumn("gone", F.col(since) < newest)


def ranked_lists(x: DataFrame, days_per_year: int, top: int = 50, flagged: int = 10, key: str = "link_key") -> DataFrame:
    """(list, rank, key, veh_h_day, veh_h_year, s_per_passage, reasons): the costliest links without a reason to flag them, and the
    costliest ones with one. Rows of several lines are added up within each list; only links that lose time are listed."""
    listed = F.when(F.col("reason").isNull(), "kept").otherwise("flagged")
    lose = x.withColumn("list", listed).filter((F.col("list") == "kept") | (F.col("veh_s_day") > 0))
    sums = lose.groupBy("list", key).agg(total("veh_s_day").alias("_v"), total("passages_day").alias("_p"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons")).filter("_v > 0")
    out = [top_n(sums.filter(F.col("list") == name), [F.col("_v").desc(), key], n) for name, n in (("kept", top), ("flagged", flagged))]
    hours = F.col("_v") / 3600
    return out[0].unionByName(out[1]).select("list", "rank", key, hours.alias("veh_h_day"), (hours * days_per_year).alias("veh_h_year"), ratio("_v", "_p").alias("s_per_passage"), "reasons")


def stretch_sums(x: DataFrame, geometry: DataFrame | None = None, key: str = "link_key") -> DataFrame:
    """One row a stretch of the rows (line, link) of x: sums, its links, and an entry a line, costliest first.

    With a geometry (key, geometry), links under the same two names that run along each other are one stretch, named by the
    costliest; else each link is its own.
    """
    names = [c for c in ("from_name", "to_name", "len_m") if c in x.columns]
    if geometry is not None:
        each = x.groupBy(key).agg(F.sum("veh_s_day").alias("cost"), *[title_case(F.min(c)).alias(c) for c in names[:2]])
        x = x.join(stretches.merge(each.join(geometry, key, "left"), key), key)
    else:
        x = x.withColumn("stretch", F.col(key))
    cols = ["veh_s_day", "veh_s_day_run", "veh_s_day_stop", "passages_day"]
    hours = lambda c: (F.col(c) / 3600).alias(c.replace("_s_", "_h_"))
    entry = F.struct((-F.col("veh_s_day")).alias("_o"), F.col("line"), *map(hours, cols[:3]), "passages_day", "peak", "n_days", "reason", F.col("reg_share").alias("stand_share"))
    drop_order = lambda e: F.struct(*[e[c].alias(c) for c in ("line", "veh_h_day", "veh_h_day_run", "veh_h_day_stop", "passages_day", "peak", "n_days", "reason", "stand_share")])
    own = F.col(key) == F.col("stretch")
    g = x.groupBy("stretch").agg(*[total(c).alias(c) for c in cols], F.array_sort(F.collect_set(key)).alias("link_keys"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.transform(F.array_sort(F.collect_list(entry)), drop_order).alias("lines"), *[F.min(F.when(own, F.col(c))).alias(c) for c in names])
    return g.withColumns({c: title_case(c) for c in names[:2]})


def stretch_rows(sums: DataFrame, n: int, days_per_year: int) -> DataFrame:
    """The n costliest of stretch_sums() that lose time, as rows of the answer."""
    best = top_n(sums.filter("veh_s_day > 0"), [F.col("veh_s_day").desc(), "stretch"], n)
    hours = lambda c: F.col(c) / 3600
    named = [c for c in ("from_name", "to_name", "len_m") if c in sums.columns]
    return best.select("rank", F.col("stretch").alias("link_key"), "link_keys", *named, hours("veh_s_day").alias("veh_h_day"), (hours("veh_s_day") * days_per_year).alias("veh_h_year"), hours("veh_s_day_run").alias("veh_h_day_run"), hours("veh_s_day_stop").alias("veh_h_day_stop"), "passages_day", ratio("veh_s_day", "passages_day").alias("s_per_passage"), "reasons", "lines")


def excluded_days(excluded: DataFrame, present: DataFrame, weekdays: Sequence[int] = (0, 1, 2, 3, 4), date: str = "date") -> DataFrame:
    """(reason, n): days of the chosen weekdays that have data and are left out, by reason."""
    seen = present.select(date).distinct()
    return excluded.filter(F.weekday(date).isin(*weekdays)).join(seen, date, "left_semi").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def month_days(dates: DataFrame, first, last, weekdays: Sequence[int] = (0, 1, 2, 3, 4), date: str = "date") -> DataFrame:
    """(month, days, days_all, days_in_month, complete): of the ingested dates in the window, those of the chosen weekdays and all, by
    month; a month is complete if the window holds it whole and each of its dates is ingested."""
    own = dates.select(F.col(date).alias("_d")).distinct().filter(F.col("_d").between(first, last))
    g = own.groupBy(F.trunc("_d", "month").alias("month")).agg(F.count(F.when(F.weekday("_d").isin(*weekdays), F.lit(1))).alias("days"), F.count(F.lit(1)).alias("days_all"))
    size = F.day(F.last_day("month")).cast("long")
    return g.select("month", "days", "days_all", size.alias("days_in_month"), (F.col("days_all") == size).alias("complete"))


def segment_excess(cube: DataFrame, passages: DataFrame, hours: tuple[int, int], reference: tuple[int, int] = (20, 24), key: str = "link_key", tick: int = TICK_S) -> DataFrame:
    """(key, seg, s_passage, ref_s, excess_s, excess_h): seconds that a passage spends in each segment in the chosen hours and in the
    reference hours, their difference, and the hours lost in all.

    `cube` has fixes (n) by key, segment and hour, `passages` n by key and hour. A segment needs passages in both bands; one
    without fixes in a band took no time there.
    """
    both = lambda n: [total(n, in_band("hour", hours)).alias("_a"), total(n, in_band("hour", reference)).alias("_b")]
    p = passages.groupBy(key).agg(*both("n")).filter("_a > 0 and _b > 0").withColumnsRenamed({"_a": "_pa", "_b": "_pb"})
    x = cube.groupBy(key, "seg").agg(*both("n")).join(p, key)
    x = x.select(key, "seg", "_pa", (ratio("_a", "_pa") * tick).alias("s_passage"), (ratio("_b", "_pb") * tick).alias("ref_s"))
    lost = F.col("s_passage") - F.col("ref_s")
    return x.select(key, "seg", "s_passage", "ref_s", lost.alias("excess_s"), (lost * F.col("_pa") / 3600).alias("excess_h"))


def wait_change(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ew_a, ew_b, change): excess waits in seconds of two periods from their summed headways, and how much they grew. Keys that
    one period lacks, or that have no headways of either kind there, go."""
    ew = (ratio("r2", F.col("r1") * 2) - ratio("s2", F.col("s1") * 2)).alias("_e")
    side = lambda x, name: x.select(*keys, ew).filter("_e is not null").withColumnRenamed("_e", name)
    return side(a, "ew_a").join(side(b, "ew_b"), list(keys)).withColumn("change", F.col("ew_b") - F.col("ew_a"))


def segment_lengths(fixes: DataFrame, links: DataFrame, lengths: Sequence[float], key: str = "link_key", pos: str = "pos_m", size: str = "len_m") -> DataFrame:
    """(length, segments, fixes, sparse, recommended): for each segment length, the segments, the mean of their fixes and the share of
    them with under MIN_FIXES; the shortest length with at most SPARSE_SHARE of these is recommended, or none.

    Fixes are first counted by whole metre, so that each length reads these counts and not the fixes again.
    """
    metres = fixes.join(links.select(key, size), key).groupBy(key, size, F.floor(pos).alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    choices = F.explode(F.array(*[F.lit(float(x)) for x in lengths])).alias("length")
    pieces = F.greatest(F.round(F.col(size) / F.col("length")).cast("int"), F.lit(1))
    at = F.least(F.greatest(F.floor(F.col("_m") * pieces / F.col(size)).cast("int"), F.lit(0)), pieces - 1)
    held = metres.select("*", choices).groupBy("length", key, at.alias("_seg")).agg(F.sum("_n").alias("_n"))
    seen = held.groupBy("length").agg(F.sum("_n").alias("_n"), F.count(F.when(F.col("_n") >= MIN_FIXES, F.lit(1))).alias("_full"))
    cut = links.select(key, size, choices).groupBy("length").agg(F.sum(pieces).alias("segments"))
    x = cut.join(F.broadcast(seen), "length", "left").fillna(0, ["_n", "_full"])
    x = x.select("length", "segments", ratio("_n", "segments").alias("fixes"), (1 - ratio("_full", "segments")).alias("sparse"))
    best = F.min(F.when(F.col("sparse") <= SPARSE_SHARE, F.col("length"))).over(Window.partitionBy(F.lit(0)))
    return x.withColumn("recommended", F.coalesce(F.col("length") == best, F.lit(False)))


def two_sided(x: DataFrame, value: str, n: int, tie: str = "link_key") -> DataFrame:
    """The n rows of greatest positive value (side "up") and of least negative value ("down"), each with its rank."""
    side = lambda keep, order, name: top_n(x.filter(keep), [order, tie], n).withColumn("side", F.lit(name))
    return side(F.col(value) > 0, F.col(value).desc(), "up").unionByName(side(F.col(value) < 0, F.col(value).asc(), "down"))


def in_line_order(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds `place` to a list of lines: shorter names first, so that 9 stands before 10, then by text."""
    return lines.withColumn("place", F.row_number().over(Window.orderBy(F.length(line), line)))
