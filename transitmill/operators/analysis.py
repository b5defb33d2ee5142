"""Segments of links, two-period comparison and bootstrap intervals. The definitions of placement and segments are this library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, total


def placed(rows: DataFrame, lengths: DataFrame, learned: DataFrame, keys: list[str], dist: str = "dist") -> DataFrame:
    """Adds pos_m: the distance from the point, scaled by the link's length over its learned feed length."""
    x = rows.join(lengths, keys).join(learned.select(*keys, "flen"), keys, "left")
    return x.withColumn("pos_m", F.least(F.col("len_m"), F.col(dist) * F.coalesce(ratio("len_m", "flen"), F.lit(1.0))))


def feed_lengths(rows: DataFrame, keys: list[str], dist: str = "dist") -> DataFrame:
    """(keys, flen, n): a link's length as the feed has it, its 99.5th percentile of distances."""
    return rows.groupBy(*keys).agg(F.percentile(dist, F.lit(0.995)).alias("flen"), F.count(F.lit(1)).alias("n"))


def passages(rows: DataFrame, track: str, order: list, keys: list[str], date: str = "service_date", hour: str = "hour") -> DataFrame:
    """(date, hour, keys, n_feed): times that a track enters a link."""
    w = Window.partitionBy(track).orderBy(*order)
    enters = F.lit(False)
    for k in keys:
        enters = enters | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    return rows.withColumn("_e", enters).filter("_e").groupBy(date, hour, *keys).agg(F.count(F.lit(1)).cast("double").alias("n_feed"))


def segments(links: DataFrame, length: float = 30.0, phase: float = 0.0, grid: str = "stops", key: str = "link_key", size: str = "len_m") -> DataFrame:
    """(link, seg, a_m, b_m): links cut into pieces: "stops": of equal length nearest to `length`; "equal": rounded up to as many as needed;
    "fixed": of just `length`, from `phase` on, the ends shorter."""
    if grid == "fixed":
        shift = phase % length - length if phase % length else 0.0
        x = links.select(key, size, F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col(size) - shift - 1e-9, F.lit(0.0)) / length).cast("int"))).alias("seg"))
        return x.select(key, "seg", F.greatest(F.col("seg") * length + shift, F.lit(0.0)).alias("a_m"), F.least(F.col(size), (F.col("seg") + 1) * length + shift).alias("b_m"))
    n = F.round(F.col(size) / length) if grid == "stops" else F.ceil(F.col(size) / length)
    x = links.withColumn("_n", F.greatest(n.cast("int"), F.lit(1))).select(key, size, "_n", F.explode(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(1)) - 1)).alias("seg"))
    return x.select(key, "seg", (F.col(size) * F.col("seg") / F.col("_n")).alias("a_m"), (F.col(size) * (F.col("seg") + 1) / F.col("_n")).alias("b_m"))


def segment_counts(fixes: DataFrame, links: DataFrame, length: float = 30.0, key: str = "link_key", pos: str = "pos_m", size: str = "len_m", extra: list[str] | None = None) -> DataFrame:
    """(extra, link, seg, n): fixes per piece, by arithmetic on their position, without joining the pieces."""
    n = F.greatest(F.round(F.col(size) / length).cast("int"), F.lit(1))
    at = F.least(F.greatest(F.floor(F.col(pos) * n / F.col(size)).cast("int"), F.lit(0)), n - 1)
    return fixes.join(links.select(key, size), key).groupBy(*(extra or []), key, at.alias("seg")).agg(F.count(F.lit(1)).alias("n"))


def compared(a: DataFrame, b: DataFrame, key: str = "link_key", least: float = 5.0) -> DataFrame:
    """Links of both periods with `least` passages a day: speed difference, seconds a passage and hours a day, from v (km/h), pd and len_m."""
    x = a.select(key, F.col("v").alias("_va"), F.col("pd").alias("_pa"), "len_m").join(b.select(key, F.col("v").alias("_vb"), F.col("pd").alias("_pb")), key)
    x = x.filter((F.col("_pa") >= least) & (F.col("_pb") >= least))
    ds = ratio(F.col("len_m") * 3.6, "_va") - ratio(F.col("len_m") * 3.6, "_vb")
    return x.select(key, (F.col("_va") - F.col("_vb")).alias("dv"), ds.alias("ds"), (ds * F.col("_pa") / 3600).alias("dh"))


def resampled(daily: DataFrame, keys: list[str], value: str, weight: str, rounds: int, seed: int = 1, date: str = "service_date") -> DataFrame:
    """(keys, _b, _r): the ratio of sums of value and weight in each round of resampled days.

    Each round draws how often each day counts, Poisson with mean 1, from a hash of seed, round and day: the same for all keys, and
    the same at every run. Rows are first added up by key and day; each day's sums are multiplied by the rounds and summed at once.
    """
    # cumulative probabilities of a Poisson variable of mean 1
    steps, p = [], 0.36787944117144233
    acc, term = p, p
    for k in range(1, 8):
        steps.append(acc)
        term /= k
        acc += term
    draw = F.pmod(F.xxhash64(F.lit(seed), "_b", date), F.lit(1 << 30)) / float(1 << 30)
    count = sum((F.when(draw >= s, 1).otherwise(0) for s in steps), F.lit(0))
    days = daily.groupBy(*keys, date).agg(total(value).alias("_v"), total(weight).alias("_w"))
    rounds_of = days.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_k", count)
    return rounds_of.groupBy(*keys, "_b").agg(ratio(total(F.col("_v") * F.col("_k")), total(F.col("_w") * F.col("_k"))).alias("_r"))


def interval(each: DataFrame, keys: list[str], level: float) -> DataFrame:
    """(keys, lo, hi): the middle `level` of _r over the rounds."""
    tail = (1 - level) / 2
    return each.groupBy(*keys).agg(F.percentile("_r", F.lit(tail)).alias("lo"), F.percentile("_r", F.lit(1 - tail)).alias("hi"))


def bootstrap(daily: DataFrame, keys: list[str], value: str, weight: str, rounds: int = 200, seed: int = 1, date: str = "service_date", level: float = 0.9) -> DataFrame:
    """(keys, est, lo, hi): ratio of sums of value and weight, with an interval from resampled days."""
    est = daily.groupBy(*keys).agg(ratio(total(value), total(weight)).alias("est"))
    return est.join(interval(resampled(daily, keys, value, weight, rounds, seed, date), keys, level), keys)


def bootstrap_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str, weight: str, rounds: int = 100, seed: int = 1, date: str = "service_date", level: float = 0.9) -> DataFrame:
    """(keys, est, lo, hi, sure): the ratio of period a less that of period b for keys of both, with an interval from days that are
    resampled in each period by itself; `sure` if the interval leaves zero out."""
    est = lambda x, name: x.groupBy(*keys).agg(ratio(total(value), total(weight)).alias(name))
    both = est(a, "_a").join(est(b, "_c"), keys).select(*keys, (F.col("_a") - F.col("_c")).alias("est"))
    draws = resampled(a, keys, value, weight, rounds, seed, date).join(resampled(b, keys, value, weight, rounds, seed + 1, date).withColumnRenamed("_r", "_c"), [*keys, "_b"])
    lim = interval(draws.withColumn("_r", F.col("_r") - F.col("_c")), keys, level)
    return both.join(lim, keys).withColumn("sure", (F.col("lo") > 0) | (F.col("hi") < 0))


def month_delta(df: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """Adds `prev`: the value of the month just before, null if that month is missing. `month` is the first day of each."""
    w = Window.partitionBy(*keys).orderBy(month)
    return df.withColumn("prev", F.when(F.add_months(F.lag(month).over(w), 1) == F.col(month), F.lag(value).over(w)))


def hotspots(daily: DataFrame, keys: list[str], place: str, value: str, weight: str, rounds: int = 200, seed: int = 1, date: str = "service_date", level: float = 0.9, least: float = 0.0) -> DataFrame:
    """(keys, first, last, n, est, lo, hi): runs of neighbouring places that lose surely more than `least` a passage, over resampled days.

    A place's loss is the ratio of its sums of value and weight over the days; it counts if the lower end of its interval lies
    over `least`. Places next to each other by number make one run, whose loss is the sum of its places' and whose interval
    comes from the same draws of days, as places of one day go together. A place without weight in a draw adds nothing to it;
    one without weight at all is no part of a run.
    """
    each = resampled(daily, [*keys, place], value, weight, rounds, seed, date)
    sure = interval(each, [*keys, place], level).filter(F.col("lo") > least).select(*keys, place)
    w = Window.partitionBy(*keys).orderBy(place)
    # of neighbours, the place less the number of hot places before it stays the same
    runs = sure.withColumn("_run", F.col(place) - F.row_number().over(w))
    est = daily.groupBy(*keys, place).agg(ratio(total(value), total(weight)).alias("_e")).join(runs, [*keys, place])
    whole = est.groupBy(*keys, "_run").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"), F.sum("_e").alias("est"))
    draws = each.join(runs, [*keys, place]).groupBy(*keys, "_run", "_b").agg(F.sum("_r").alias("_r"))
    return whole.join(interval(draws, [*keys, "_run"], level), [*keys, "_run"]).drop("_run")
