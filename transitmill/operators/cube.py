"""Additive sums per day, hour and link, from which all answers are made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import APPROACH_M, BANDS, DEFAULT_HEAD_M, FEED_BAD, FIRST_HOUR, LONG_BANDS, MIN_COVERAGE, MIN_FEED_SHARE, REGULATION_SHARE, TICK_S
from ..functions.exprs import has_flag, in_band, ratio, service_date, service_hour, total

CELL = ["service_date", "hour"]


def band_sums(fixes: DataFrame, keys: list[str], weight: str = "w", stop: str = "stop", long: str = "long") -> DataFrame:
    """Weights per key: o_<band>_<zone> over all, l_<band>_<zone> over long stands; zone r is between stops, s at them."""
    out = []
    for band, hours in BANDS.items():
        for zone, at in (("r", ~F.col(stop)), ("s", F.col(stop))):
            out.append(total(weight, in_band("hour", hours) & at).alias(f"o_{band}_{zone}"))
            if band in LONG_BANDS:
                out.append(total(weight, in_band("hour", hours) & at & F.col(long)).alias(f"l_{band}_{zone}"))
    return fixes.groupBy(*keys).agg(*out)


def band_passages(passages: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    return passages.groupBy(*keys).agg(*[total(n, in_band("hour", hours)).alias(f"p_{band}") for band, hours in BANDS.items()])


def cube(fixes: DataFrame, passages: DataFrame, hours: DataFrame, keys: list[str], scope: list[str] | None = None) -> DataFrame:
    """band_sums and band_passages of usable hours, side by side. `scope` names what the hours are usable for, such as the line."""
    both = band_sums(fixes, keys).join(band_passages(passages.join(hours, [*(scope or []), *CELL], "left_semi"), keys), keys, "full")
    return both.fillna(0.0, [c for c in both.columns if c[:2] in ("o_", "l_", "p_")])


def hourly(fixes: DataFrame, passages: DataFrame, hours: DataFrame, keys: list[str] | None = None, scope: list[str] | None = None) -> DataFrame:
    """Per (scope, date, hour, link): passages of any hour, weights of usable ones, whether the hour is usable (ok), and whether
    positions saw MIN_FEED_SHARE of the passages of its whole (scope, date, hour) too (spd_ok)."""
    scope = scope or []
    keys = keys or [*scope, *CELL, "link_key"]
    at = F.col("stop")
    o = fixes.groupBy(*keys).agg(total("w", ~at).alias("o_r"), total("w", at).alias("o_s"), total("w", ~at & F.col("long")).alias("l_r"), total("w", at & F.col("long")).alias("l_s"))
    n = passages.groupBy(*keys).agg(total("n").alias("n"), total("n_feed").alias("_f"))
    x = o.join(n, keys, "full").join(hours.withColumn("ok", F.lit(True)), [*scope, *CELL], "left")
    x = x.fillna(False, ["ok"]).fillna(0.0, ["n", "_f", "o_r", "o_s", "l_r", "l_s"])
    whole = Window.partitionBy(*scope, *CELL)
    return x.withColumn("spd_ok", F.col("ok") & (F.sum("_f").over(whole) >= MIN_FEED_SHARE * F.sum("n").over(whole))).drop("_f")


def line_hours(h: DataFrame, links: DataFrame, head: DataFrame | None = None, keys: list[str] | None = None, scope: list[str] | None = None) -> DataFrame:
    """Per (date, hour): km over all links; metres and seconds of usable hours over whole links (d_s, t_s) and between stop zones
    (d_r, t_r), without a main route's first and last links, links of unknown role and those where vehicles wait."""
    on = [*(scope or []), "link_key"]
    x = h.join(links.select(*on, "len_m", "term", "reg", "reg_r"), on, "left")
    if head is not None:
        x = x.join(head, on, "left")
    else:
        x = x.withColumn("head_m", F.lit(None).cast("double"))
    between = F.greatest(F.col("len_m") - F.coalesce("head_m", F.lit(float(DEFAULT_HEAD_M))) - APPROACH_M, F.lit(0.0))
    use = F.col("spd_ok") & (F.col("term") != 1)
    whole, inner = use & ~F.coalesce("reg", F.lit(False)), use & ~F.coalesce("reg_r", F.lit(False))
    return x.groupBy(*(keys or [*(scope or []), *CELL])).agg(
        (total(F.col("n") * F.col("len_m")) / 1000).alias("km"), total(F.col("n") * F.col("len_m"), whole).alias("d_s"), total((F.col("o_r") + F.col("o_s")) * TICK_S, whole).alias("t_s"),
        total(F.col("n") * between, inner).alias("d_r"), total(F.col("o_r") * TICK_S, inner).alias("t_r"),
    )


def on_service_day(passages: DataFrame, keys: list[str], first: int = FIRST_HOUR) -> DataFrame:
    """Passages filed by clock hour to their service day; both sources are summed where rows meet, and n is the larger."""
    moved = passages.withColumn("_d", service_date("service_date", "hour", first)).withColumn("_h", service_hour("hour", first))
    out = moved.groupBy(F.col("_d").alias("service_date"), F.col("_h").alias("hour"), *keys).agg(total("n_feed").alias("n_feed"), total("n_events").alias("n_events"))
    return out.withColumn("n", F.greatest("n_feed", "n_events"))


def both_sources(feed: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Passages of two sources in one table, n the larger; a key that one of them lacks counts 0 there."""
    both = feed.join(events, keys, "full").fillna(0.0, ["n_feed", "n_events"])
    return both.withColumn("n", F.greatest("n_feed", "n_events"))


def link_roles(links: DataFrame, patterns: DataFrame, pattern_days: DataFrame | None = None, scope: list[str] | None = None) -> DataFrame:
    """(scope, link_key, from_name, to_name, len_m, term): term 1 for the first and last links of main patterns, 2 for links that touch
    a stop where any pattern ends, else 0; the median length; names of the least pattern and index."""
    own = scope or []
    w = Window.partitionBy(*own, "pattern_uid")
    x = links.withColumn("_m", F.max("link_idx").over(w))
    if pattern_days is not None:
        x = x.join(pattern_days.filter("is_main").select("pattern_uid").distinct().withColumn("_main", F.lit(True)), "pattern_uid", "left").fillna(False, ["_main"])
    else:
        x = x.withColumn("_main", F.lit(True))
    ends = patterns.select(*own, F.explode(F.array(F.element_at("stop_ids", 1), F.element_at("stop_ids", -1))).alias("_stop")).distinct()
    x = x.join(ends.select(*own, F.col("_stop").alias("from_stop"), F.lit(True).alias("_a")), [*own, "from_stop"], "left").join(ends.select(*own, F.col("_stop").alias("to_stop"), F.lit(True).alias("_b")), [*own, "to_stop"], "left")
    terminal = F.bool_or(F.col("_main") & ((F.col("link_idx") == 0) | (F.col("link_idx") == F.col("_m"))))
    touches = F.bool_or(F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False)))
    least = F.struct("pattern_uid", "link_idx")
    return x.groupBy(*own, "link_key").agg(F.min_by("from_name", least).alias("from_name"), F.min_by("to_name", least).alias("to_name"), F.median("len_m").alias("len_m"), F.when(terminal, 1).when(touches, 2).otherwise(0).alias("term"))


def regulated(days: DataFrame, keys: list[str], skip: list | None = None, date: str = "service_date") -> DataFrame:
    """(keys, reg, reg_r): links where long stands make up REGULATION_SHARE of what a passage loses by day over the evening, over
    both zones and between stops only. Weekdays not skipped; links without passages in either band aren't judged."""
    keep = F.weekday(date) < 5
    if skip:
        keep = keep & ~F.col(date).isin(skip)
    cols = [f"{p}_{b}_{z}" for p in "ol" for b in LONG_BANDS for z in "rs"] + ["p_day", "p_eve"]
    x = days.filter(keep).groupBy(*keys).agg(*[total(c).alias(c) for c in cols]).filter("p_day > 0 and p_eve > 0")

    def judged(zones: str):
        lost = lambda p: ratio(sum(F.col(f"{p}_day_{z}") for z in zones), "p_day") - ratio(sum(F.col(f"{p}_eve_{z}") for z in zones), "p_eve")
        return (lost("o") > 0) & (lost("l") >= REGULATION_SHARE * lost("o"))

    return x.select(*keys, judged("rs").alias("reg"), judged("r").alias("reg_r"))


def with_feed(hours: DataFrame, coverage: DataFrame) -> DataFrame:
    """hours with feed_ok: the whole feed is there in that hour."""
    ok = coverage.select(*CELL, ((F.col("coverage") >= MIN_COVERAGE) & ~has_flag("flags", FEED_BAD)).alias("feed_ok"))
    return hours.drop("feed_ok").join(ok, CELL, "left").fillna(False, ["feed_ok"])
