"""The costliest links: time lost by day over the evening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BANDS, LONG_BANDS, MIN_DAYS, REGULATION_SHARE, TICK_S
from ..functions.exprs import in_band, ratio, total
from .windows import first_of, top_n


def window_sums(cube: DataFrame, keep, keys: list[str], min_days: int = MIN_DAYS) -> DataFrame:
    """The cube's sums over the chosen rows, with the days that had passages; links of fewer than min_days go."""
    cols = [c for c in cube.columns if c[:2] in ("o_", "l_", "p_")]
    x = cube.filter(keep).groupBy(*keys).agg(*[total(c).alias(c) for c in cols], F.count(F.when(F.col("p_day") > 0, F.lit(1))).alias("n_days"))
    return x.filter(F.col("n_days") >= min_days)


def hour_cube(hourly: DataFrame, hours: tuple[int, int], keys: list[str]) -> DataFrame:
    """The cube's columns from an hourly table, with the chosen hours as the day band; the other bands stay what they are. Only hours in
    which positions hold the line (spd_ok) count. `keys` hold the date, so that days with passages can be counted."""
    out = []
    for band, span in (BANDS | {"day": hours}).items():
        inside = in_band("hour", span)
        out += [total("o_r", inside).alias(f"o_{band}_r"), total("o_s", inside).alias(f"o_{band}_s"), total("n", inside).alias(f"p_{band}")]
        if band in LONG_BANDS:
            out += [total("l_r", inside).alias(f"l_{band}_r"), total("l_s", inside).alias(f"l_{band}_s")]
    return hourly.filter("spd_ok").groupBy(*keys).agg(*out)


def excess(sums: DataFrame, days: str = "D", stops: bool = False, tick: int = TICK_S) -> DataFrame:
    """Seconds that a passage loses over the evening (ex; between stops, at stops, in long stands, in the two peaks), passages a
    day and vehicle seconds lost a day. Links need passages by day and in the evening; a peak without passages is null."""
    zone = lambda p, b: F.col(f"{p}_{b}_r") + F.col(f"{p}_{b}_s") if stops else F.col(f"{p}_{b}_r")
    lost = lambda day, eve, p="p_day": (ratio(day, p) - ratio(eve, "p_eve")) * tick
    x = sums.filter("p_day > 0 and p_eve > 0").withColumns({
        "ex": lost(zone("o", "day"), zone("o", "eve")), "ex_r": lost("o_day_r", "o_eve_r"), "ex_s": lost("o_day_s", "o_eve_s"),
        "ex_long": lost(zone("l", "day"), zone("l", "eve")), "ex_am": lost(zone("o", "am"), zone("o", "eve"), "p_am"), "ex_pm": lost(zone("o", "pm"), zone("o", "eve"), "p_pm"),
        "passages_day": ratio("p_day", days),
    })
    return x.withColumns({
        "veh_s_day": F.col("ex") * F.col("passages_day"), "veh_s_day_run": F.col("ex_r") * F.col("passages_day"), "veh_s_day_stop": F.col("ex_s") * F.col("passages_day"),
        "reg_share": F.when(F.col("ex") > 0, ratio("ex_long", "ex")),
    })


def best_role(links: DataFrame) -> DataFrame:
    """One row a (line, link_key) over months: the highest role, null before all."""
    return first_of(links, ["line", "link_key"], [F.col("term").desc_nulls_first(), "from_name", "to_name"])


def reasons(x: DataFrame, roles: DataFrame, keys: tuple[str, ...] = ("line", "link_key")) -> DataFrame:
    """Adds the reason to flag a link (terminus, short_terminus, holding) and the peak of its excess (am, pm, day)."""
    held = F.coalesce("reg_share", F.lit(0.0)) >= REGULATION_SHARE
    am, pm = F.coalesce("ex_am", F.lit(0.0)), F.coalesce("ex_pm", F.lit(0.0))
    reason = F.when(F.col("term") == 1, "terminus").when(held & (F.col("term") == 2), "short_terminus").when(held, "holding")
    peak = F.when(am > 1.25 * pm, "am").when(pm > 1.25 * am, "pm").otherwise("day")
    return x.join(roles, list(keys), "left").withColumns({"reason": reason, "peak": peak})


def ranked(x: DataFrame, groups: DataFrame | None, n: int, key: str = "link_key", value: str = "veh_s_day", per_line: str = "line") -> DataFrame:
    """The n links (or groups of links, if `groups` maps link_key to stretch) that lose most, with their lines, costliest first."""
    if groups is not None:
        x = x.join(groups, key, "left").withColumn("stretch", F.coalesce("stretch", F.col(key)))
    else:
        x = x.withColumn("stretch", F.col(key))
    line = F.struct((-F.col(value)).alias("_o"), F.col(per_line).alias("line"), F.col(value).alias("v"))
    sums = x.groupBy("stretch").agg(total(value).alias(value), total("passages_day").alias("passages_day"), F.array_join(F.array_sort(F.collect_set(key)), ",").alias("link_keys"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"].cast("string")), ",").alias("lines"))
    return top_n(sums.filter(F.col(value) > 0), [F.col(value).desc(), "stretch"], n)


def totals(x: DataFrame, keys: list[str], value: str = "veh_s_day") -> DataFrame:
    """Sum of what is lost and number of links that lose anything."""
    return x.groupBy(*keys).agg(total(value, F.col(value) > 0).alias("lost"), F.count(F.when(F.col(value) > 0, F.lit(1))).alias("n"))
