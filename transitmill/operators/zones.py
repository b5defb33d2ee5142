"""Stands, departure marks and stop zones of located fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import APPROACH_M, DEFAULT_HEAD_M, MARK_MIN, MARK_RANGE, MARK_SHARE, STAND_GAP_S, STAND_LONG_S, STAND_MOVE_M
from .windows import sessions


def stands(fixes: DataFrame, track: str = "track_id", ts: str = "ts", position: str = "s_m", tie: list[str] | None = None) -> DataFrame:
    """fixes with `long`: part of a stand of STAND_LONG_S seconds or more. ts is in epoch seconds."""
    return sessions(fixes, [track], ts, position, [ts, *(tie or [])], STAND_GAP_S, STAND_MOVE_M, STAND_LONG_S).drop("session")


def departures(fixes: DataFrame, at_stop: str = "at_stop", tie: list[str] | None = None) -> DataFrame:
    """Fixes away from a stop that are their track's first, or follow one on the link before of the same pattern. `tie` orders fixes of one time."""
    w = Window.partitionBy("track_id").orderBy("ts", *(tie or []))
    came = (F.lag("link_idx").over(w) == F.col("link_idx") - 1) & (F.lag("pattern_uid").over(w) == F.col("pattern_uid"))
    return fixes.withColumn("_from", came | (F.row_number().over(w) == 1)).filter(F.coalesce("_from", F.lit(False)) & ~F.col(at_stop)).drop("_from")


def marks(rows: DataFrame, keys: list[str], distance: str, between: tuple[int, int] = MARK_RANGE, least: int = MARK_MIN, share: float = MARK_SHARE) -> DataFrame:
    """(keys, mark_m, n, share): even distances within `between` that hold `least` rows and `share` of the key's rows there."""
    counts = rows.filter(F.col(distance).between(*between)).groupBy(*keys, F.col(distance).alias("mark_m")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    return whole.filter((F.col("mark_m") % 2 == 0) & (F.col("n") >= least) & (F.col("share") >= share))


def heads(marked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, head_m): where the stop zone at a link's start ends, one metre after its furthest mark."""
    return marked.groupBy(*keys).agg((F.ceil(F.max("mark_m")) + 1).cast("double").alias("head_m"))


def with_zone(fixes: DataFrame, lengths: DataFrame, head: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """fixes with `stop`: within the zone after a link's start or the one before its end."""
    own = scope or []
    x = fixes.join(lengths.select(*own, "pattern_uid", "link_idx", F.col("len_m").alias("_len")), [*own, "pattern_uid", "link_idx"], "left").join(head, [*own, "link_key"], "left")
    near = (F.col("pos_m") <= F.coalesce("head_m", F.lit(float(DEFAULT_HEAD_M)))) | (F.col("pos_m") > F.col("_len") - APPROACH_M)
    return x.withColumn("stop", F.coalesce(near, F.lit(False))).drop("_len", "head_m")


def prepared(fixes: DataFrame, marked: DataFrame, head: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Fixes that sit on a mark are moved to half a metre before the zone's end if they lie beyond it; s_m moves along."""
    own = scope or []
    on = marked.select(*own, "link_key", F.col("mark_m").alias("raw_dist_m"), F.lit(True).alias("_on")).distinct()
    x = fixes.join(on, [*own, "link_key", "raw_dist_m"], "left").join(head, [*own, "link_key"], "left")
    end = F.coalesce("head_m", F.lit(float(DEFAULT_HEAD_M))) - 0.5
    pos = F.when(F.col("_on") & (F.col("pos_m") > end), end).otherwise(F.col("pos_m"))
    return x.withColumn("s_m", F.col("s_m") + pos - F.col("pos_m")).withColumn("pos_m", pos).drop("_on", "head_m")


def usable_fixes(fixes: DataFrame, hours: DataFrame, weight: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Fixes of usable hours with their weight, 1 where it isn't known."""
    cell = [*(scope or []), "service_date", "hour"]
    return fixes.join(hours, cell).join(weight, cell, "left").fillna(1.0, ["w"])
