"""Networks over many feeds: lasting keys of links, pattern days, and the network of a range of dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEGREE_M
from .windows import first_candidate

#: Metres up to which two tracks between the same stops are one link, and points at which tracks are compared.
SAME_M, POINTS = 40.0, 16


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _away(a: Column, b: Column) -> Column:
    """Metres between two points (lon, lat), on a plane that touches at the first."""
    return F.sqrt(F.pow((a["x"] - b["x"]) * F.cos(F.radians(a["y"])) * DEGREE_M[0], 2) + F.pow((a["y"] - b["y"]) * DEGREE_M[1], 2))


def sampled(geometry: Column, n: int = POINTS) -> Column:
    """n + 1 points at equal shares of the way along a polyline of [lon, lat], to a tenth of a millimetre; empty for null, and for fewer than two points."""
    points = F.transform(geometry, lambda p: _point(F.get(p, 0), F.get(p, 1)))
    pieces = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"), _away(a, b).alias("m")))
    whole = lambda own: F.aggregate(own, F.lit(0.0), lambda s, p: s + p["m"])
    start = lambda own: F.struct(F.lit(0.0).alias("s"), own[0]["a"].alias("p"), F.lit(False).alias("done"))

    def at(own: Column, way: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            part = F.when(p["m"] > 0, F.least(F.lit(1.0), (way - acc["s"]) / p["m"])).otherwise(1.0)
            here = _point(p["a"]["x"] + part * (p["b"]["x"] - p["a"]["x"]), p["a"]["y"] + part * (p["b"]["y"] - p["a"]["y"]))
            return F.when(acc["done"], acc).otherwise(F.struct((acc["s"] + p["m"]).alias("s"), here.alias("p"), (acc["s"] + p["m"] >= way).alias("done")))

        return F.aggregate(own, start(own), step, lambda acc: _point(F.round(acc["p"]["x"], 9), F.round(acc["p"]["y"], 9)))

    shares = F.sequence(F.lit(0), F.lit(n))
    # the pieces are made once, not for each point
    along = F.flatten(F.transform(F.array(pieces), lambda own: F.transform(shares, lambda k: at(own, whole(own) * k / n))))
    return F.when(F.size(geometry) < 2, F.array().cast("array<struct<x:double,y:double>>")).when(geometry.isNull(), F.array().cast("array<struct<x:double,y:double>>")).otherwise(along)


def apart(a: Column, b: Column) -> Column:
    """The largest distance between sampled tracks at the same share of the way; 0 if either has no points."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.array_max(F.zip_with(a, b, _away)))


def lasting_variants(registry: DataFrame | None, links: DataFrame, geometry: str = "geometry", weight: str | None = None, same: float = SAME_M) -> DataFrame:
    """The registry (from_stop, to_stop, variant, track) with the tracks of links (from_stop, to_stop, geometry) that it lacks.

    Between two stops a track is a new variant if no variant lies within `same` metres of it. What the registry holds keeps its
    number; new tracks come by weight (the number of rows, or the sum of that column), the greatest first, ties by their points. A link without
    a geometry fits any variant. So a later feed gives the keys that an earlier one gave, in whatever order its rows come.
    """
    own = links.select("from_stop", "to_stop", sampled(F.col(geometry)).alias("track"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("_w"))
    # one row a different track before any are put together
    tracks = own.groupBy("from_stop", "to_stop", "track").agg(F.sum("_w").alias("_w"))
    fresh = tracks.groupBy("from_stop", "to_stop").agg(F.array_sort(F.collect_list(F.struct((F.size("track") == 0).alias("bare"), (-F.col("_w")).alias("w"), "track"))).alias("_new"))
    if registry is None:
        both = fresh.withColumn("_old", F.array().cast("array<array<struct<x:double,y:double>>>"))
    else:
        held = registry.groupBy("from_stop", "to_stop").agg(F.transform(F.array_sort(F.collect_list(F.struct("variant", "track"))), lambda v: v["track"]).alias("_old"))
        both = held.join(fresh, ["from_stop", "to_stop"], "full")
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    new = F.coalesce(F.transform("_new", lambda t: t["track"]), none)
    known = F.aggregate(new, F.coalesce("_old", none), lambda acc, t: F.when(F.exists(acc, lambda k: apart(k, t) <= same), acc).otherwise(F.concat(acc, F.array(t))))
    return both.select("from_stop", "to_stop", F.posexplode(known).alias("variant", "track"))


def with_keys(links: DataFrame, registry: DataFrame, geometry: str = "geometry") -> DataFrame:
    """links with link_key, from>to~variant: the nearest variant of the registry, to the centimetre, the least of equal ones. Few variants lie between two stops."""
    held = registry.groupBy("from_stop", "to_stop").agg(F.collect_list(F.struct("variant", "track")).alias("_held"))
    near = F.array_min(F.transform("_held", lambda v: F.struct(F.round(apart(v["track"], F.col("_track")), 2).alias("m"), v["variant"].alias("variant"))))
    x = links.withColumn("_track", sampled(F.col(geometry))).join(held, ["from_stop", "to_stop"], "left")
    return x.withColumn("link_key", F.concat("from_stop", F.lit(">"), "to_stop", F.lit("~"), F.coalesce(near["variant"], F.lit(0)).cast("string"))).drop("_track", "_held")


def pattern_days(trips: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pattern_uid, service_date, n_trips, is_main) from trips (keys, pattern_uid, service_id, n_stops) and days (service_id,
    service_date): a pattern is the main one of its keys on a day if it has most trips, then most stops, then the least name."""
    daily = trips.groupBy(*keys, "pattern_uid", "service_id").agg(F.count(F.lit(1)).alias("_n"), F.max("n_stops").alias("n_stops"))
    run = daily.join(days.select("service_id", "service_date").distinct(), "service_id").groupBy(*keys, "pattern_uid", "service_date").agg(F.sum("_n").alias("n_trips"), F.max("n_stops").alias("n_stops"))
    best = Window.partitionBy(*keys, "service_date").orderBy(F.col("n_trips").desc(), F.col("n_stops").desc(), "pattern_uid")
    return run.withColumn("is_main", F.row_number().over(best) == 1).drop("n_stops")


def picked_feeds(candidates: DataFrame, days: DataFrame, dates: DataFrame) -> DataFrame:
    """(line, service_date, sha): for each line and date the first candidate feed (service_date, sha, rank) that runs the line that day."""
    wanted = days.select("line", "service_date").join(dates.select("service_date").distinct(), "service_date", "left_semi").distinct()
    by_line = candidates.join(wanted, "service_date")
    return first_candidate(wanted, by_line, days, ["line", "service_date"], "sha", "rank")


def network(feeds: dict[str, DataFrame], candidates: DataFrame, dates: DataFrame) -> dict[str, DataFrame]:
    """The network of a range of dates, put together from the tables of many feeds: patterns, links, stops, pattern_days and missing
    (line, service_date: no feed runs the line).

    feeds has these tables with a sha and a line. Each line takes each date from one feed; where feeds differ about a pattern, a
    link or a stop, the feed that is first in use counts, then the least sha.
    """
    picked = picked_feeds(candidates, feeds["pattern_days"], dates)
    days = feeds["pattern_days"].join(picked, ["line", "service_date", "sha"], "left_semi")
    used = picked.groupBy("line", "sha").agg(F.min("service_date").alias("_since"))
    out = {"pattern_days": days.drop("sha")}
    for name, key in (("patterns", ["pattern_uid"]), ("links", ["pattern_uid", "link_idx"]), ("stops", ["stop_id"])):
        rows = feeds[name].join(used, ["line", "sha"])
        rest = [c for c in feeds[name].columns if c not in ("line", "sha", *key)]
        first = rows.groupBy("line", *key).agg(F.min_by(F.struct(*rest), F.struct("_since", "sha")).alias("_r")) if rest else rows.select("line", *key).distinct()
        out[name] = first.select("line", *key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    lines = feeds["pattern_days"].select("line").distinct()
    out["missing"] = lines.join(F.broadcast(dates.select("service_date").distinct()), how="cross").join(picked, ["line", "service_date"], "left_anti")
    return out
