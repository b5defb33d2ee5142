"""Polls, source choice and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MIN_FEED_SHARE
from ..functions.exprs import col


def rows_from_bulk(df: DataFrame) -> DataFrame:
    """Bulk files to the normal columns ts, line, dir, point, dist."""
    return df.select(F.unix_timestamp("date").alias("ts"), F.col("lineId").cast("string").alias("line"), F.col("directionId").cast("string").alias("dir"), F.col("pointId").cast("string").alias("point"), F.col("distanceFromPoint").cast("int").alias("dist"))


def rows_from_json(df: DataFrame, payload: str = "payload", ts: str = "ts") -> DataFrame:
    """Poll payloads, a JSON array of vehicles or an object with one in `data` or `results`, to the normal columns."""
    kind = "array<struct<lineId:string,directionId:string,pointId:string,distanceFromPoint:int>>"
    body = F.coalesce(F.get_json_object(payload, "$.data"), F.get_json_object(payload, "$.results"), F.col(payload))
    return df.select(F.col(ts).alias("ts"), F.explode(F.from_json(body, kind)).alias("v")).select("ts", F.col("v.lineId").alias("line"), F.col("v.directionId").alias("dir"), F.col("v.pointId").alias("point"), F.col("v.distanceFromPoint").alias("dist"))


def content(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys, n_rows, _c1, _c2): each group's rows as a bag, in values that don't depend on their order and merge."""
    h = F.xxhash64(*cols)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("_c1"), F.sum(h.cast("decimal(38,0)")).alias("_c2"))


def polls(rows: DataFrame, times: DataFrame, cols: list[str], ts: str = "ts", day: str = "day") -> DataFrame:
    """(day, ts, n_rows, frozen) for every poll time, empty ones included: frozen if its rows are those of the poll before,
    in any order. The first poll of a day isn't frozen; an empty one after an empty one is."""
    held = times.select(day, ts).distinct().join(content(rows, [ts], cols), ts, "left").fillna(0, ["n_rows"])
    w = Window.partitionBy(day).orderBy(ts)
    same = (F.col("n_rows") == F.lag("n_rows").over(w)) & F.col("_c1").eqNullSafe(F.lag("_c1").over(w)) & F.col("_c2").eqNullSafe(F.lag("_c2").over(w))
    return held.select(day, ts, F.col("n_rows").cast("long").alias("n_rows"), F.coalesce(same, F.lit(False)).alias("frozen"))


def live_rows(rows: DataFrame, snaps: DataFrame, ts: str = "ts") -> DataFrame:
    """The rows of polls that are neither frozen nor empty."""
    return rows.join(snaps.filter("not frozen and n_rows > 0").select(ts), ts, "left_semi")


def short_samples(expected: DataFrame, got: DataFrame, n: int = 6, key: str = "ts", count: str = "n") -> DataFrame:
    """(sampled, short, incomplete): of about n evenly spaced keys, those where `got` has clearly fewer rows than expected.

    A sample is short if expected > 1.05 got + 3; the source is incomplete if two samples are, or all of one.
    """
    size = expected.count()
    step = max(1, size // (n + 1))
    w = Window.orderBy(key)
    picked = expected.withColumn("_i", F.row_number().over(w) - 1).filter((F.col("_i") % step == step - 1) | (F.lit(step) == 1)).orderBy(key).limit(n)
    both = picked.join(got.withColumnRenamed(count, "_got"), key, "left")
    short = F.count(F.when(F.col(count) > 1.05 * F.coalesce("_got", F.lit(0)) + 3, F.lit(1)))
    return both.agg(F.count(F.lit(1)).alias("sampled"), short.alias("short")).withColumn("incomplete", (F.col("sampled") > 0) & (F.col("short") >= F.least(F.lit(2), F.col("sampled"))))


def chosen_parts(parts: DataFrame, start: str = "start", end: str = "end", keys: list[str] | None = None) -> DataFrame:
    """Intervals that lie in no longer one: those that start first, and longer first at equal starts, are kept if they reach
    further than all before them."""
    w = Window.partitionBy(*(keys or [])).orderBy(F.col(start), F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_reach", F.max(end).over(w)).filter(F.col("_reach").isNull() | (F.col(end) > F.col("_reach"))).drop("_reach")


def uncovered(points: DataFrame, parts: DataFrame, keys: list[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Points in no half-open interval [start, end) of their key: each point is set against the furthest end among intervals that
    start at it or before."""
    stacked = points.withColumn("_side", F.lit(1)).withColumn("_at", F.col(at)).unionByName(parts.select(*keys, F.col(start).alias("_at"), F.col(end).alias("_end"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return stacked.withColumn("_reach", F.max("_end").over(w)).filter((F.col("_side") == 1) & (F.col("_reach").isNull() | (F.col("_reach") <= F.col(at)))).select(*points.columns)


def partial_sources(days: DataFrame, date: str = "date", lines: str = "lines", back: int = 10, span: int = 28, least: int = 3) -> DataFrame:
    """(date, lines, ref, partial): a day whose lines are under MIN_FEED_SHARE of the upper median of its last `back` days of
    the same kind (weekdays together, Saturday, Sunday) within `span` days; with fewer than `least` of them it isn't judged."""
    d = days.select(F.col(date), F.col(lines), F.greatest(F.weekday(date), F.lit(4)).alias("_kind"), F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).alias("_n"))
    w = Window.partitionBy("_kind").orderBy("_n").rangeBetween(-span, -1)
    held = d.withColumn("_past", F.sort_array(F.collect_list(F.struct("_n", lines)).over(w), False))
    vals = F.sort_array(F.transform(F.slice("_past", 1, back), lambda x: x[lines]))
    ref = F.when(F.size("_past") >= least, F.element_at(vals, F.floor(F.size(vals) / 2).cast("int") + 1))
    return held.select(date, lines, ref.alias("ref"), F.coalesce(F.col(lines) < MIN_FEED_SHARE * ref, F.lit(False)).alias("partial"))


def shard(df: DataFrame, order: str, i: int, n: int, keys: list[str] | None = None) -> DataFrame:
    """Every n-th row in order, from the i-th on."""
    w = Window.partitionBy(*(keys or [])).orderBy(order)
    return df.withColumn("_i", F.row_number().over(w) - 1).filter(F.col("_i") % n == i).drop("_i")


def packed_groups(sizes: DataFrame, key: str, rows: str, target: int) -> DataFrame:
    """(key, rows, pack): keys in order, put together until `target` rows are reached; a key is never split.

    One row a key is folded, so the fold's input is the list of keys and not the data.
    """
    one = sizes.agg(F.array_sort(F.collect_list(F.struct(key, rows))).alias("_all"))
    zero = F.struct(F.lit(0).cast("long").alias("pack"), F.lit(0).cast("long").alias("held"), F.array().cast("array<bigint>").alias("packs"))

    def step(a: Column, x: Column) -> Column:
        full = (a["held"] > 0) & (a["held"] + x[rows] > target)
        pack = a["pack"] + full.cast("long")
        return F.struct(pack.alias("pack"), F.when(full, x[rows]).otherwise(a["held"] + x[rows]).cast("long").alias("held"), F.array_append(a["packs"], pack).alias("packs"))

    done = one.select("_all", F.aggregate("_all", zero, step)["packs"].alias("_packs"))
    return done.select(F.explode(F.arrays_zip("_all", "_packs")).alias("_x")).select(F.col(f"_x._all.{key}").alias(key), F.col(f"_x._all.{rows}").alias(rows), F.col("_x._packs").alias("pack"))


def snapshots(parts: list[DataFrame], ts: str = "ts") -> DataFrame:
    """Poll lists of several days as one: frozen false where missing, one row a time, the earlier list first."""
    out = None
    for i, p in enumerate(parts):
        own = p.withColumn("_p", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    from .windows import first_of

    return first_of(out.fillna(False, ["frozen"]), [ts], ["_p"]).drop("_p").withColumn("time", F.timestamp_seconds(col(ts)))
