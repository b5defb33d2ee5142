"""Ordered operators: sessions, islands, first of each key, merged intervals, as-of lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col


def numbered(df: DataFrame, keys: list[str], order: list, starts: Column, out: str) -> DataFrame:
    """df with a running number within keys that grows where `starts` holds (over the same window)."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(starts.cast("long")).over(upto))


def sessions(df: DataFrame, keys: list[str], ts: str, position: str, order: list, gap: float, move: float, long: float, out: str = "long") -> DataFrame:
    """df with `session` and whether the session lasts `long` or more.

    A session goes on while time grows by at most `gap` and the position moves by at most `move`. Rows with a null key
    are sessions of their own.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    alone = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1
    begins = F.coalesce(((F.col(ts) - F.lag(ts).over(w)) > gap) | (F.abs(F.col(position) - F.lag(position).over(w)) > move), F.lit(True)) | alone
    marked = df.withColumn("_begins", begins)
    in_session = numbered(marked, keys, order, F.col("_begins"), "session").drop("_begins")
    whole = Window.partitionBy(*keys, "session")
    return in_session.withColumn(out, F.max(ts).over(whole) - F.min(ts).over(whole) >= long)


def islands(df: DataFrame, keys: list[str], day: str, step: int = 1) -> DataFrame:
    """(keys, first, last, n_days): runs of days that follow each other by at most `step`."""
    d = df.select(*keys, F.col(day).alias("_d")).distinct()
    w = Window.partitionBy(*keys).orderBy("_d")
    marked = d.withColumn("_new", F.coalesce(F.datediff("_d", F.lag("_d").over(w)) > step, F.lit(True)))
    run = numbered(marked, keys, ["_d"], F.col("_new"), "_run")
    return run.groupBy(*keys, "_run").agg(F.min("_d").alias("first"), F.max("_d").alias("last"), F.count(F.lit(1)).alias("n_days")).drop("_run")


def runs(df: DataFrame, keys: list[str], order: list, value: str, first: str) -> DataFrame:
    """(keys, value, first, last, n_days): rows in order, with equal neighbours of `value` merged."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_new", ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1))
    run = numbered(marked, keys, order, F.col("_new"), "_run")
    return run.groupBy(*keys, "_run", value).agg(F.min(first).alias("first"), F.max(first).alias("last"), F.count(F.lit(1)).alias("n_days")).drop("_run")


def merged_periods(df: DataFrame, keys: list[str], start: str, end: str, lower=None, upper=None) -> DataFrame:
    """(keys, start, end): date intervals clipped to [lower, upper], overlapping or adjacent ones merged."""
    a = F.greatest(F.col(start), lower) if lower is not None else F.col(start)
    b = F.least(F.col(end), upper) if upper is not None else F.col(end)
    own = df.select(*keys, a.alias("_a"), b.alias("_b")).filter("_a <= _b").distinct()
    before = Window.partitionBy(*keys).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    marked = own.withColumn("_new", F.coalesce(F.col("_a") > F.date_add(F.max("_b").over(before), 1), F.lit(True)))
    run = numbered(marked, keys, ["_a", "_b"], F.col("_new"), "_run")
    return run.groupBy(*keys, "_run").agg(F.min("_a").alias(start), F.max("_b").alias(end)).drop("_run")


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first in `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, value: str, out: str) -> DataFrame:
    """left with the value of the latest right row of the key whose `since` is at or before `at` (null: none).

    Both sides are stacked and the last right value is carried forward, so each key is sorted once and nothing is paired.
    """
    cols = left.columns
    stacked = left.select(*cols, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(*keys, F.col(since).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return stacked.withColumn(out, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select(*cols, out)


def first_candidate(wanted: DataFrame, candidates: DataFrame, data: DataFrame, keys: list[str], source: str, rank: str) -> DataFrame:
    """For each wanted key, the source of best rank among its candidates that has data for it."""
    held = candidates.join(wanted, keys, "left_semi").join(data.select(*keys, source).distinct(), [*keys, source], "left_semi")
    return held.groupBy(*keys).agg(F.min_by(source, rank).alias(source))


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows, with `rank` from 1. Only those n meet in one task."""
    w = Window.orderBy(*order)
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(w).cast("long"))


def digest(df: DataFrame, keys: list[str], parts: list[str | Column], out: str = "sha256") -> DataFrame:
    """SHA-256 of each group's lines (its parts joined by a colon), sorted and joined by line feeds."""
    line = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias(out))
