"""Mixing sources to target weights: hash-random order, prefix sums of words, and a cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, running

#: Sources up to which their plan is broadcast; with more it is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of maximal runs outside white space, without building an array of them."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def targets(totals: DataFrame, source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Adds `target` to rows (source, source_size): all words shared by weight, none above max_epochs times its source.

    Weights repeat over the sources in code-point order, null last. With level L, a source gets min(cap, L * weight);
    the level at which these sum to all words is the largest of (all - caps of the k sources that fill first) / (weights
    of the rest), over k. It comes from prefix sums, so the number of sources is not bounded by one task or the driver.
    """
    ranked = running(totals, [F.col(source_col).asc_nulls_last()], {})
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.select(source_col, "source_size", F.element_at(cycle, (F.col("_pos") % len(weights) + 1).cast("int")).alias("_weight"), (F.col("source_size") * max_epochs).cast("double").alias("_cap"))
    filled = running(ranked.withColumn("_ratio", F.col("_cap") / F.col("_weight")), [F.col("_ratio"), F.col(source_col).asc_nulls_last()], {"_caps": "_cap", "_weights": "_weight"})
    sums = filled.agg(F.sum("source_size").cast("double").alias("s"), F.sum("_weight").alias("w")).first()
    if sums["s"] is None:
        return ranked.select(source_col, "source_size", F.lit(0.0).alias("target"))
    level = filled.agg(F.max((F.lit(sums["s"]) - F.col("_caps")) / (F.lit(sums["w"]) - F.col("_weights")))).first()[0]
    return filled.select(source_col, "source_size", F.least(F.col("_cap"), F.col("_weight") * F.lit(float(level))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix-1", tie: Column | None = None) -> DataFrame:
    """One row per document: size (words), source_size, target and taken (words that the mix takes, repeats counted).

    Inside a source the documents stand in the order of a hash of seed and id. A budget of e whole epochs and a rest
    takes every document e times, and once more from the front until the rest is used up; the document at the cut gives
    just the words that are left. Rows that share an id are ordered by size, then by `tie`, which comes back as `_tie` if it is
    given; null ids, null sources (one source, last)
    and null texts (no words) are taken as such; other columns are ignored; an empty table gives no rows. The order is a
    function of the rows alone, so reruns agree.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    # cut, so that sampling the ranges doesn't read the texts a second time
    more = [] if tie is None else ["_tie"]
    narrow = cut(docs.select(F.col(id_col), F.col(source_col), word_count(F.col(text_col)).alias("size"), key.alias("_key"), *([] if tie is None else [tie.alias("_tie")])))
    placed = running(narrow, [F.col(source_col).asc_nulls_last(), F.col("_key"), F.col("size"), *[F.col(c) for c in more]], {"_before": "size"})
    per_source = placed.groupBy(source_col).agg(F.sum("size").alias("source_size"), F.min("_before").alias("_start"))
    budget = targets(per_source.select(source_col, "source_size"), source_col, weights, max_epochs).withColumnRenamed(source_col, "_source")
    start = per_source.select(F.col(source_col).alias("_source"), "_start")
    plan = budget.join(start, budget["_source"].eqNullSafe(start["_source"])).select(budget["_source"], "source_size", "target", "_start")
    if per_source.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    out = placed.join(plan, placed[source_col].eqNullSafe(plan["_source"]))
    words = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div greatest(source_size, 1)")).otherwise(F.lit(0))
    rest = words - epochs * F.col("source_size") - (F.col("_before") - F.col("_start"))
    taken = epochs * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return out.select(id_col, source_col, "size", "source_size", "target", taken.cast("long").alias("taken"), *more)


def copies(taken: Column, size: Column) -> Column:
    """Whole copies of a document that stand for its taken words: the one at the cut counts if half of it is inside."""
    return F.when(size > 0, F.floor((2 * taken + size) / (2 * size))).otherwise(F.lit(0)).cast("int")
