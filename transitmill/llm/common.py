"""What the corpus operators share: table access, lineage cuts and distributed prefix sums."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship
from ..sources.shared import delete, shared_folder

#: White space of the contracts, `[\\x20\\x09-\\x0D]`, as it stands in a pattern and as plain characters.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
#: Rows that any task can take, whatever their keys.
FEW_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    made, own = out._jdf.logicalPlan().rdd().getCheckpointFile(), _made.get()
    if own is not None and made.isDefined():
        own.append(made.get())
    return out


#: Folders of the checkpoints of the call that is under way in this thread, if it wants to know them.
_made: ContextVar[list[str] | None] = ContextVar("checkpoints", default=None)


@contextmanager
def checkpoints_of_call() -> Iterator[list[str]]:
    """The folders of the checkpoints that cut() makes in this block, and in this thread, as they are made."""
    own: list[str] = []
    before = _made.set(own)
    try:
        yield own
    finally:
        _made.reset(before)


def drop_checkpoints(spark: SparkSession, made: list[str]) -> None:
    """Deletes checkpoints. No frame made from them may be read again."""
    for path in made:
        delete(spark, path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of frames that nothing refers to: it acts when the driver collects garbage,
    which a driver that does little else may not do for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Before a Python operator: Arrow batches bounded by bytes, as one text may be very long, and this package on the executors.

    The bound is a setting of the session that is read when a plan runs; it changes how rows are handed over, never a result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    ship(spark)


def widened(docs: DataFrame, own: list[str], new: dict[str, str], text_col: str) -> tuple[DataFrame, int, StructType]:
    """What a Python operator that adds the columns `new` (name: type) reads: the columns `own` of docs, and the text, which comes
    last if it isn't one of them; the text's place; and the schema of what it returns, own columns first."""
    cols = [F.col(f"`{c}`") for c in own]
    at = own.index(text_col) if text_col in own else len(own)
    given = docs.select(*cols) if at < len(own) else docs.select(*cols, F.col(f"`{text_col}`").alias("_text_in"))
    kinds = StructType.fromDDL(", ".join(f"{n} {t}" for n, t in new.items()))
    return given, at, StructType([*[docs.schema[c] for c in own], *kinds])


def hot_join(big: DataFrame, small: DataFrame, key: str, weight: str, total: int, share: int = 1000) -> DataFrame:
    """big joined with small by key, `weight` dropped: small has one row a key and the number of big's rows that bear it, of
    `total` in all.

    The rows of a key that holds over 1/share of all don't meet in one task: there are fewer than `share` such keys, so they
    are broadcast. The others join by a shuffle, and so do all if the rows are few. Null keys join nothing.
    """
    if total < FEW_ROWS:
        return big.join(small.drop(weight), key)
    hot = small.filter(F.col(weight) * share > total)
    few = F.broadcast(hot.drop(weight))
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.filter(F.col(weight) * share <= total).drop(weight), key)
    return big.join(few, key).unionByName(rest)


def salted_join(big: DataFrame, small: DataFrame, weights: DataFrame, key: str, total: int, share: int = 1000) -> DataFrame:
    """big joined with small by key, where rows of small may be large: nothing of small is broadcast.

    weights (key, _n) has the number of big's rows that bear a key, of `total` in all. The rows of a key that holds over 1/share
    of all are dealt by a hash over as many parts as it holds such shares, and small's row of that key goes to each of them:
    fewer than 2 * share rows more than small has.
    """
    ways = weights.select(key, "_n", F.greatest(F.lit(1), F.ceil(F.col("_n") * share / max(total, 1))).cast("int").alias("_ways"))
    dealt = hot_join(big, ways, key, "_n", total, share).withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.col("_ways")).cast("int")).drop("_ways")
    each = small.join(ways.drop("_n"), key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1))).drop("_ways")
    return dealt.join(each, [key, "_salt"]).drop("_salt")


def words(text: Column) -> Column:
    """Array of the maximal runs of other characters than SPACE; empty for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def running(df: DataFrame, order: list[Column], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """df with `_pos` (rows before) and, for each output name in sums, the sum of its column over all rows before.

    The rows are range-partitioned by `order`, each partition is totalled, and a window inside each partition adds the
    total of those before it: no window holds more than one range. The partition number is fixed by a checkpoint, and
    the totals that are broadcast have one row per partition. df should be narrow, as it is what gets written.
    """
    n = parts or shuffle_parts(df.sparkSession)
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_b_pos"), *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in sums])
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.select("*", F.count(F.lit(1)).over(here).alias("_pos"), *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(name) for name, c in sums.items()])
    out = inside.join(F.broadcast(base), "_part")
    return out.select(*df.columns, (F.col("_pos") + F.col("_b_pos")).alias("_pos"), *[(F.col(name) + F.col(f"_b_{name}")).alias(name) for name in sums])
