"""Sharding: contiguous shards of near-equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, running


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The narrow table that all later steps read: id, UTF-8 bytes plus one, checksum, and a tie-break for equal ids."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(F.col(text_col)).alias("_tie"))


def balanced_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: size, checksum, shard and slot, in contiguous runs of ascending id.

    A document goes to the shard in whose equal share of all bytes its middle byte lies, so a shard misses the mean by
    less than its two border documents. Null ids come first; rows of equal id are ordered by text, and rows that
    agree in both are interchangeable. Null texts count as empty (size 1). Other columns of docs are ignored. An empty
    table gives no rows.
    """
    placed = running(cut(sizes(docs, id_col, text_col)), [F.col(id_col).asc_nulls_first(), F.col("_tie"), F.col("size")], {"_before": "size"})
    total = placed.agg(F.max(F.col("_before") + F.col("size"))).first()[0] or 1
    placed = placed.withColumn("shard", F.expr(f"cast((2 * _before + size) * {shards} div {2 * total} as int)"))
    first = placed.groupBy("shard").agg(F.min("_pos").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("_pos") - F.col("_first")).cast("long").alias("slot"))
