"""Writers: layouts that later scans can prune, partial rewrites, commit markers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, by: list[str] | None = None, sort: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, partitioned by `by`, and sorted by `sort` inside files so that their statistics prune."""
    if by:
        # rebalance: a large partition value is split over several files, small ones aren't
        df = df.hint("rebalance", *by)
    if sort or by:
        df = df.sortWithinPartitions(*(by or []), *(sort or []))
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str], sort: list[str] | None = None) -> None:
    """Overwrites just the partitions that df has rows for."""
    own = df.hint("rebalance", *by).sortWithinPartitions(*by, *(sort or []))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def by_range(df: DataFrame, path: str, keys: list[str], n: int, max_rows: int = 0) -> None:
    """Files of key ranges, sorted: a reader of one key opens few row groups."""
    w = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd")
    (w.option("maxRecordsPerFile", max_rows) if max_rows else w).parquet(path)


def commit(spark: SparkSession, path: str, facts: dict) -> None:
    """A one-row JSON marker, written after the data."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def without_nested(df: DataFrame) -> DataFrame:
    """Without list, map and struct columns."""
    return df.select(*[f.name for f in df.schema if not f.dataType.simpleString().startswith(("array", "struct", "map"))])


def download(df: DataFrame, path: str, kind: str = "csv") -> None:
    if kind == "csv":
        without_nested(df).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def content_sha(files: DataFrame, keys: list[str] | None = None, name: str = "name", sha: str = "sha256") -> DataFrame:
    """One hash of a set of files: of the sorted lines name:sha256."""
    from ..operators.windows import digest

    return digest(files, keys or [], [name, sha], "sha")


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
