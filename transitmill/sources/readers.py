"""Readers: pruned scans, optional tables, manifests, source choice by content."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import empty


def read(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """One scan over all paths, of the named columns only."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def read_optional(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table, or an empty one of that schema where there is none, or none but empty folders."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return empty(spark, schema)
        raise


def exists(spark: SparkSession, path: str) -> bool:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held)


def union(parts: list[DataFrame]) -> DataFrame:
    """By name; what a part lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def months_between(first, last) -> list[str]:
    """Months, as yyyy-MM, that the dates from first to last touch."""
    out, y, m = [], first.year, first.month
    while (y, m) <= (last.year, last.month):
        out.append(f"{y:04d}-{m:02d}")
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
    return out


def window(df: DataFrame, first, last, lines: list[str] | None = None, month: str = "month", date: str = "service_date") -> DataFrame:
    """Rows of the dates from first to last: months prune partitions, dates and lines are pushed to the scan."""
    out = df.filter(F.col(month).isin(months_between(first, last))) if month in df.columns else df
    out = out.filter(F.col(date).between(first, last))
    return out.filter(F.col("line").isin(lines)) if lines else out


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Commit markers, one JSON document a file."""
    return spark.read.option("multiLine", True).json(path)


def file_ranges(names: DataFrame, name: str = "name") -> DataFrame:
    """Adds start and end (timestamps) from yyyyMMddTHHmm_yyyyMMddTHHmm in a file's name."""
    two = r"(\d{8}T\d{4})_(\d{8}T\d{4})"
    at = lambda g: F.to_timestamp(F.regexp_extract(name, two, g), "yyyyMMdd'T'HHmm")
    return names.filter(F.col(name).rlike(two)).withColumn("start", at(1)).withColumn("end", at(2))


def footers(spark: SparkSession, path: str, column: str, by: str) -> DataFrame:
    """(by, low, high, n): the least and greatest value of a column and the rows, for each value of the partition column `by`, all in
    one job that reads the files' footers and no rows, if the column is of a type whose footers can be trusted (numbers, dates).

    The aggregate goes into the scan of the newer Parquet source only, so this frame belongs to a session of its own.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).groupBy(by).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(F.lit(1)).alias("n"))


def nearest_source(wanted: DataFrame, sources: DataFrame, by: str, date: str = "date") -> DataFrame:
    """wanted dates with the source whose days (low to high) hold the date or lie nearest to it, `away` days off; ties go to the one
    of most rows, then of least name. Sources without days are none. sources has a row a source, all of which go into one list."""
    held = sources.filter(F.col("low").isNotNull()).agg(F.collect_list(F.struct("low", "high", (-F.col("n")).alias("_n"), F.col(by).alias("source"))).alias("_all"))
    off = lambda s: F.greatest(F.lit(0), F.datediff(s["low"], F.col(date)), F.datediff(F.col(date), s["high"]))
    best = F.array_min(F.transform("_all", lambda s: F.struct(off(s).alias("away"), s["_n"].alias("n"), s["source"].alias("source"))))
    return wanted.crossJoin(F.broadcast(held)).withColumn("_b", best).select(*wanted.columns, F.col("_b.source").alias(by), F.col("_b.away").alias("away"))


def by_content(spark: SparkSession, path: str, column: str, wanted: object, by: str) -> str | None:
    """The least of the partitions `by` whose column holds `wanted` and nothing else, by the footers of all files."""
    found = footers(spark, path, column, by).filter((F.col("low") == F.lit(wanted)) & (F.col("high") == F.lit(wanted))).agg(F.min(F.col(by).cast("string"))).first()
    return found[0]


def line_tables(patterns: DataFrame, links: DataFrame, line: str, geometry: bool = False) -> tuple[DataFrame, DataFrame]:
    """A line's patterns and their links, without geometry unless asked for."""
    p = patterns.filter(F.col("line") == line)
    own = links.join(p.select("pattern_uid"), "pattern_uid", "left_semi")
    return (p, own) if geometry else (p.drop("geometry"), own.drop("geometry"))
