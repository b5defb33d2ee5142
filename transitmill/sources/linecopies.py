"""Copies of feed tables laid out by line, so that a request for one line reads its own files only.

A store holds the tables of all feeds in feeds/<table>/sha=<sha>, and a marker in feeds/_done/<sha> with the time it was written. The
copies lie in lines/<table>/line=<line>/sha=<sha>, and a marker in lines/_done/<sha> says which writing of the feed they are
of. A feed whose marker is missing or older is read from the feed's own tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import readers, sinks
from .shared import delete

TABLES = ("patterns", "links", "stops", "pattern_days")


def stamps(spark: SparkSession, store: str, what: str) -> dict[str, str]:
    """The time written, by feed, of the markers in feeds or lines: a row a feed."""
    if not readers.exists(spark, f"{store}/{what}/_done"):
        return {}
    return {r["sha"]: r["written_at"] for r in readers.manifests(spark, f"{store}/{what}/_done/*").select("sha", "written_at").collect()}


def put_feed(spark: SparkSession, store: str, sha: str, tables: dict[str, DataFrame], written_at: str) -> None:
    """Writes a feed's tables anew; until update() its copies by line don't count."""
    forget(spark, store, sha)
    for name in TABLES:
        sinks.write(tables[name].hint("rebalance"), f"{store}/feeds/{name}/sha={sha}", sort=["line"])
    sinks.commit(spark, f"{store}/feeds/_done/{sha}", {"sha": sha, "written_at": written_at})


def forget(spark: SparkSession, store: str, sha: str) -> None:
    """From now on the feed is read from its own tables."""
    delete(spark, f"{store}/lines/_done/{sha}")


def update(spark: SparkSession, store: str) -> list[str]:
    """Copies the feeds whose copies are missing or old, all of them in one job a table, and says which. Lines that a feed no longer
    has lose their copies of it."""
    now, held = stamps(spark, store, "feeds"), stamps(spark, store, "lines")
    stale = sorted(s for s, at in now.items() if held.get(s) != at)
    for name in TABLES if stale else ():
        for sha in stale:
            for path in _matches(spark, f"{store}/lines/{name}/line=*/sha={sha}"):
                delete(spark, path)
        rows = spark.read.schema(_schema(spark, store, name, stale[0])).option("basePath", f"{store}/feeds/{name}").parquet(*[f"{store}/feeds/{name}/sha={s}" for s in stale])
        sinks.replace_partitions(rows, f"{store}/lines/{name}", ["line", "sha"])
    for sha in stale:
        sinks.commit(spark, f"{store}/lines/_done/{sha}", {"sha": sha, "written_at": now[sha]})
    return stale


def _schema(spark: SparkSession, store: str, name: str, sha: str) -> StructType:
    """A table's columns, line and sha as text, whatever the names of folders look like."""
    own = spark.read.parquet(f"{store}/feeds/{name}/sha={sha}").schema
    return StructType([*own, StructField("sha", StringType())])


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    held = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = held.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(held)
    return [str(f.getPath()) for f in found or []]


def read_line(spark: SparkSession, store: str, line: str, shas: list[str]) -> dict[str, DataFrame]:
    """The tables of a line in some feeds, with their sha: from its copies if all of these feeds have theirs, else from the feeds' own
    tables. A line without copies is in none of the feeds. There must be a feed."""
    now, held = stamps(spark, store, "feeds"), stamps(spark, store, "lines")
    copied = bool(shas) and all(s in now and held.get(s) == now[s] for s in shas)
    out = {}
    for name in TABLES:
        rows = spark.read.schema(_schema(spark, store, name, min(now))).parquet(f"{store}/{'lines' if copied else 'feeds'}/{name}")
        out[name] = rows.filter((F.col("line") == line) & F.col("sha").isin(shas))
    return out
