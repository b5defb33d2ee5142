"""Registration of queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, event_type, value, with service_date, hour and t (epoch seconds)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.withColumns({"service_date": F.to_date("ts"), "hour": F.hour("ts"), "t": F.unix_timestamp("ts")})


#: The same in SQL, as the first part of a WITH clause.
E = "WITH e AS (SELECT event_id, ts, user_id, event_type, value, ts::DATE AS service_date, hour(ts)::INT AS hour, floor(epoch(ts))::BIGINT AS t FROM events)"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, as sums depend on the order of their terms."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema])
