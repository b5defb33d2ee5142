"""Session settings that the operators count on, and typed empty frames."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def session(app: str = "transitmill", **conf: str) -> SparkSession:
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, for operators that run Python there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    held = Path(tempfile.mkdtemp(prefix="transitmill-")) / f"{top.name}.zip"
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(held))
    _shipped.add(app)
