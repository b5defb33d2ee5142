"""Batch jobs over a store of monthly tables: python -m transitmill.jobs {cube,regularity,ranking,network,night} --store FOLDER ...

The store holds one folder a table, partitioned by month. Inputs: placed, passages, links, patterns, pattern_days, coverage and
stop_events; outputs: the names that plans/build.py gives. A run replaces the month it builds, or just the lines asked for.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .config import TIME_ZONE
from .plans import build
from .plans.requests import BadRequest, NetQuery, RankQuery, Selection, parse_dow, parse_hours, parse_periods
from .session import session
from .sources import readers, sinks

INPUTS = ("placed", "passages", "links", "patterns", "pattern_days", "coverage")


def month_of(spark: SparkSession, store: str, name: str, month: str, lines: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{store}/{name}").filter(F.col("month") == month).drop("month")
    return df.filter(F.col("line").isin(lines)) if lines else df


def put(spark: SparkSession, store: str, month: str, tables: dict[str, DataFrame], lines: list[str] | None = None) -> None:
    """Writes the tables of a month, empty ones too, then the marker. If `lines` are given, the other lines' rows stay."""
    for name, df in tables.items():
        path = f"{store}/{name}"
        if lines:
            # the month is put together beside the table, as its folder can't be read while it is replaced
            old = readers.read_optional(spark, path, StructType([*df.schema.fields, StructField("month", StringType())]))
            kept = old.filter((F.col("month") == month) & ~F.col("line").isin(lines)).drop("month")
            sinks.write(df.unionByName(kept, allowMissingColumns=True), f"{store}/_next/{name}/{month}")
            df = spark.read.parquet(f"{store}/_next/{name}/{month}")
        sinks.write(df.hint("rebalance"), f"{path}/month={month}", sort=[c for c in ("line", "service_date", "hour") if c in df.columns])
    sinks.commit(spark, f"{store}/_done/{'-'.join(sorted(tables))}/{month}", {"month": month, "tables": sorted(tables), "lines": lines})


def cube(spark: SparkSession, store: str, month: str, lines: list[str] | None = None, skip: list | None = None) -> None:
    def hold(name: str, df: DataFrame) -> DataFrame:
        path = f"{store}/_parts/{name}/{month}"
        sinks.write(df, path)
        return spark.read.parquet(path)

    put(spark, store, month, build.month_tables(*[month_of(spark, store, n, month, lines) for n in INPUTS], skip=skip, hold=hold), lines)


def regularity(spark: SparkSession, store: str, month: str) -> None:
    put(spark, store, month, build.regularity_tables(month_of(spark, store, "stop_events", month)))


def held_tables(spark: SparkSession, store: str, q: Selection, names: tuple[str, ...], optional: tuple[str, ...]) -> dict[str, DataFrame]:
    """The month tables that a request reads; of the optional ones those that the store has. A request for a mode needs modes."""
    months, held = readers.months_between(q.first, q.last), {}
    for name in (*names, *optional):
        if name in names or readers.exists(spark, f"{store}/{name}"):
            df = spark.read.parquet(f"{store}/{name}")
            held[name] = df.filter(F.col("month").isin(months)).drop("month") if "month" in df.columns else df
    if q.mode != "all" and "modes" not in held:
        raise BadRequest(f"the store has no table of modes, so a request for {q.mode} can't be answered")
    return held


def not_applied(held: dict[str, DataFrame], q: Selection) -> list[str]:
    """What a request asks for that can't be looked up, as tables are missing."""
    lacks = lambda *names: bool(set(names) - set(held))
    said = {"days without a feed": lacks("linehours", "plan"), "strikes": q.reduced == "exclude" and lacks("linehours", "plan"), "reduced service": q.reduced == "exclude" and lacks("daytrips"), "school holidays": q.school == "exclude" and lacks("daytrips")}
    return [what for what, missing in said.items() if missing]


def rank(spark: SparkSession, store: str, q: RankQuery) -> DataFrame:
    """The ranked lists of a request. not_applied() says what a store without daytrips, linehours or plan can't leave out."""
    return build.ranking_answer(held_tables(spark, store, q, ("cube", "days", "roles", "hourly"), ("linehours", "plan", "modes", "daytrips")), q)


def network(spark: SparkSession, store: str, q: NetQuery) -> dict[str, DataFrame]:
    """The network answer of a request: months, total, days and left_out."""
    return build.network_page(held_tables(spark, store, q, ("linehours", "plan", "modes"), ("reglines", "daytrips")), q)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="transitmill.jobs")
    p.add_argument("job", choices=("cube", "regularity", "ranking", "network", "night"))
    p.add_argument("--store", required=True)
    p.add_argument("--month", help="yyyy-MM")
    p.add_argument("--lines", type=lambda x: x.split(","))
    p.add_argument("--from", dest="first", type=dt.date.fromisoformat)
    p.add_argument("--to", dest="last", type=dt.date.fromisoformat)
    p.add_argument("--dow", type=parse_dow, default=(0, 1, 2, 3, 4))
    p.add_argument("--hours", type=parse_hours, default=(6, 21))
    p.add_argument("--top", type=int, default=50)
    p.add_argument("--mode", default="all", choices=("all", "tram", "bus", "metro"))
    p.add_argument("--exclude", type=parse_periods, default=(), help="D1..D2,D3")
    for name, default in (("holidays", "exclude"), ("school", "include"), ("reduced", "exclude")):
        p.add_argument(f"--{name}", default=default, choices=("exclude", "include"))
    p.add_argument("--stops", action="store_true")
    p.add_argument("--terminus", action="store_true")
    p.add_argument("--out", help="folder for the answer, as CSV")
    p.add_argument("--full", action="store_true", help="night: place the whole month")
    a = p.parse_args(argv)
    need = ("first", "last", "out") if a.job in ("ranking", "network") else ("month",)
    if missing := [n for n in need if getattr(a, n) is None]:
        p.error(f"{a.job} needs {', '.join(missing)}")
    spark = spark or session("transitmill-" + a.job)
    if a.job == "cube":
        cube(spark, a.store, a.month, a.lines)
    elif a.job == "regularity":
        regularity(spark, a.store, a.month)
    elif a.job == "night":
        from . import nightly

        print(json.dumps(nightly.derive(spark, a.store, a.month, dt.datetime.now(ZoneInfo(TIME_ZONE)).date() - dt.timedelta(1), a.full)))
    else:
        asked = dict(first=a.first, last=a.last, dow=a.dow, lines=tuple(a.lines or ()), hours=a.hours, mode=a.mode, exclude=a.exclude, holidays=a.holidays, school=a.school, reduced=a.reduced)
        if a.job == "ranking":
            q = RankQuery(**asked, stops=a.stops, terminus=a.terminus, top=a.top)
            sinks.download(rank(spark, a.store, q), a.out)
        else:
            q = NetQuery(**asked)
            for name, df in network(spark, a.store, q).items():
                sinks.download(df, f"{a.out}/{name}")
        have = {n: None for n in ("linehours", "plan", "daytrips") if readers.exists(spark, f"{a.store}/{n}")}
        for what in not_applied(have, q):
            print(f"not applied, as the store lacks its tables: {what}", file=sys.stderr)


if __name__ == "__main__":
    main()
