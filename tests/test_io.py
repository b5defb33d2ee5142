"""Sources, sinks, requests and streams."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from transitmill.plans import requests as rq
from transitmill.sources import readers, sinks
from transitmill.streaming import twins

D = dt.date(2025, 3, 3)


def frame(spark):
    return spark.createDataFrame([(D + dt.timedelta(i % 40), "5" if i % 3 else "7", i, [i]) for i in range(400)], "service_date date, line string, v int, a array<int>").withColumn("month", F.date_format("service_date", "yyyy-MM"))


def test_write_prune_replace(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.write(frame(spark), p, ["month"], ["line"])
    df = readers.window(readers.read(spark, p), D, dt.date(2025, 3, 10), ["5"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*month", plan) and re.search(r"PushedFilters: \[[^]]*line", plan)
    assert df.count() == frame(spark).filter("service_date <= '2025-03-10' and line = '5'").count()
    sinks.replace_partitions(frame(spark).filter("month = '2025-04' and v < 100"), p, ["month"])
    got = {r["month"]: r["count"] for r in readers.read(spark, p).groupBy("month").count().collect()}
    want = {r["month"]: r["count"] for r in frame(spark).filter("month = '2025-03' or v < 100").groupBy("month").count().collect()}
    assert got == want


def test_optional_manifest_download(spark, tmp_path):
    assert readers.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0
    sinks.commit(spark, str(tmp_path / "_m"), {"date": D, "rows": 3})
    assert readers.manifests(spark, str(tmp_path / "_m")).first().rows == 3
    sinks.download(frame(spark), str(tmp_path / "csv"))
    assert "a" not in spark.read.option("header", True).csv(str(tmp_path / "csv")).columns
    sinks.by_range(frame(spark), str(tmp_path / "r"), ["line"], 2)
    a, b = sinks.content_sha(spark.createDataFrame([("x", "1"), ("y", "2")], "name string, sha256 string")).first(), sinks.content_sha(spark.createDataFrame([("y", "2"), ("x", "1")], "name string, sha256 string")).first()
    assert a == b
    names = spark.createDataFrame([("vd_20250303T0400_20250303T0900.parquet",), ("other",)], "name string")
    assert [r.start for r in readers.file_ranges(names).collect()] == [dt.datetime(2025, 3, 3, 4)]


def test_requests():
    q = rq.RankQuery(D, D + dt.timedelta(30), exclude=((dt.date(2025, 3, 5), dt.date(2025, 3, 6)), (dt.date(2025, 3, 7), dt.date(2025, 3, 8))))
    same = rq.RankQuery(D, D + dt.timedelta(30), exclude=((dt.date(2025, 3, 5), dt.date(2025, 3, 8)), (dt.date(2026, 1, 1), dt.date(2026, 1, 2))), top=50)
    assert q.key("s") == same.key("s") != q.key("t")
    assert rq.RankQuery(D, D, top=999).shown == 200 and rq.RankQuery(D, D, top=1).shown == 5
    assert rq.parse_dow("0-4") == (0, 1, 2, 3, 4) and rq.parse_dow("2,0") == (0, 2) and rq.parse_hours("6-21") == (6, 21)
    assert rq.parse_periods("2025-03-01..2025-03-02,2025-03-05")[1] == (dt.date(2025, 3, 5),) * 2
    assert rq.last_month(dt.date(2025, 3, 9)) == (dt.date(2025, 2, 1), dt.date(2025, 2, 28))
    assert rq.last_year(dt.date(2025, 3, 9)) == (dt.date(2024, 3, 1), dt.date(2025, 2, 28))
    for bad in (rq.RankQuery(D, D - dt.timedelta(1)), rq.RankQuery(D, D + dt.timedelta(500)), rq.RankQuery(D, D, dow=()), rq.RankQuery(D, D, hours=(9, 9)), rq.LineQuery(D, D, seg=2), rq.Days(D, D, school="maybe")):
        with pytest.raises(rq.BadRequest):
            bad.check()
    rq.NetQuery(D, D + dt.timedelta(900)).check()
    with pytest.raises(rq.BadRequest):
        rq.parse_dow("8")


def test_stream_of_polls_equals_batch(spark, tmp_path):
    rows = [("f", dt.date(2025, 3, 1 + i // 7), 20 * i, 3, c) for i, c in enumerate("aabbbcaa")]
    schema = "feed string, day date, ts bigint, n_rows bigint, content string"
    for k in range(2):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    twins.drain(twins.frozen_polls(s), str(tmp_path / "out"), "append")
    got = {r.ts: r.frozen for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {20 * i: i not in (0, 7) and c == "aabbbcaa"[i - 1] for i, c in enumerate("aabbbcaa")}


def test_stream_of_polls_of_one_time_goes_by_the_tie(spark, tmp_path):
    rows = [("f", dt.date(2025, 3, 1), t, 1, c, i) for i, (t, c) in enumerate([(0, "a"), (20, "a"), (20, "b"), (20, "b"), (40, "b")])]
    schema = "feed string, day date, ts bigint, n_rows bigint, content string, id int"
    for k, given in enumerate((rows, rows[::-1], rows[2:] + rows[:2])):
        spark.createDataFrame(given, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        twins.drain(twins.frozen_polls(spark.readStream.schema(schema).parquet(str(tmp_path / f"in{k}")), tie=["id"]), str(tmp_path / f"out{k}"), "append")
        got = sorted((r.ts, r.frozen) for r in spark.read.parquet(str(tmp_path / f"out{k}")).collect())
        assert got == [(0, False), (20, False), (20, True), (20, True), (40, True)]


def test_stream_windows_equal_batch(spark, tmp_path):
    at = dt.datetime(2025, 3, 3)
    ev = spark.createDataFrame([(at + dt.timedelta(hours=h), "k") for h in (1, 5, 23, 27, 29, 60, 200)], "ts timestamp, line string")
    ev.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    twins.drain(twins.service_day_counts(s, "ts", ["line"]), str(tmp_path / "days"), "complete")
    got = {r.service_date: r.n for r in spark.read.parquet(str(tmp_path / "days")).collect()}
    want = {r.d: r.n for r in ev.groupBy(F.to_date(F.col("ts") - F.expr("interval 4 hours")).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want
    twins.drain(twins.inactive_sessions(s, "ts", ["line"], "6 hours"), str(tmp_path / "sessions"), "complete")
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "sessions")).collect()) == [1, 1, 2, 3]


def test_upserts_are_idempotent(spark, tmp_path):
    p = str(tmp_path / "t")
    df = frame(spark).select("service_date", "line", "v")
    write = twins.upsert_days(p)
    write(df, 0)
    write(df.filter(F.col("service_date") == D), 1)
    write(df.filter(F.col("service_date") == D), 1)
    assert readers.read(spark, p).count() == 400


def test_sources_are_chosen_by_their_footers(spark, tmp_path):
    p = str(tmp_path / "t")
    frame(spark).withColumn("source", F.concat(F.lit("s"), F.date_format("service_date", "dd"))).drop("a").write.partitionBy("source").parquet(p)
    found = readers.footers(spark, p, "service_date", "source")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(service_date), MAX(service_date), COUNT(*)]" in plan
    days = {r.source: (r.low, r.high, r.n) for r in found.collect()}
    # forty days from 3 March: the days from 3 to 11 April come a second time
    assert days["s03"] == (D, dt.date(2025, 4, 3), 20) and days["s20"] == (dt.date(2025, 3, 20),) * 2 + (10,)
    assert readers.by_content(spark, p, "service_date", dt.date(2025, 3, 20), "source") == "s20"
    assert readers.by_content(spark, p, "service_date", D, "source") is None
    wanted = spark.createDataFrame([(dt.date(2025, 3, 30),), (dt.date(2025, 1, 1),), (dt.date(2025, 5, 1),)], "date date")
    narrow = spark.createDataFrame([(k, *v) for k, v in days.items() if k > "s11"] + [("none", None, None, 0)], "source string, low date, high date, n bigint")
    got = {r.date: (r.source, r.away) for r in readers.nearest_source(wanted, narrow, "source").collect()}
    assert got == {dt.date(2025, 3, 30): ("s30", 0), dt.date(2025, 1, 1): ("s12", 70), dt.date(2025, 5, 1): ("s31", 31)}
    assert {r.source for r in readers.nearest_source(wanted, narrow.limit(0), "source").collect()} == {None}
