"""Nights of a month over a store, the plan of a night, and copies by line."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from transitmill import nightly
from transitmill.sources import linecopies, sinks

MAY, FIRST = "2025-05", dt.date(2025, 5, 26)  # the month closes on the sixth day
DAYS = [FIRST + dt.timedelta(i) for i in range(6)]
YESTERDAY = dt.date(2025, 5, 30)
LINES = ("5", "9")


def put_tables(spark, store):
    month = F.lit(MAY)
    links = [(x, f"p{x}", i, f"s{i}>s{i + 1}~0", f"s{i}", f"s{i + 1}", f"S{i}", f"S{i + 1}", 300.0) for x in LINES for i in range(3)]
    tables = {
        "links": spark.createDataFrame(links, "line string, pattern_uid string, link_idx int, link_key string, from_stop string, to_stop string, from_name string, to_name string, len_m double"),
        "patterns": spark.createDataFrame([(x, f"p{x}", ["s0", "s1", "s2", "s3"]) for x in LINES], "line string, pattern_uid string, stop_ids array<string>"),
        "pattern_days": spark.createDataFrame([(x, f"p{x}", d, 30, True) for x in LINES for d in DAYS], "line string, pattern_uid string, service_date date, n_trips int, is_main boolean"),
        "coverage": spark.createDataFrame([(x, d, h, 1.0, 0, 3600.0, 180) for x in LINES for d in DAYS for h in range(5, 24)], "line string, service_date date, hour int, coverage double, flags int, covered_s double, n_snapshots int"),
    }
    for name, df in tables.items():
        df.withColumn("month", month).coalesce(1).write.partitionBy("month").parquet(f"{store}/{name}")


def ingest(spark, store, k, at="2025-06-01T00:00", short=0):
    """Day k: each line's vehicles report every 20 s; the feed's metres grow a little from day to day; line 9 names its end T."""
    d, fixes, seen = DAYS[k], [], []
    base = int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc).timestamp())
    for x in LINES:
        for hour in range(6, 23 - short):
            for i in range(4):
                for j in range(4 if i < 3 else 1):
                    fixes.append((x, f"t{hour}", base + 3600 * hour + 20 * (4 * i + j), f"s{i}", float((20 + k) * j), "T" if x == "9" else "s3"))
                if i != 1:
                    seen.append((x, f"t{hour}", f"s{i}", base + 3600 * hour + 80 * i))
    part = f"month={MAY}/service_date={d}"
    spark.createDataFrame(fixes, "line string, track_id string, ts bigint, point string, dist double, terminus string").coalesce(1).write.mode("overwrite").parquet(f"{store}/fixes/{part}")
    spark.createDataFrame(seen, "line string, trip_id string, stop_id string, t bigint").coalesce(1).write.mode("overwrite").parquet(f"{store}/seen_stops/{part}")
    sinks.commit(spark, f"{store}/raw_days/{d}", {"date": str(d), "written_at": at})


def rows(spark, store, name):
    df = spark.read.parquet(f"{store}/{name}")
    return sorted(map(repr, df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in sorted(df.dtypes)]).collect()))


def test_nights_then_the_whole_month_as_it_closes(spark, tmp_path):
    store = str(tmp_path / "nights")
    put_tables(spark, store)
    assert nightly.derive(spark, store, MAY, YESTERDAY)["mode"] == "current"  # no day yet
    for k in range(3):
        ingest(spark, store, k)
    first = nightly.derive(spark, store, MAY, YESTERDAY, now="2025-06-02")
    assert (first["mode"], first["why"], first["full_days"]) == ("full", "not derived", 3)
    placed = {d: df for d, df in ((str(d), rows_of(spark, store, d)) for d in DAYS[:3])}
    assert all(len(x) == 2 * 17 * 11 for x in placed.values())  # of 13 fixes a trip the first and the last aren't counted
    for k in (3, 4):
        ingest(spark, store, k)
    night = nightly.derive(spark, store, MAY, YESTERDAY, now="2025-06-03")
    assert night["mode"] == "incremental" and night["days_placed"] == [str(d) for d in DAYS[3:5]]
    assert (night["full_days"], len(night["dates"]), night["closed_full"]) == (3, 5, False)
    assert {d: rows_of(spark, store, d) for d in placed} == placed
    # a new day is placed with what the whole run learned: 66 m in the feed (day 2) are a link's 300
    most = spark.read.parquet(f"{store}/placed").filter(F.col("service_date") == str(DAYS[4])).agg(F.max("pos_m")).first()[0]
    assert most == 300.0
    inner = spark.read.parquet(f"{store}/placed").filter((F.col("service_date") == str(DAYS[4])) & (F.col("raw_dist_m") == 24)).select("pos_m").distinct().collect()
    assert {round(r.pos_m, 1) for r in inner} == {round(24 * 300 / 66, 1)}
    both = spark.read.parquet(f"{store}/passages").filter("hour = 12").groupBy("link_key").agg(F.sum("n_feed").alias("f"), F.sum("n_events").alias("e")).collect()
    assert {(r.link_key, r.f, r.e) for r in both} == {(f"s{i}>s{i + 1}~0", 10.0, 10.0) for i in range(3)}
    assert nightly.derive(spark, store, MAY, YESTERDAY)["mode"] == "current"
    ingest(spark, store, 5)
    last = nightly.derive(spark, store, MAY, YESTERDAY, now="2025-06-04")
    assert (last["mode"], last["why"], last["full_days"], last["closed_full"]) == ("full", "month closes", 6, True)
    once = str(tmp_path / "once")
    put_tables(spark, once)
    for k in range(6):
        ingest(spark, once, k)
    assert nightly.derive(spark, once, MAY, YESTERDAY)["mode"] == "full"
    for name in ("placed", "passages", "cube", "days", "roles", "linehours"):
        assert rows(spark, store, name) == rows(spark, once, name), name
    # a day that comes again, shorter, replaces its own rows only
    ingest(spark, store, 1, "2025-06-05", short=10)
    again = nightly.derive(spark, store, MAY, YESTERDAY, now="2025-06-06")
    assert (again["mode"], again["days_placed"]) == ("incremental", [str(DAYS[1])])
    assert len(rows_of(spark, store, DAYS[1])) == 2 * 7 * 11 and len(rows(spark, store, "placed")) == 2 * 11 * (5 * 17 + 7)


def rows_of(spark, store, day):
    return sorted(map(repr, spark.read.parquet(f"{store}/placed").filter(F.col("service_date") == str(day)).collect()))


def test_a_failed_night_is_reported_and_the_next_is_whole(spark, tmp_path, monkeypatch):
    store = str(tmp_path)
    put_tables(spark, store)
    ingest(spark, store, 0)

    def broken(*args):
        raise RuntimeError("no room")

    monkeypatch.setattr(nightly.jobs, "cube", broken)
    with pytest.raises(RuntimeError):
        nightly.derive(spark, store, MAY, YESTERDAY)
    prev = nightly.last_report(spark, store, MAY)
    assert "no room" in prev["failed"] and prev["dates"] == [] and prev["full_days"] == 0
    assert nightly.plan(MAY, nightly.written_days(spark, store, MAY), prev, YESTERDAY)["why"] == "the last run failed"


def test_plan():
    written = {str(d): "2025-06-01" for d in DAYS[:5]}
    prev = {"version": nightly.VERSION, "dates": sorted(written), "placed_at": "2025-06-02", "full_days": 5, "closed_full": False, "failed": None}
    plan = lambda **kw: nightly.plan(MAY, **({"written": written, "prev": prev, "yesterday": YESTERDAY} | kw))
    assert plan() == {"mode": "current", "days": [], "why": "up to date"}
    assert plan(full=True)["why"] == "asked" and plan(prev=None)["why"] == "not derived"
    assert plan(prev=prev | {"version": "0"})["why"] == "code changed"
    assert plan(prev=prev | {"dates": [*prev["dates"], "2025-05-01"]})["why"] == "days removed"
    assert plan(written=written | {str(DAYS[1]): "2025-06-03"}) == {"mode": "incremental", "days": [str(DAYS[1])], "why": "1 new days"}
    assert plan(prev=prev | {"full_days": 2, "dates": prev["dates"][:4]})["mode"] == "full"
    # a month that ended without its last day is placed as a whole once
    june = dt.date(2025, 6, 1)
    closing = plan(yesterday=june)
    assert closing["why"] == "month closed"
    after = nightly.report(MAY, written, closing, prev, "2025-06-05", june)
    assert after["closed_full"] and plan(yesterday=june, prev=after)["mode"] == "current"
    assert nightly.report(MAY, written, plan(written=written | {str(DAYS[0]): "2025-06-09"}), after, "2025-06-10", june)["full_days"] == 5


def feed(spark, tag, lines):
    of = lambda rows, schema: spark.createDataFrame(rows, "line string, " + schema)
    return {
        "patterns": of([(x, f"{tag}{x}", ["a", "b"]) for x in lines], "pattern_uid string, stop_ids array<string>"),
        "links": of([(x, f"{tag}{x}", 0, 5.0) for x in lines], "pattern_uid string, link_idx int, len_m double"),
        "stops": of([(x, s, tag) for x in lines for s in "ab"], "stop_id string, name string"),
        "pattern_days": of([(x, f"{tag}{x}", FIRST, 3) for x in lines], "pattern_uid string, service_date date, n_trips int"),
    }


def test_copies_by_line_follow_their_feeds(spark, tmp_path):
    store = str(tmp_path)
    read = lambda line, *shas: {n: sorted(map(repr, df.select(*sorted(df.columns)).collect())) for n, df in linecopies.read_line(spark, store, line, list(shas)).items()}
    linecopies.put_feed(spark, store, "12", feed(spark, "x", ["5", "9"]), "1")
    linecopies.put_feed(spark, store, "34", feed(spark, "y", ["5", "07"]), "1")
    own = {line: read(line, "12", "34") for line in ("5", "9", "07", "none")}
    assert linecopies.update(spark, store) == ["12", "34"] and linecopies.update(spark, store) == []
    assert {line: read(line, "12", "34") for line in own} == own and own["none"]["links"] == []
    assert len(own["5"]["links"]) == 2 and "sha='12'" in own["5"]["links"][0] and len(own["07"]["stops"]) == 2
    place = lambda: {"lines" if "/lines/links/" in f else "feeds" for f in linecopies.read_line(spark, store, "5", ["12"])["links"].inputFiles()}
    plan = linecopies.read_line(spark, store, "5", ["12"])["links"]._jdf.queryExecution().executedPlan().toString()
    assert place() == {"lines"} and "(line#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    # a feed that is written anew is read from its own tables until it is copied; a line that it lost goes
    linecopies.put_feed(spark, store, "12", feed(spark, "z", ["5"]), "2")
    assert place() == {"feeds"}
    fresh = {line: read(line, "12", "34") for line in own}
    assert fresh["9"]["links"] == [] and "z5" in "".join(fresh["5"]["links"])
    assert linecopies.update(spark, store) == ["12"]
    assert {line: read(line, "12", "34") for line in own} == fresh
    linecopies.forget(spark, store, "34")
    assert {line: read(line, "12", "34") for line in own} == fresh and linecopies.update(spark, store) == ["34"]
