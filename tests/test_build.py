"""The month build of all lines against builds of single lines, and the jobs over a store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from transitmill import jobs
from transitmill.plans import build
from transitmill.plans.requests import RankQuery

DAYS = [dt.date(2025, 3, 3) + dt.timedelta(i) for i in range(5)]


@pytest.fixture(scope="module")
def inputs(spark):
    """Two lines of three links. By day every vehicle takes 80 s a link, in the evening 40 s; line 9's positions miss hour 12."""
    fixes, passages, cover = [], [], []
    for line in ("5", "9"):
        for d in DAYS:
            base = int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc).timestamp())
            for hour in range(5, 24):
                cover.append((line, d, hour, 1.0, 0, 3600.0, 180))
                seen = not (line == "9" and hour == 12)
                n = 4 if hour < 20 else 2
                for i in range(3):
                    passages.append((line, d, hour, f"s{i}>s{i + 1}~0", 1.0 if seen else 0.0, 1.0))
                    fixes += [(line, f"{line}-{d}-{hour}", base + 3600 * hour + 20 * (n * i + j), d, hour, "p" + line, i, f"s{i}>s{i + 1}~0", 60.0 * j + 10, 300.0 * i + 60 * j, 10 * j, False) for j in range(n) if seen]
    links = [(line, "p" + line, i, f"s{i}>s{i + 1}~0", f"s{i}", f"s{i + 1}", f"S{i}", f"S{i + 1}", 300.0) for line in ("5", "9") for i in range(3)]
    out = {
        "placed": spark.createDataFrame(fixes, "line string, track_id string, ts long, service_date date, hour int, pattern_uid string, link_idx int, link_key string, pos_m double, s_m double, raw_dist_m int, at_stop boolean"),
        "passages": spark.createDataFrame(passages, "line string, service_date date, hour int, link_key string, n_feed double, n_events double"),
        "links": spark.createDataFrame(links, "line string, pattern_uid string, link_idx int, link_key string, from_stop string, to_stop string, from_name string, to_name string, len_m double"),
        "patterns": spark.createDataFrame([(x, "p" + x, ["s0", "s1", "s2", "s3"]) for x in ("5", "9")], "line string, pattern_uid string, stop_ids array<string>"),
        "pattern_days": spark.createDataFrame([(x, "p" + x, True) for x in ("5", "9")], "line string, pattern_uid string, is_main boolean"),
        "coverage": spark.createDataFrame(cover, "line string, service_date date, hour int, coverage double, flags int, covered_s double, n_snapshots int"),
    }
    return {n: df.cache() for n, df in out.items()}


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_all_lines_at_once_equal_single_lines(spark, inputs):
    keep = lambda name, df: df.cache()
    whole = {n: df.cache() for n, df in build.month_tables(*[inputs[n] for n in jobs.INPUTS], hold=keep).items()}
    assert set(whole) == {"cube", "days", "roles", "marks", "hourly", "linehours"}
    for line in ("5", "9"):
        alone = build.month_tables(*[inputs[n].filter(F.col("line") == line) for n in jobs.INPUTS], hold=keep)
        for name, df in alone.items():
            assert rows(df) == rows(whole[name].filter(F.col("line") == line)), name
    day = {r.line: r for r in whole["cube"].filter(F.col("link_key") == "s1>s2~0").filter(F.col("service_date") == DAYS[0]).collect()}
    # hours 6 to 19 with four fixes and hour 20 with two; line 9 lacks an hour of four
    assert day["5"].o_day_r + day["5"].o_day_s == 58 and day["9"].o_day_r + day["9"].o_day_s == 54
    assert (day["5"].p_day, day["9"].p_day, day["5"].p_eve) == (15, 14, 4)
    assert {(r.link_key, r.term) for r in whole["roles"].collect()} == {("s0>s1~0", 1), ("s1>s2~0", 0), ("s2>s3~0", 1)}


def test_jobs(spark, inputs, tmp_path):
    store = str(tmp_path)
    for name, df in inputs.items():
        df.withColumn("month", F.lit("2025-03")).write.partitionBy("month").parquet(f"{store}/{name}")
    jobs.main(["cube", "--store", store, "--month", "2025-03"], spark)
    before = rows(spark.read.parquet(f"{store}/cube"))
    jobs.main(["cube", "--store", store, "--month", "2025-03", "--lines", "9"], spark)
    assert rows(spark.read.parquet(f"{store}/cube")) == before
    q = RankQuery(DAYS[0], DAYS[-1], stops=True, terminus=True)
    got = {r.link_key: r.s_per_passage for r in jobs.rank(spark, store, q).collect()}
    assert set(got) == {"s0>s1~0", "s1>s2~0", "s2>s3~0"} and all(v > 20 for v in got.values())
    flagged = jobs.rank(spark, store, RankQuery(DAYS[0], DAYS[-1], stops=True))
    assert {(r.list, r.reasons) for r in flagged.collect()} == {("kept", ""), ("flagged", "terminus")}
    # other hours read the hourly table: noon is seen on one line only, where a passage takes 80 s against 40 s
    noon = jobs.rank(spark, store, RankQuery(DAYS[0], DAYS[-1], stops=True, terminus=True, hours=(12, 13))).collect()
    assert {round(r.s_per_passage, 6) for r in noon} == {40.0}
    jobs.main(["ranking", "--store", store, "--from", "2025-03-03", "--to", "2025-03-07", "--stops", "--out", f"{store}/out"], spark)
    assert spark.read.option("header", True).csv(f"{store}/out").count() == 3
    with pytest.raises(SystemExit):
        jobs.main(["cube", "--store", store], spark)
