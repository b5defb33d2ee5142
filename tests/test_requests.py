"""Requests over small month tables: which days, lines and links an answer counts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from transitmill.operators import network, stretches, timetable
from transitmill.plans import build
from transitmill.plans import requests as rq

FIRST, LAST = dt.date(2025, 4, 14), dt.date(2025, 5, 16)
DATES = [FIRST + dt.timedelta(i) for i in range((LAST - FIRST).days + 1)]


@pytest.fixture(scope="module")
def tables(spark):
    """Two lines, two links each; line 9 is a bus that loses less. 2 May has no feed, 6 May a strike."""
    cols = ["o_day_r", "o_day_s", "o_eve_r", "o_eve_s", "l_day_r", "l_day_s", "l_eve_r", "l_eve_s", "o_am_r", "o_am_s", "o_pm_r", "o_pm_s", "p_day", "p_eve", "p_am", "p_pm"]
    cube, run, plan = [], [], []
    for line, slow in (("5", 6.0), ("9", 4.0)):
        for d in DATES:
            for key in ("a>b~0", "a>b~1"):
                cube.append((line, d, key, slow * 10, 0.0, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0, slow * 3, 0.0, slow * 2, 0.0, 10.0, 5.0, 3.0, 2.0))
            nofeed, strike = d == dt.date(2025, 5, 2), d == dt.date(2025, 5, 6)
            for hour in (8, 22):
                plan.append((line, d, hour, 100.0, not nofeed))
                run.append((line, d, hour, 40.0 if strike else 95.0, not nofeed, 700.0, 100.0, 600.0, 80.0))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).cache()
    held = frame(cube, "line string, service_date date, link_key string, " + ", ".join(f"{c} double" for c in cols))
    return {
        "cube": held, "days": held.select("line", "service_date").distinct(),
        "roles": frame([(x, f"a>b~{k}", 0, "RUE HAUTE", "MIDI", 300.0) for x in "59" for k in (0, 1)], "line string, link_key string, term int, from_name string, to_name string, len_m double"),
        "modes": frame([("5", "tram"), ("9", "bus")], "line string, mode string"),
        "linehours": frame(run, "line string, service_date date, hour int, km double, feed_ok boolean, d_s double, t_s double, d_r double, t_r double"),
        "plan": frame(plan, "line string, service_date date, hour int, km double, feed_ok boolean"),
        "geometry": frame([("a>b~0", [[4.3, 50.8], [4.31, 50.8]]), ("a>b~1", [[4.3, 50.80005], [4.31, 50.80005]])], "link_key string, geometry array<array<double>>"),
    }


def test_days_left_out_and_their_reasons(spark, tables):
    q = rq.RankQuery(FIRST, LAST, exclude=((dt.date(2025, 5, 12), dt.date(2025, 5, 13)),))
    got = {r.date: r.reason for r in build.left_out(spark, q, tables).collect()}
    assert got == {dt.date(2025, 4, 21): "holiday", dt.date(2025, 5, 1): "holiday", dt.date(2025, 5, 2): "nofeed", dt.date(2025, 5, 6): "strike", dt.date(2025, 5, 12): "user_period", dt.date(2025, 5, 13): "user_period"}
    free = rq.RankQuery(FIRST, LAST, holidays="include", reduced="include")
    assert {r.date: r.reason for r in build.left_out(spark, free, tables).collect()} == {dt.date(2025, 5, 2): "nofeed"}


def test_ranking_honours_mode_days_and_lines(spark, tables):
    working = [d for d in DATES if d.weekday() < 5]
    page = build.ranking_page(tables, rq.RankQuery(FIRST, LAST, stops=True))
    rows = page["stretches"].collect()
    assert len(rows) == 1 and rows[0].link_keys == ["a>b~0", "a>b~1"] and rows[0].from_name == "Rue Haute"
    entry = {(e.line, e.n_days) for e in rows[0].lines}
    assert entry == {("5", len(working) - 4), ("9", len(working) - 4)}
    assert rows[0].veh_h_day == pytest.approx(2 * 10 * 20 * (4 + 2) / 3600)
    trams = build.ranking_page({n: t for n, t in tables.items() if n != "geometry"}, rq.RankQuery(FIRST, LAST, stops=True, mode="tram"))
    assert [[e.line for e in r.lines] for r in trams["stretches"].orderBy("rank").collect()] == [["5"], ["5"]]
    assert trams["envelope"].first().lines_used == 1 and [r.line for r in trams["lines"].collect()] == ["5"]
    own = build.ranking_page(tables, rq.RankQuery(FIRST, LAST, stops=True, mode="tram", lines=("9",)))
    assert [r.line for r in own["lines"].collect()] == ["9"]


def test_network_page(spark, tables):
    reg = tables["linehours"].select("line", "service_date", "hour", *[F.lit(2).alias(c) for c in ("n", "m", "nc", "bunch", "gap")], *[F.lit(600.0).alias(c) for c in ("r1", "s1", "r2", "s2")])
    page = build.network_page(tables | {"reglines": reg}, rq.NetQuery(FIRST, LAST, lines=("9",)))
    may = {r.grp: r for r in page["months"].filter("month = '2025-05'").collect()}
    days = [d for d in DATES if d.month == 5 and d not in (dt.date(2025, 5, 2), dt.date(2025, 5, 6))]
    chosen = [d for d in days if d.weekday() < 5 and d != dt.date(2025, 5, 1)]
    assert set(may) == {"all", "tram", "bus", "sel"} and may["all"].n_lines == 2 and may["sel"].n_lines == 1
    assert may["sel"].plan == 100 * len(chosen) and may["sel"].plan_all == 200 * len(days) and may["all"].real == pytest.approx(190 * len(chosen))
    assert (may["bus"].pct, may["bus"].v, may["bus"].n) == (95.0, 25.2, 2 * len(chosen))
    assert {(r.service_date.day, r.why, r.pct, r.out) for r in page["left_out"].collect()} == {(2, "nofeed", None, True), (6, "strike", 40, True)}
    assert {(r.month, r.days, r.days_all) for r in page["days"].collect()} >= {("2025-05", len(chosen), len(days))}
    total = {r.grp: r for r in page["total"].collect()}
    assert total["all"].plan == pytest.approx(sum(r.plan for r in page["months"].filter("grp = 'all'").collect()))


def test_categories_look_around_the_window(spark):
    days = [(dt.date(2025, 1, 6) + dt.timedelta(i), 19500.0 if (dt.date(2025, 1, 6) + dt.timedelta(i)).weekday() < 5 else 9000.0) for i in range(160)]
    days = [(d, 10000.0 if d == dt.date(2025, 3, 31) else n) for d, n in days]
    df, off = spark.createDataFrame(days, "date date, trips double"), spark.createDataFrame([], "date date")
    got = {(r.date, r.service) for r in timetable.categories(df, off, dt.date(2025, 3, 28), dt.date(2025, 4, 3)).collect()}
    assert got == {(dt.date(2025, 3, 31), "reduced_service")}


def test_order_of_stops():
    times = {"Fonson": 0, "Tilleul": 5, "Paix": 6, "Helmet": 9}
    assert network.order_stops(times, {("Fonson", "Paix"), ("Paix", "Tilleul"), ("Tilleul", "Helmet")}) == ["Fonson", "Paix", "Tilleul", "Helmet"]
    assert network.order_stops(times, set()) == list(times)
    # a loop without a way in begins at its earliest stop
    assert network.order_stops(times, {("Helmet", "Fonson"), ("Fonson", "Helmet"), ("Helmet", "Tilleul")}) == ["Paix", "Fonson", "Helmet", "Tilleul"]
    assert network.order_stops({}, {("a", "b")}) == []


def test_merged_periods_of_a_request():
    day = lambda n: dt.date(2025, 3, n)
    periods = ((day(10), day(12)), (dt.date(2025, 2, 1), day(5)), (day(6), day(7)), (dt.date(2025, 6, 1), dt.date(2025, 6, 2)))
    assert rq.merged(periods, day(3), day(31)) == ((day(3), day(7)), (day(10), day(12)))
    assert rq.merged((), day(3), day(31)) == ()


def test_parallel_tracks():
    track = [[4.30, 50.80], [4.31, 50.80], [4.32, 50.80]]
    beside = lambda m: [[x, y + m / 110540.0] for x, y in track]
    assert stretches.overlap(track, beside(5)) == 1.0 and stretches.overlap(track, beside(220)) == 0.0
    assert stretches.overlap(track, track[:1]) == 0.0 and stretches.overlap(beside(29.5)[:2], track) == 1.0 == stretches.overlap(track, beside(29.5)[:2])


def test_network_selects_a_mode_and_checks_its_fields(spark, tables):
    groups = lambda q: {(r.grp, r.n_lines, r.real) for r in build.network_page(tables, q)["total"].collect()}
    every = groups(rq.NetQuery(FIRST, LAST))
    tram = groups(rq.NetQuery(FIRST, LAST, mode="tram"))
    assert {g for g, _, _ in every} == {"all", "tram", "bus"} and {g for g, _, _ in tram} == {"all", "tram", "bus", "sel"}
    assert {x[1:] for x in tram if x[0] == "sel"} == {x[1:] for x in tram if x[0] == "tram"}
    listed = groups(rq.NetQuery(FIRST, LAST, mode="tram", lines=("9",)))
    assert {x[1:] for x in listed if x[0] == "sel"} == {x[1:] for x in listed if x[0] == "bus"}
    for bad in ({"mode": "zeppelin"}, {"hours": (20, 3)}, {"hours": (-1, 3)}, {"hours": (6, 29)}):
        with pytest.raises(rq.BadRequest):
            build.network_page(tables, rq.NetQuery(FIRST, LAST, **bad))


def test_jobs_say_what_a_store_cannot_leave_out(spark, tables, tmp_path, capsys):
    from transitmill import jobs

    store = str(tmp_path)
    month = F.date_format("service_date", "yyyy-MM")
    for name in ("linehours", "plan"):
        tables[name].withColumn("month", month).write.partitionBy("month").parquet(f"{store}/{name}")
    q = rq.NetQuery(FIRST, LAST, mode="tram", school="exclude")
    with pytest.raises(rq.BadRequest):
        jobs.held_tables(spark, store, q, ("linehours",), ("modes",))
    tables["modes"].write.parquet(f"{store}/modes")
    assert jobs.not_applied({}, q) == ["days without a feed", "strikes", "reduced service", "school holidays"]
    jobs.main(["network", "--store", store, "--from", str(FIRST), "--to", str(LAST), "--mode", "tram", "--out", f"{store}/out"], spark)
    assert "reduced service" in (said := capsys.readouterr().err) and "strikes" not in said
    total = spark.read.option("header", True).csv(f"{store}/out/total")
    assert {r.grp for r in total.collect()} == {"all", "tram", "bus", "sel"}
    want = {r.grp: r.real for r in build.network_page(tables, rq.NetQuery(FIRST, LAST, mode="tram"))["total"].collect()}
    assert {r.grp: float(r.real) for r in total.collect()} == want
