"""Operators against hand-computed values and against each other."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from transitmill.functions import exprs
from transitmill.operators import analysis, coverage, cube, ingest, network, pages, ranking, regularity, routes, stretches, timetable, windows, zones

D = dt.date(2025, 3, 3)
day = lambda n: D + dt.timedelta(n)


def trips(late=0):
    """Four trips every ten minutes at stop A from 06:00, the second `late` seconds late."""
    m = int(dt.datetime(2025, 3, 3, tzinfo=dt.timezone.utc).timestamp()) + 6 * 3600
    return [("5", 0, "A", D, str(i), m + 600 * i + (late if i == 1 else 0), m + 600 * i) for i in range(4)]


TIMES = "line string, direction_id int, stop_id string, service_date date, trip_id string, t bigint, s bigint"


def test_headways_and_waits(spark):
    hw = regularity.headways(spark.createDataFrame(trips(480), TIMES))
    r = regularity.summed(hw, ["line"]).first()
    assert (r.m, r.s1, r.s2) == (3, 1800, 3 * 600**2)
    assert (r.n, r.r1, r.r2) == (3, 1800, 1080**2 + 120**2 + 600**2)
    assert (r.nc, r.bunch, r.gap) == (3, 1, 1)
    w = regularity.waits(regularity.summed(hw, ["line"])).first()
    assert (w.ws, w.ew, w.nh) == (5.0, 2.13, 3)


def test_headways_break(spark):
    m = trips()[0][6]
    rows = [("5", 0, "A", D, str(k), m + x, m + x) for k, x in enumerate((0, 600, 9000, 9600))]
    r = regularity.summed(regularity.headways(spark.createDataFrame(rows, TIMES)), ["line"]).first()
    assert (r.m, r.s1) == (2, 1200)


def test_covered_stops_and_last_stop(spark):
    rows = [("5", 0, s, D, str(i), 1000 * i, 1000 * i) for s in "ABC" for i in range(6) if s != "B" or i % 2]
    got = {r.stop_id for r in regularity.covered_stops(spark.createDataFrame(rows, TIMES)).collect()}
    assert got == {"A", "C"}
    ev = "trip_id string, start_date string, route_id string, direction_id int, trip_schedule_relationship int, stop_sequence int, stop_id string, arrival_time timestamp, departure_time timestamp, arrival_delay int, departure_delay int, observed boolean"
    at = dt.datetime(2025, 3, 3, 6)
    raw = [("t", "20250303", "5", 0, 0, k, s, at, at, 30, None, s != "Z") for k, s in enumerate("ABZ")]
    st = regularity.stop_times(spark.createDataFrame(raw, ev)).collect()
    assert {r.stop_id for r in st} == {"A", "B"} and all(r.t - r.s == 30 for r in st)


def test_frozen_polls(spark):
    rows = [(0, "a", 1), (0, "b", 2), (20, "b", 3), (40, "b", 3), (60, "x", 1), (65, "x", 1)]
    times = [(D, t) for t in (0, 20, 40, 60, 65, 80, 100)]
    snaps = ingest.polls(spark.createDataFrame(rows, "ts bigint, line string, dist int"), spark.createDataFrame(times, "day date, ts bigint"), ["line", "dist"])
    got = {r.ts: (r.n_rows, r.frozen) for r in snaps.collect()}
    assert got == {0: (2, False), 20: (1, False), 40: (1, True), 60: (1, False), 65: (1, True), 80: (0, False), 100: (0, True)}
    live = ingest.live_rows(spark.createDataFrame(rows, "ts bigint, line string, dist int"), snaps)
    assert sorted(r.ts for r in live.collect()) == [0, 0, 20, 60]


def test_partial_sources(spark):
    week = [(day(7 * k), 78) for k in range(4)] + [(day(28), 15)]
    got = {r.date: (r.ref, r.partial) for r in ingest.partial_sources(spark.createDataFrame(week, "date date, lines int")).collect()}
    assert got[day(28)] == (78, True) and got[day(21)] == (78, False) and got[D] == (None, False)


def test_shard_parts_and_packs(spark):
    df = spark.range(10).withColumnRenamed("id", "d")
    assert sorted(r.d for r in ingest.shard(df, "d", 0, 3).collect()) == [0, 3, 6, 9]
    parts = spark.createDataFrame([(0, 10), (0, 5), (2, 8), (9, 12), (11, 12)], "start int, end int")
    assert sorted(map(tuple, ingest.chosen_parts(parts).collect())) == [(0, 10), (9, 12)]
    sizes = spark.createDataFrame([("a", 6), ("b", 6), ("c", 2), ("d", 20)], "k string, n bigint")
    assert [(r.k, r.pack) for r in ingest.packed_groups(sizes, "k", "n", 10).orderBy("k").collect()] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    full, got = spark.createDataFrame([(i, 100) for i in range(30)], "ts int, n int"), spark.createDataFrame([(i, 50) for i in range(30)], "ts int, n int")
    assert tuple(ingest.short_samples(full, got).first()) == (6, 6, True)


def test_absence_and_status(spark):
    rows = [(day(k), h, 30) for k in range(4) for h in range(6, 22) if not (k == 2 and h < 12)]
    counts = spark.createDataFrame(rows, "service_date date, hour int, n bigint")
    dates = spark.createDataFrame([(day(k),) for k in range(4)], "service_date date")
    got = sorted(map(tuple, coverage.absent_hours(counts, dates).collect()))
    assert got == [(day(2), h) for h in range(6, 12)]
    cov = spark.createDataFrame([(D, h, 0.1 if h in (6, 7, 8) else 1.0, 0) for h in range(4, 28)], "service_date date, hour int, coverage double, flags int")
    both = coverage.with_absence(cov, spark.createDataFrame([(D, h) for h in (6, 7, 8)], "service_date date, hour int"))
    q = coverage.day_quality(both)
    assert tuple(q.select("bad", "absent", "unusable").first()) == (3, 3, 3)
    days = q.withColumns({"ingested": F.lit(True), "derived": F.lit(True), "obs": F.lit(5)})
    assert coverage.day_status(days).first().status == "ok"
    assert coverage.usable_hours(both)[1].count() == 1


def test_partial_feed_flag(spark):
    cov = spark.createDataFrame([(D, 8, 1.0, 0), (D, 9, 1.0, 0)], "service_date date, hour int, coverage double, flags int")
    p = spark.createDataFrame([(D, 8, 2.0, 10.0), (D, 9, 10.0, 10.0)], "service_date date, hour int, n_feed double, n double")
    assert {r.hour: r.flags for r in coverage.with_partial_feed(cov, p).collect()} == {8: 256, 9: 0}


def test_after_midnight(spark):
    p = spark.createDataFrame([(D, 24, "k", 3.0, 0.0), (day(1), 0, "k", 0.0, 4.0), (day(1), 8, "k", 5.0, 5.0)], "service_date date, hour int, link_key string, n_feed double, n_events double")
    got = {(r.service_date, r.hour): r.n for r in cube.on_service_day(p, ["link_key"]).collect()}
    assert got == {(D, 24): 4, (day(1), 8): 5}


def test_hourly_speed_hours_and_consistency(spark):
    fx = spark.createDataFrame([(D, 8, "k", 1.0, False, False), (D, 9, "k", 2.0, True, True)], "service_date date, hour int, link_key string, w double, stop boolean, long boolean")
    p = spark.createDataFrame([(D, 8, "k", 100.0, 95.0), (D, 9, "k", 100.0, 15.0)], "service_date date, hour int, link_key string, n double, n_feed double")
    hours = p.select("service_date", "hour")
    h = cube.hourly(fx, p, hours)
    assert {r.hour: (r.ok, r.spd_ok) for r in h.collect()} == {8: (True, True), 9: (True, False)}
    c = cube.cube(fx, p, hours, ["service_date", "link_key"]).first()
    sums = h.agg(F.sum("o_r").alias("r"), F.sum("o_s").alias("s"), F.sum("n").alias("n")).first()
    assert (c.o_day_r, c.o_day_s, c.p_day, c.l_day_s) == (sums.r, sums.s, sums.n, 2.0)


def test_line_hours(spark):
    h = spark.createDataFrame([(D, 8, f"k{i}", 10.0, True, o, s) for i, (o, s) in enumerate([(8.0, 2.0), (8.0, 2.0), (8.0, 2.0)])], "service_date date, hour int, link_key string, n double, spd_ok boolean, o_r double, o_s double")
    lk = spark.createDataFrame([("k0", 500.0, 0, False, False), ("k1", 500.0, 1, False, False), ("k2", 500.0, 2, True, False)], "link_key string, len_m double, term int, reg boolean, reg_r boolean")
    r = cube.line_hours(h, lk).first()
    assert (r.km, r.d_s, r.t_s, r.d_r, r.t_r) == (15.0, 5000.0, 200.0, 8500.0, 320.0)


def test_regulation(spark):
    cols = "service_date date, link_key string, " + ", ".join(f"{p}_{b}_{z} double" for p in "ol" for b in ("day", "eve") for z in "rs") + ", p_day double, p_eve double"
    row = lambda k, o, l, d=D: (d, k, o, 0.0, 10.0, 0.0, l, 0.0, 0.0, 0.0, 10.0, 10.0)  # noqa: E731, E741
    df = spark.createDataFrame([row("hold", 30.0, 15.0), row("jam", 30.0, 2.0), row("sat", 30.0, 15.0, day(5))], cols)
    assert {r.link_key: (r.reg, r.reg_r) for r in cube.regulated(df, ["link_key"]).collect()} == {"hold": (True, True), "jam": (False, False)}
    assert cube.regulated(df, ["link_key"], [D]).count() == 0


def test_link_roles(spark):
    lk = [("p", 0, "k0", "A", "B"), ("p", 1, "k1", "B", "C"), ("p", 2, "k2", "C", "E"), ("p", 3, "k3", "E", "F"), ("q", 0, "k1", "B", "C")]
    links = spark.createDataFrame([(p, i, k, a, b, a, b, 100.0) for p, i, k, a, b in lk], "pattern_uid string, link_idx int, link_key string, from_stop string, to_stop string, from_name string, to_name string, len_m double")
    pats = spark.createDataFrame([("p", list("ABCEF")), ("q", ["B", "C"])], "pattern_uid string, stop_ids array<string>")
    main = spark.createDataFrame([("p", True), ("q", False)], "pattern_uid string, is_main boolean")
    assert {r.link_key: r.term for r in cube.link_roles(links, pats, main).collect()} == {"k0": 1, "k1": 2, "k2": 2, "k3": 1}


def test_stands_and_marks(spark):
    fx = [("a", 20 * i, 0.0 if i < 10 else 50.0 * i) for i in range(12)] + [(None, 0, 0.0), (None, 20, 0.0)]
    got = zones.stands(spark.createDataFrame(fx, "track_id string, ts bigint, s_m double")).filter("long")
    assert got.count() == 10
    rows = spark.createDataFrame([("k", 38)] * 25 + [("k", 39)] * 30 + [("k", 12)] * 3, "link_key string, raw_dist_m int")
    mk = zones.marks(rows, ["link_key"], "raw_dist_m")
    assert [r.mark_m for r in mk.collect()] == [38] and zones.heads(mk, ["link_key"]).first().head_m == 39
    fixes = spark.createDataFrame([("k", 38, 45.0, 145.0), ("k", 20, 45.0, 145.0)], "link_key string, raw_dist_m int, pos_m double, s_m double")
    out = zones.prepared(fixes, mk, zones.heads(mk, ["link_key"])).orderBy("raw_dist_m").collect()
    assert [(r.pos_m, r.s_m) for r in out] == [(45.0, 145.0), (38.5, 138.5)]


def test_trip_hours_and_shape(spark):
    t = spark.createDataFrame([(1, 27000, 30600, 10.0), (2, 32400, 32400, 4.0)], "id int, start_s bigint, end_s bigint, km double")
    got = sorted((r.hour, r.km, r.trips) for r in timetable.trip_hours(t).collect())
    assert got == [(7, 5.0, 1), (8, 5.0, 0), (9, 4.0, 1)]
    p = spark.createDataFrame([("s", 1, 4.0, 50.0), ("s", 2, 4.0, 50.01)], "shape_id string, q int, lon double, lat double")
    assert timetable.path_length(p, ["shape_id"], "q", "lon", "lat").first().km == pytest.approx(1.112, abs=0.01)


def test_services(spark):
    cal = "service_id string, " + ", ".join(f"{w} int" for w in timetable.WEEK) + ", start_date date, end_date date"
    c = spark.createDataFrame([("wk", 1, 1, 1, 1, 1, 0, 0, D, day(6)), ("sa", 0, 0, 0, 0, 0, 1, 0, D, day(6))], cal)
    x = spark.createDataFrame([("wk", day(2), 2), ("sa", day(6), 1)], "service_id string, date date, exception_type int")
    t = spark.createDataFrame([("wk",)] * 3 + [("sa",)], "service_id string")
    got = {r.date: r.trips for r in timetable.trips_by_date(timetable.services(c, x), t).collect()}
    assert got == {D: 3, day(1): 3, day(3): 3, day(4): 3, day(5): 1, day(6): 1}


def test_easter_and_holidays(spark):
    got = spark.createDataFrame([(2024,), (2025,), (2027,), (1954,), (1981,), (2000,), (2076,)], "year int").select(exprs.easter("year").alias("e"))
    assert [r.e for r in got.collect()] == [dt.date(2024, 3, 31), dt.date(2025, 4, 20), dt.date(2027, 3, 28), dt.date(1954, 4, 18), dt.date(1981, 4, 19), dt.date(2000, 4, 23), dt.date(2076, 4, 19)]
    h = {r.date for r in timetable.holidays(spark.createDataFrame([(2025,)], "year int")).collect()}
    assert len(h) == 10 and {dt.date(2025, 4, 21), dt.date(2025, 5, 29), dt.date(2025, 6, 9)} <= h


def test_day_classes(spark):
    a = dt.date(2025, 2, 3)
    level = {i: 19500 if (a + dt.timedelta(i)).weekday() < 5 else 12000 if (a + dt.timedelta(i)).weekday() == 5 else 9000 for i in range(70)}
    week = [i for i in level if dt.date(2025, 2, 24) <= a + dt.timedelta(i) <= dt.date(2025, 3, 7) and (a + dt.timedelta(i)).weekday() < 5]
    for i in week:
        level[i] = 17500
    level[(dt.date(2025, 3, 31) - a).days] = 12000
    days = spark.createDataFrame([(a + dt.timedelta(i), v) for i, v in level.items()], "date date, trips int")
    got = {r.date: r.service for r in timetable.day_classes(timetable.service_ratios(days)).collect()}
    assert got == {a + dt.timedelta(i): "school_holiday" for i in week} | {dt.date(2025, 3, 31): "reduced_service"}


def test_merged_periods_and_exclusions(spark):
    m = lambda n: dt.date(2025, 3, n)
    p = spark.createDataFrame([(m(10), m(12)), (m(1), m(5)), (m(6), m(7)), (dt.date(2025, 5, 1), dt.date(2025, 5, 2))], "first date, last date")
    got = sorted(map(tuple, windows.merged_periods(p, [], "first", "last", F.lit(m(3)), F.lit(m(31))).collect()))
    assert got == [(m(3), m(7)), (m(10), m(12))]
    days = spark.createDataFrame([(m(i),) for i in range(1, 32)], "date date")
    out = timetable.exclusions(days, spark.createDataFrame([(m(11),)], "date date"), spark.createDataFrame([(m(11), "reduced_service"), (m(12), "reduced_service")], "date date, service string"), p)
    why = {r.date: r.reason for r in out.collect()}
    assert why[m(11)] == "holiday" and why[m(12)] == "reduced_service" and why[m(10)] == "user_period" and m(20) not in why


def test_anomalies_and_spill(spark):
    rows = "line string, service_date date, km double, feed_ok boolean"
    run = spark.createDataFrame([("1", D, 40.0, True), ("1", day(1), 5.0, False), ("1", day(2), 97.0, True)], rows)
    plan = spark.createDataFrame([("1", D, 100.0, True), ("1", day(1), 100.0, False), ("1", day(2), 100.0, True), ("99", D, 900.0, True)], rows)
    reduced = spark.createDataFrame([(day(2),)], "date date")
    got = {r.service_date: (r.why, r.pct) for r in network.anomalies(run, plan, reduced).collect()}
    assert got == {D: ("strike", 40), day(1): ("nofeed", None), day(2): ("strike", 97)}
    jan = spark.createDataFrame([(dt.date(2025, 1, 1), 8), (dt.date(2024, 12, 31), 24)], "service_date date, hour int")
    dec = spark.createDataFrame([(dt.date(2024, 12, 31), 23)], "service_date date, hour int")
    assert network.spill(dec, jan, F.lit(dt.date(2024, 12, 31))).count() == 2


def test_ranking(spark):
    z = {f"{p}_{b}_{k}": 0.0 for p in "ol" for b in ("day", "eve", "am", "pm") for k in "rs"}
    row = lambda k, day_r, am: {"line": "5", "link_key": k, "D": 10.0, **z, "o_day_r": day_r, "o_am_r": am, "o_eve_r": 10.0, "p_day": 10.0, "p_eve": 10.0, "p_am": 5.0, "p_pm": 0.0}
    x = ranking.excess(spark.createDataFrame([row("a", 30.0, 50.0), row("b", 5.0, 0.0), row("c", 10.0, 0.0)]))
    r = {q.link_key: q for q in x.collect()}
    assert r["a"].ex == 40 and r["a"].veh_s_day == 40 and r["a"].ex_pm is None and r["b"].veh_s_day < 0
    roles = spark.createDataFrame([("5", "a", 1), ("5", "b", 0)], "line string, link_key string, term int")
    flagged = {q.link_key: (q.reason, q.peak) for q in ranking.reasons(x, roles).collect()}
    assert flagged["a"] == ("terminus", "am") and flagged["b"][0] is None
    top = ranking.ranked(x, None, 5).collect()
    assert [(q.stretch, q.rank) for q in top] == [("a", 1)]
    assert tuple(ranking.totals(x, ["line"]).first()) == ("5", 40.0, 1)


def test_overlap_and_merge(spark):
    line = [[4.35 + i * 1e-4, 50.85] for i in range(20)]
    shift = lambda m: [[x, y + m / 111_195] for x, y in line]
    assert stretches.overlap(line, shift(5)) == 1.0 and stretches.overlap(line, shift(220)) == 0.0
    df = spark.createDataFrame([("a", "X", "Y", 1.0, line), ("b", "X", "Y", 3.0, shift(5)), ("c", "X", "Y", 2.0, shift(220)), ("d", "X", "Z", 1.0, line)], "link_key string, from_name string, to_name string, cost double, geometry array<array<double>>")
    assert {r.link_key: r.stretch for r in stretches.merge(df).collect()} == {"a": "b", "b": "b", "c": "c", "d": "d"}


def test_route_order_and_thinning(spark):
    assert network.order_stops({"Fonson": 0, "Tilleul": 1, "Paix": 2, "Helmet": 3}, {("Fonson", "Paix"), ("Paix", "Tilleul"), ("Tilleul", "Helmet")}) == ["Fonson", "Paix", "Tilleul", "Helmet"]
    assert network.order_stops({"a": 1, "b": 0}, {("a", "b"), ("b", "a")}) == ["b", "a"]
    geo = spark.createDataFrame([([[4.0, 50.0], [4.00001, 50.0], [4.001, 50.0], [4.00101, 50.0]],)], "g array<array<double>>")
    assert geo.select(network.thinned(F.col("g")).alias("t")).first().t == [[4.0, 50.0], [4.001, 50.0], [4.00101, 50.0]]


def test_versions(spark):
    r = [("full", 0, 100, 10), ("short", 1, 7, 8), ("full", 2, 20, 10), ("full", 3, 5, 10), ("long", 4, 10, 12)]
    df = spark.createDataFrame([(0, s, day(50 * k), day(50 * k + n - 1), n, z) for s, k, n, z in r], "direction_id int, stops string, first date, last date, n_days int, n_stops int")
    got = {x.stops: (x.n_days, x.periods, x.ref) for x in routes.versions(df, ["direction_id"]).collect()}
    assert got == {"full": (125, 2, True), "short": (7, 1, False), "long": (10, 1, False)}
    v = spark.createDataFrame([(0, ["A", "B", "C"], True), (0, ["B", "C", "D"], False)], "direction_id int, stops array<string>, ref boolean")
    c = routes.stop_changes(v, ["direction_id"]).filter("not ref").first()
    assert c.removed == ["A"] and c.added == ["D"]
    back = df.filter("stops <> 'long'").unionByName(spark.createDataFrame([(0, "cut", day(300), day(340), 41, 6)], df.schema))
    ref = spark.createDataFrame([(0, "cut")], "direction_id int, stops string")
    x = routes.lasting_change(back, ref, ["direction_id"]).first()
    assert (x.before, x.since) == ("full", day(300)) or x.before == "full"


def test_track_changes():
    names = list("ABCDE")
    assert routes.track_changes([100, 100, 100, 100], [100, 100, 100, 100], names) == []
    assert routes.track_changes([300, 300, 300, 300], [300, 600, 400, 300], names) == [("detour", "B", "D", 400, None)]
    assert routes.track_changes([300, 300, 300, 300], [300, 500, 110, 300], names) == [("moved_stop", "B", "D", 200, "C")]
    assert routes.track_changes([300] * 4, [325] * 4, names) == [("detour", "A", "B", 100, None)]


def test_incremental(spark):
    day_l = spark.createDataFrame([("a", 100.0, 9), ("b", 200.0, 9), ("c", 300.0, 9), ("q", 50.0, 9)], "k string, flen double, n int")
    month = spark.createDataFrame([("a", 110.0, 40), ("b", 220.0, 5), ("c", 330.0, 40)], "k string, flen double, n int")
    assert {r.k: r.flen for r in routes.with_feed_lengths(day_l, month, ["k"]).collect()} == {"a": 110, "b": 200, "c": 330, "q": 50}
    assert [routes.build_mode(3, 3), routes.build_mode(5, 2), routes.build_mode(5, 0), routes.build_mode(5, 0, closed=True)] == ["full", "incremental", "current", "full"]
    old = spark.createDataFrame([(D, 1), (day(1), 2)], "service_date date, v int")
    new = spark.createDataFrame([(day(1), 3), (day(2), 4)], "service_date date, v int")
    assert sorted(r.v for r in routes.merge_days(old, new).collect()) == [1, 3, 4]


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, at int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 7, "z")], "k string, since int, v string")
    assert {(r.k, r["at"]): r.v2 for r in windows.as_of(left, right, ["k"], "at", "since", "v", "v2").collect()} == {("a", 5): "y", ("a", 1): None, ("b", 9): None}


def test_patterns_and_links(spark):
    st = spark.createDataFrame([("t1", i, s) for i, s in enumerate("ABC")] + [("t2", i, s) for i, s in enumerate("ABC")], "trip_id string, stop_sequence int, stop_id string")
    tr = spark.createDataFrame([("5", 0, "t1"), ("5", 0, "t2")], "line string, direction_id int, trip_id string")
    p = routes.patterns(st, tr)
    assert p.select("pattern_uid").distinct().count() == 1
    assert [(r.link_idx, r.link_key) for r in routes.pattern_links(p).orderBy("link_idx").collect()] == [(0, "A>B~0"), (1, "B>C~0")]


def test_segments_cover_links(spark):
    links = spark.createDataFrame([("k", 100.0), ("m", 7.0)], "link_key string, len_m double")
    for grid, phase in (("stops", 0.0), ("equal", 0.0), ("fixed", 0.0), ("fixed", 10.0)):
        s = analysis.segments(links, 30.0, phase, grid)
        assert {r.link_key: round(r.t, 6) for r in s.groupBy("link_key").agg(F.sum(F.col("b_m") - F.col("a_m")).alias("t")).collect()} == {"k": 100.0, "m": 7.0}


def test_bootstrap_interval_holds_the_estimate(spark):
    df = spark.createDataFrame([("k", day(i), float(i % 5 + 1), 1.0) for i in range(40)], "link_key string, service_date date, v double, w double")
    r = analysis.bootstrap(df, ["link_key"], "v", "w", 100).first()
    assert r.est == 3.0 and 2.2 < r.lo < 3.0 < r.hi < 3.8
    assert tuple(r) == tuple(analysis.bootstrap(df.repartition(5), ["link_key"], "v", "w", 100).first())


def test_expressions(spark):
    r = spark.createDataFrame([(5.0, 0.0, "ARTS-LOI gare du midi")], "a double, b double, n string")
    out = r.select(exprs.ratio("a", "b").alias("x"), exprs.title_case("n").alias("t"), exprs.nearest_rank(F.array(*[F.lit(i) for i in range(10)]), 0.9).alias("q")).first()
    assert out.x is None and out.t == "Arts-Loi Gare Du Midi" and out.q == 8
    z = spark.createDataFrame([(dt.date(2025, 3, 30),)], "d date").select(*[c.alias(n) for n, c in zip("ab", exprs.service_window("d", "Europe/Brussels"), strict=True)], exprs.local_midnight("d", "Europe/Brussels").alias("m")).first()
    assert z.b - z.a == 23 * 3600 and z.a - z.m == 3 * 3600


def test_regularity_scopes(spark):
    cols = "line string, direction_id int, stop_id string, service_date string, hour int, n long, m long, nc long, bunch long, gap long, r1 double, r2 double, s1 double, s2 double"
    row = lambda stop, hour, n: ("1", 0, stop, "2024-01-01", hour, n, n, n, 0, 0, 600.0 * n, 360000.0 * n, 600.0 * n, 360000.0 * n)
    hw = spark.createDataFrame([row("a", 8, 2), row("a", 22, 3), row("b", 9, 1), row("c", 23, 5)], cols)
    got = {(r.scope, r.hour, r.stop_id): r.n for r in pages.regularity_scopes(hw, (6, 21)).collect()}
    assert got == {("total", None, None): 3, ("hour", 8, None): 2, ("hour", 22, None): 3, ("hour", 9, None): 1, ("hour", 23, None): 5, ("stop", None, "a"): 2, ("stop", None, "b"): 1}
    assert pages.regularity_scopes(hw.limit(0)).count() == 0


def test_route_stops(spark):
    stops = spark.createDataFrame([("1", 0, s) for s in "abcd"], "line string, direction_id int, stop_id string")
    off = spark.createDataFrame([("1", 0, "a", 0.0, 10), ("1", 0, "b", 100.0, 6), ("1", 0, "b", 20.0, 2), ("1", 0, "c", 50.0, 4), ("1", 0, "z", 1.0, 90)], "line string, direction_id int, stop_id string, off_s double, days long")
    got = [(r.stop_id, r.off_s, r.days, r.place) for r in pages.route_stops(stops, off).orderBy("place").collect()]
    assert got == [("a", 0.0, 10, 1), ("b", 80.0, 8, 2)]


def test_windows_months_and_lines(spark):
    d = lambda text: dt.date.fromisoformat(text)
    months = spark.createDataFrame([(d("2024-01-01"),), (d("2024-02-01"),), (d("2024-03-01"),)], "month date")
    seen = spark.createDataFrame([(d("2024-01-02"),), (d("2024-03-30"),)], "date date")
    assert tuple(pages.default_window(months, seen).first()) == (d("2024-02-01"), d("2024-02-29"))
    assert tuple(pages.default_window(months.limit(0), seen).first()) == (None, None)
    days = spark.sql("select explode(sequence(date'2024-01-30', date'2024-03-02')) as date")
    got = [tuple(r) for r in pages.month_days(days, d("2024-01-01"), d("2024-03-01")).orderBy("month").collect()]
    assert got == [(d("2024-01-01"), 2, 2, 31, False), (d("2024-02-01"), 21, 29, 29, True), (d("2024-03-01"), 1, 1, 31, False)]
    routes = spark.createDataFrame([("1", "bus", 1), ("1", "tram", 2), ("T7", "bus", 1)], "line string, mode string, since int")
    assert {tuple(r) for r in pages.newest_lines(routes).collect()} == {("1", "tram", 2, False), ("T7", "bus", 1, True)}
    out = spark.createDataFrame([(d("2024-01-31"), "holiday"), (d("2024-02-03"), "holiday"), (d("2025-01-01"), "holiday")], "date date, reason string")
    assert [tuple(r) for r in pages.excluded_days(out, days).collect()] == [("holiday", 1)]


def test_ranked_lists(spark):
    x = spark.createDataFrame([("1", "k", 3600.0, 10.0, None), ("2", "k", 3600.0, 20.0, None), ("1", "m", 100.0, 1.0, "holding"), ("1", "n", -5.0, 1.0, None), ("1", "o", -5.0, 1.0, "terminus")], "line string, link_key string, veh_s_day double, passages_day double, reason string")
    got = {(r.list, r.rank, r.link_key): (r.veh_h_day, r.veh_h_year, r.s_per_passage, r.reasons) for r in pages.ranked_lists(x, 261).collect()}
    assert got[("kept", 1, "k")] == (2.0, 522.0, 240.0, "")
    assert set(got) == {("kept", 1, "k"), ("flagged", 1, "m")} and got[("flagged", 1, "m")][3] == "holding"


def test_segment_excess_and_lengths(spark):
    cube = spark.createDataFrame([("k", 0, 8, 6), ("k", 0, 20, 1), ("k", 1, 8, 2), ("z", 0, 8, 9)], "link_key string, seg int, hour int, n long")
    passages = spark.createDataFrame([("k", 8, 2), ("k", 21, 1), ("z", 8, 3)], "link_key string, hour int, n long")
    got = {r.seg: (r.s_passage, r.ref_s, r.excess_s) for r in pages.segment_excess(cube, passages, (6, 20)).collect()}
    assert got == {0: (60.0, 20.0, 40.0), 1: (20.0, 0.0, 20.0)}
    links = spark.createDataFrame([("k", 100.0)], "link_key string, len_m double")
    fixes = spark.createDataFrame([("k", float(i)) for i in range(100) if i < 50 or i % 10 == 0], "link_key string, pos_m double")
    got = {r.length: (r.segments, r.fixes, r.sparse, r.recommended) for r in pages.segment_lengths(fixes, links, [10.0, 50.0, 100.0]).collect()}
    assert got == {10.0: (10, 5.5, 0.5, False), 50.0: (2, 27.5, 0.0, True), 100.0: (1, 55.0, 0.0, False)}


def test_period_differences(spark):
    sums = lambda r2: spark.createDataFrame([("a", 10.0, r2, 10.0, 100.0), ("b", 0.0, 0.0, 10.0, 100.0)], "stop_id string, r1 double, r2 double, s1 double, s2 double")
    assert [tuple(r) for r in pages.wait_change(sums(200.0), sums(300.0), ["stop_id"]).collect()] == [("a", 5.0, 10.0, 5.0)]
    daily = spark.sql("select 'k' as k, date_add(date'2024-01-01', cast(id as int)) as service_date, 100.0 + id % 3 as v, 10.0 as w from range(30)")
    lower = daily.withColumn("v", F.col("v") / 2)
    got = analysis.bootstrap_difference(daily, lower, ["k"], "v", "w", rounds=50).first()
    assert got.lo <= got.est <= got.hi and got.sure and abs(got.est - 5.05) < 1e-9
    assert not analysis.bootstrap_difference(daily, daily, ["k"], "v", "w", rounds=50).first().sure


def test_two_sided_and_line_order(spark):
    x = spark.createDataFrame([("a", 3.0), ("b", -1.0), ("c", 3.0), ("d", 0.0), ("e", -4.0), ("f", 1.0), ("g", None)], "link_key string, dv double")
    got = {(r.side, r.rank): r.link_key for r in pages.two_sided(x, "dv", 2).collect()}
    assert got == {("up", 1): "a", ("up", 2): "c", ("down", 1): "e", ("down", 2): "b"}
    lines = spark.createDataFrame([("10",), ("9",), ("T7",), ("1",)], "line string")
    assert [r.line for r in pages.in_line_order(lines).orderBy("place").collect()] == ["1", "9", "10", "T7"]


def test_stretches_of_very_many_links_in_few_lines(spark):
    rows = spark.range(6000).selectExpr("id AS link_key", "'A' AS from_name", "'B' AS to_name", "double(id) AS cost", "transform(array(4.30D, 4.31D, 4.32D), x -> array(x, 50.0D + (id % 3) * 0.00002D + IF(id % 3 = 2, 1, 0))) AS geometry")
    more = spark.createDataFrame([(9001, "A", "B", 1e9, [[4.3, 50.0]]), (9002, "A", "B", 1e9, None)], "link_key long, from_name string, to_name string, cost double, geometry array<array<double>>")
    got = stretches.merge(rows.unionByName(more))
    assert {(r.link_key if r.link_key > 9000 else r.link_key % 3, r.stretch) for r in got.collect()} == {(0, 5998), (1, 5998), (2, 5999), (9001, 9001), (9002, 9002)}


def test_stretches_are_those_of_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(4)
    rows = []
    for k in range(60):
        x, y = 4.3 + rng.choice([0, 0.002, 0.02]), rng.choice([50.0, 70.0]) + rng.randint(0, 8) * 0.00012
        rows.append((k, "A", "B", float(rng.randint(0, 9)), [[x, y], [x + rng.choice([0.004, 0.01]), y + rng.choice([0, 0.0002])]]))
    line, cost = {r[0]: r[4] for r in rows}, {r[0]: r[3] for r in rows}
    group = {k: k for k in line}
    for a, b in itertools.combinations(sorted(line), 2):
        if stretches.overlap(line[a], line[b]) >= 0.8:
            old = group[b]
            group = {k: group[a] if g == old else g for k, g in group.items()}
    want = {k: min((m for m in line if group[m] == g), key=lambda m: (-cost[m], m)) for k, g in group.items()}
    assert 5 < len(set(want.values())) < 55
    df = spark.createDataFrame(rows, "link_key long, from_name string, to_name string, cost double, geometry array<array<double>>")
    assert {r.link_key: r.stretch for r in stretches.merge(df).collect()} == want


def test_of_routes_that_began_on_one_day_the_greatest_lasted(spark):
    for order in ("ABC", "CBA", "BCA"):
        own = {"A": ("k", "A", 9, 20, 30), "B": ("k", "B", 9, 20, 29), "C": ("k", "C", 9, 1, 10)}
        back = spark.createDataFrame([own[x] for x in order] + [("k", "R", 5, 31, 40)], "k string, stops string, n_days int, first int, last int").coalesce(1)
        ref = spark.createDataFrame([("k", "R")], "k string, stops string")
        assert [tuple(r) for r in routes.lasting_change(back, ref, ["k"]).collect()] == [("k", "B", 29, 31)]


def test_route_changes_of_many_routes_without_any_frame_a_row(spark, monkeypatch):
    import pandas as pd

    def never(*_, **__):
        raise AssertionError("a pandas object a route")

    monkeypatch.setattr(pd, "Series", never)
    names = ["A", "B", "C", "D", "E"]
    assert routes.track_changes([300.0] * 4, [600.0, 300.0, 500.0, 110.0], names) == [("detour", "A", "B", 300, None), ("moved_stop", "C", "E", 200, "D")]
    assert routes.track_changes([], [], ["A"]) == []
    df = spark.range(4000).selectExpr("id", "array(300D, 300D) AS ref", "array(300D, 300D + IF(id % 2 = 0, 400, 0)) AS own", "array('A', 'B', 'C') AS names")
    got = routes.route_changes(df, ["id"]).collect()
    assert {tuple(r)[1:] for r in got} == {("detour", "B", "C", 400, None)} and sorted(r.id for r in got) == list(range(0, 4000, 2))


def test_departures_of_one_time_go_by_the_tie_not_by_the_rows_order(spark):
    rows = [(i, "t", 5 + (i > 1), link, 1, False) for i, link in enumerate([1, 2, 3, 9])]
    for given in (rows, rows[::-1], rows[2:] + rows[:2]):
        x = spark.createDataFrame(given, "event_id int, track_id string, ts long, link_idx int, pattern_uid int, at_stop boolean").coalesce(1)
        assert sorted(r.event_id for r in zones.departures(x, tie=["event_id"]).collect()) == [0, 1, 2]


def test_path_length_of_points_of_one_time_goes_by_the_tie(spark):
    rows = [("s", 1, 1, 0.0, 0.0), ("s", 1, 2, 3.0, 4.0), ("s", 1, 3, 3.0, 0.0), ("s", 2, 4, 3.0, 1.0)]
    for given in (rows, rows[::-1], rows[2:] + rows[:2]):
        p = spark.createDataFrame(given, "shape_id string, t long, event_id int, lon double, lat double").coalesce(1)
        assert timetable.path_length(p, ["shape_id"], ["t", "event_id"], "lon", "lat", spherical=False).first().km == 10.0
