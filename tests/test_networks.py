"""Lasting link keys, pattern days and networks over several feeds, on small cases."""

import datetime as dt
import itertools
import math
import random

from pyspark.sql import functions as F

from transitmill.operators import networks

M = 1 / 110540.0
LINK = "feed int, from_stop string, to_stop string, geometry array<array<double>>"
D = dt.date(2025, 3, 1)


def bow(metres, flip=False):
    """A track of about a kilometre that bends away by some metres."""
    line = [[4.0, 50.0], [4.007, 50.0 + metres * M], [4.014, 50.0]]
    return line[::-1] if flip else line


def test_sampled_points_lie_at_equal_shares(spark):
    rng = random.Random(2)
    for line in ([[0.0, 0.0], [0.01, 0.0]], [[0.0, 0.0], [0.0, 0.0], [0.0, 0.01]], [[rng.random() / 100, rng.random() / 100] for _ in range(9)]):
        got = spark.createDataFrame([(line,)], "g array<array<double>>").select(networks.sampled(F.col("g"), 8).alias("s")).first().s
        metres = lambda a, b: math.hypot((a[0] - b[0]) * 111320.0 * math.cos(math.radians(a[1])), (a[1] - b[1]) * 110540.0)
        whole = sum(metres(a, b) for a, b in itertools.pairwise(line))
        for k, p in enumerate(got):
            left = whole * k / 8
            for a, b in itertools.pairwise(line):
                m = metres(a, b)
                if left <= m + 1e-9 and m > 0:
                    want = [a[i] + (b[i] - a[i]) * min(1, left / m) for i in range(2)]
                    break
                left -= m
            assert metres(want, (p.x, p.y)) < 0.01
    assert spark.createDataFrame([(None,), ([[1.0, 2.0]],)], "g array<array<double>>").select(F.size(networks.sampled(F.col("g"))).alias("n")).distinct().first().n == 0


def test_parallel_tracks_get_keys_that_last(spark):
    first = [(1, "A", "B", bow(0)), (1, "A", "B", bow(0)), (1, "A", "B", bow(12)), (1, "A", "B", bow(200)), (1, "B", "A", bow(0, True)), (1, "C", "D", None)]
    second = [(2, "A", "B", bow(205)), (2, "A", "B", bow(205)), (2, "A", "B", bow(205)), (2, "A", "B", bow(8)), (2, "A", "B", bow(-300)), (2, "C", "D", bow(1)), (2, "E", "F", bow(3)), (2, "A", "B", None)]
    a, b = (spark.createDataFrame(x, LINK).repartition(3) for x in (first, second))
    registry = networks.lasting_variants(None, a)
    both = networks.lasting_variants(registry, b)

    def keys(links, held):
        return sorted(((r.feed, r.link_key, r.geometry and round(r.geometry[1][1] / M - 50 / M)) for r in networks.with_keys(links, held).collect()), key=str)

    want = [(1, "A>B~0", 0), (1, "A>B~0", 0), (1, "A>B~0", 12), (1, "A>B~1", 200), (1, "B>A~0", 0), (1, "C>D~0", None)]
    assert sorted(map(str, keys(a, registry))) == sorted(map(str, want)) == sorted(map(str, keys(a, both)))
    assert [k for _, k, m in keys(b, both) if m in (205, 8, -300)] and {(m, k) for _, k, m in sorted(keys(b, both), key=str)} == {(205, "A>B~1"), (8, "A>B~0"), (-300, "A>B~2"), (1, "C>D~0"), (3, "E>F~0"), (None, "A>B~0")}
    # a third feed of what is known adds nothing, and the numbers stay
    again = networks.lasting_variants(both, a.union(b))
    rows = lambda df: sorted((r.from_stop, r.to_stop, r.variant, len(r.track)) for r in df.collect())
    assert rows(again) == rows(both)
    assert rows(networks.lasting_variants(registry, b.limit(0))) == rows(registry)


def test_network_of_dates_from_two_feeds(spark):
    days = lambda n, *at: [D + dt.timedelta(i) for i in (at or range(n))]
    frame = spark.createDataFrame
    feeds = {
        "pattern_days": frame([("x", "5", p, d, 3, True) for p in ("p", "q") for d in days(3)] + [("y", "5", "q", d, 9, True) for d in days(6)] + [("y", "7", "r", D, 1, True)], "sha string, line string, pattern_uid string, service_date date, n_trips int, is_main boolean"),
        "patterns": frame([("x", "5", "p", 1), ("x", "5", "q", 1), ("y", "5", "q", 2), ("y", "7", "r", 2)], "sha string, line string, pattern_uid string, v int"),
        "links": frame([("x", "5", "q", 0, 100.0), ("y", "5", "q", 0, 200.0), ("y", "5", "q", 1, 300.0), ("y", "7", "r", 0, 1.0)], "sha string, line string, pattern_uid string, link_idx int, len_m double"),
        "stops": frame([("x", "5", "s", "old"), ("y", "5", "s", "new"), ("y", "5", "t", "new")], "sha string, line string, stop_id string, name string"),
    }
    cands = frame([(d, s, r) for d in days(6) for r, s in enumerate("xy")], "service_date date, sha string, rank int")
    net = networks.network(feeds, cands, frame([(d,) for d in days(6)], "service_date date"))
    # x comes first where it runs the line, until its last day
    assert sorted((r.line, r.pattern_uid, r.service_date, r.n_trips) for r in net["pattern_days"].collect()) == sorted([("5", p, d, 3) for p in "pq" for d in days(3)] + [("5", "q", d, 9) for d in days(0, 3, 4, 5)] + [("7", "r", D, 1)])
    assert sorted(map(tuple, net["patterns"].collect())) == [("5", "p", 1), ("5", "q", 1), ("7", "r", 2)]
    assert sorted(map(tuple, net["links"].collect())) == [("5", "q", 0, 100.0), ("5", "q", 1, 300.0), ("7", "r", 0, 1.0)]
    assert sorted(map(tuple, net["stops"].collect())) == [("5", "s", "old"), ("5", "t", "new")]
    assert sorted(map(tuple, net["missing"].collect())) == [("7", d) for d in days(6)[1:]]


def test_main_pattern_has_most_trips_then_stops_then_the_least_name(spark):
    trips = spark.createDataFrame([("5", "p", "wk", 4)] * 2 + [("5", "q", "wk", 6)] * 2 + [("5", "r", "we", 2), ("5", "s", "we", 2), ("5", "t", "no", 2)], "line string, pattern_uid string, service_id string, n_stops int")
    days = spark.createDataFrame([("wk", D), ("wk", D), ("we", D + dt.timedelta(1))], "service_id string, service_date date")
    got = sorted((r.pattern_uid, r.n_trips, r.is_main) for r in networks.pattern_days(trips, days, ["line"]).collect())
    assert got == [("p", 2, False), ("q", 2, True), ("r", 1, True), ("s", 1, False)]
