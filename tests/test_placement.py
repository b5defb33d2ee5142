"""Placement and passages: every way to align a small track by brute force, and the rules on small networks."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitmill.operators import alignment, placement


def every_way(candidates, strict):
    """The best choice by its definition: most placed, then least span, then the earliest end, in all ways."""
    best = None
    for choice in itertools.product(*[[None, *range(len(c))] for c in candidates]):
        run = [candidates[k][j] for k, j in enumerate(choice) if j is not None]
        at = [p[1] for p in run]
        if any((b <= a) if strict else (b < a) for a, b in itertools.pairwise(at)):
            continue
        key = (len(run), -(run[-1][0] - run[0][0]) if run else 0, -at[-1] if at else 0)
        best = max(best, key) if best else key
    return best


@pytest.mark.parametrize("strict", [False, True])
def test_best_chain_is_the_best_of_all_ways(strict):
    rng = random.Random(11)
    for _ in range(400):
        n = rng.randint(1, 6)
        candidates = [sorted({(p, 10.0 * p + rng.choice([0, 3, 6])) for p in rng.sample(range(6), rng.randint(0, 3))}) for _ in range(n)]
        found = alignment.best_chain(candidates, strict)
        run = [candidates[k][j] for k, j in enumerate(found) if j is not None]
        assert all((a[1] < b[1]) if strict else (a[1] <= b[1]) for a, b in itertools.pairwise(run))
        assert (len(run), -(run[-1][0] - run[0][0]) if run else 0, -run[-1][1] if run else 0) == every_way(candidates, strict)


def test_long_tracks_take_little_time():
    rng = random.Random(3)
    found = alignment.best_chain([[(p, float(p)) for p in rng.sample(range(400), 3)] for _ in range(20_000)])
    assert sum(j is not None for j in found) > 400


@pytest.mark.parametrize("strict", [False, True])
def test_least_span_is_the_very_choice_of_best_chain(strict):
    rng = random.Random(5)
    whole = 0
    for _ in range(600):
        size = rng.choice([8, 40, 400])
        candidates = []
        for _ in range(rng.randint(1, 7)):
            places = sorted(rng.sample(range(size), rng.randint(1, size // 3)))
            candidates.append([(p, float(p) if strict else 10.0 * p + m) for p in places for m in [rng.choice([0, 4, 10])]])
        arrays = [np.array([x[0] for x in c]) for c in candidates], [np.array([x[1] for x in c]) for c in candidates]
        found, want = alignment.least_span(*arrays, strict), alignment.best_chain(candidates, strict)
        whole += found is not None
        assert found == (want if all(j is not None for j in want) else None)
        assert alignment.chosen(*arrays, strict) == want
    assert 100 < whole < 600


def long_chain(n):
    """Links of a pattern that stands at each of three stops n times."""
    return [("n", "p", i, "ABC"[i % 3], "ABC"[(i + 1) % 3], 10.0, f"{i}") for i in range(3 * n)], "net string, pat string, link_idx int, from_stop string, to_stop string, len_m double, link_key string"


def test_a_stop_of_very_many_places_for_each_fix_of_many_tracks(spark):
    links = spark.createDataFrame(*long_chain(10_000))
    fixes = spark.range(30_000).selectExpr("'p' AS pat", "id div 6 AS track", "id % 6 AS t", "substring('ACB', int(id % 3) + 1, 1) AS point", "double(id % 6) AS dist")
    out = placement.placed(fixes, links.drop("net", "link_key"), ["pat"], ["track"], [F.col("t")])
    got = out.groupBy("t", "link_idx", "s_m", "pos_m", "count").count().orderBy("t").collect()
    assert [tuple(r) for r in got] == [(t, i, 10.0 * i + t, float(t), t > 0, 5000) for t, i in enumerate([0, 2, 4, 6, 8, 10])]


def test_stop_events_at_a_stop_of_very_many_places(spark):
    links = spark.createDataFrame(*long_chain(10_000)).withColumnRenamed("pat", "pattern_uid")
    events = spark.range(20_000).selectExpr("'n' AS net", "id div 4 AS trip", "substring('ACCB', int(id % 4) + 1, 1) AS stop_id", "id % 4 AS t")
    got = placement.event_passages(events, links, ["net"], ["trip"], [F.col("t")]).collect()
    assert {(r["link_key"], r["n_events"]) for r in got} == {(str(i), 5000.0) for i in range(7)}


def test_track_passages_of_a_long_chain_and_both_sources(spark):
    links = spark.createDataFrame(*long_chain(10_000)).withColumnRenamed("pat", "pattern_uid")
    fixes = spark.range(20_000).selectExpr("'n' AS net", "'p' AS pattern_uid", "id div 4 AS trip", "id % 4 AS t", "substring('ACCB', int(id % 4) + 1, 1) AS stop_id", "1D AS dist")
    on = placement.placed(fixes, links.drop("net", "link_key"), ["pattern_uid"], ["trip"], [F.col("t")], point="stop_id").filter("count")
    feed = on.join(links.select("link_idx", "link_key"), "link_idx").groupBy("pattern_uid", "link_key").agg(F.countDistinct("trip").cast("double").alias("n_feed"))
    assert {tuple(r) for r in feed.collect()} == {("p", str(i), 5000.0) for i in (0, 2, 4)}
    seen = placement.event_passages(fixes.drop("pattern_uid"), links, ["net"], ["trip"], [F.col("t")])
    both = placement.merged_passages(feed, seen, ["link_key"])
    assert {tuple(r) for r in both.collect()} == {(str(i), "p", 5000.0 * (i in (0, 2, 4)), 5000.0, 5000.0) for i in range(7)}


def test_fixes_without_a_chain_keep_their_rows(spark):
    links = spark.createDataFrame(LINKS, LINK)
    fixes = spark.createDataFrame([(None, "t", 1, "A", 5.0), ("x", "t", 2, "A", 5.0), ("p", None, 3, "A", 5.0), ("p", "t", None, "B", 1.0)], "pat string, track string, t int, point string, dist double")
    out = placement.placed(fixes, links, ["pat"], ["track"], [F.col("t")])
    assert sorted((r["pat"] or "", r["t"] or 0, r["link_idx"], r["count"]) for r in out.collect()) == [("", 1, None, False), ("p", 0, 1, True), ("p", 3, 0, True), ("x", 2, None, False)]


LINKS = [("p", 0, "A", "B", 100.0), ("p", 1, "B", "C", 200.0), ("p", 2, "C", "B", 300.0), ("p", 3, "B", "D", 400.0)]
LINK = "pat string, link_idx int, from_stop string, to_stop string, len_m double"


def test_skipped_repeated_unknown_and_backward_points(spark):
    links = spark.createDataFrame(LINKS, LINK)
    rows = [
        # the second visit of B, as C was seen before; X isn't in the pattern; A comes too late and is left out
        ("t", 1, "A", 0.0), ("t", 2, "A", 60.0), ("t", 3, "C", 30.0), ("t", 4, "B", 50.0), ("t", 5, "X", 1.0), ("t", 6, "A", 5.0), ("t", 7, "B", 900.0), ("t", 8, "D", 0.0),
        # the first visit, as C follows; a null distance is none
        ("u", 1, "B", 10.0), ("u", 2, "B", None), ("u", 3, "C", 20.0), ("v", 1, None, 3.0),
    ]
    fixes = spark.createDataFrame([("p", *r) for r in rows], "pat string, track string, t int, point string, dist double").repartition(4)
    out = placement.placed(fixes, links, ["pat"], ["track"], [F.col("t")])
    got = {(r["track"], r["t"]): (r["link_idx"], r["pos_m"], r["s_m"], r["count"]) for r in out.collect()}
    assert got["t", 1] == (0, 0.0, 0.0, False)
    assert got["t", 2] == (0, 60.0, 60.0, True)
    assert got["t", 3] == (2, 30.0, 330.0, True)
    assert got["t", 4] == (3, 50.0, 650.0, True)
    assert got["t", 5] == got["t", 6] == got["v", 1] == (None, None, None, False)
    assert got["t", 7] == (3, 400.0, 1000.0, True)
    assert got["t", 8] == (4, 0.0, 1000.0, False)
    assert {k: v[0] for k, v in got.items() if k[0] == "u"} == {("u", 1): 1, ("u", 2): None, ("u", 3): 2}
    assert len(got) == len(rows)
    assert placement.placed(fixes.limit(0), links, ["pat"], ["track"], [F.col("t")]).count() == 0


def test_learned_lengths_scale_and_need_rows(spark):
    links = spark.createDataFrame(LINKS, LINK)
    fixes = spark.createDataFrame([("p", "t", k, "A", 50.0) for k in range(25)] + [("p", "t", 99, "C", 10.0)], "pat string, track string, t int, point string, dist double")
    learned = placement.learned_lengths(fixes, placement.chain(links, ["pat"]), ["pat"])
    assert [tuple(r) for r in learned.collect()] == [("p", 0, 50.0, 25)]
    out = placement.placed(fixes, links, ["pat"], ["track"], [F.col("t")], learned)
    assert {(r["point"], r["pos_m"]) for r in out.collect()} == {("A", 100.0), ("C", 10.0)}


def test_an_alias_is_the_terminus_that_holds_a_codes_points(spark):
    stops = spark.createDataFrame([("l", p, s, e) for p, e, x in (("p", "D", "ABCD"), ("q", "Z", "XYZ")) for s in x], "line string, pattern_uid string, stop_id string, terminus string")
    rows = [("l", "D", "A")] + [("l", "8", s) for s in "ABCABX"] + [("l", "9", s) for s in "XYAB"] + [("l", None, "A"), ("l", "7", None)]
    fixes = spark.createDataFrame(rows, "line string, terminus string, point string")
    known = placement.terminus_aliases(fixes, stops, ["line"])
    assert [tuple(r) for r in known.collect()] == [("l", "8", "D")]
    assert sorted((r["terminus"] or "", r["point"] or "") for r in placement.with_terminus(fixes, known, ["line"]).collect()) == sorted(("D" if t == "8" else t or "", p or "") for _, t, p in rows)


def test_event_passages_cover_skipped_stops_and_choose_a_pattern(spark):
    links = spark.createDataFrame([("n", *r, f"{r[2]}>{r[3]}") for r in LINKS] + [("n", "q", 0, "A", "C", 250.0, "A>C"), ("n", "q", 1, "C", "E", 100.0, "C>E")], "net string, pattern_uid string, link_idx int, from_stop string, to_stop string, len_m double, link_key string")
    rows = [("n", "1", "A", 0), ("n", "1", "A", 10), ("n", "1", "C", 7000), ("n", "1", "B", 7300), ("n", "2", "A", 3500), ("n", "2", "C", 3600), ("n", "2", "E", 3700), ("n", "3", "B", 0)]
    events = spark.createDataFrame(rows, "net string, trip string, stop_id string, t bigint")
    got = sorted((r["pattern_uid"], r["link_key"], str(r["service_date"]), r["hour"], r["n_events"]) for r in placement.event_passages(events, links, ["net"], ["trip"], [F.col("t")]).collect())
    # trip 1 enters B>C a third of the way to C; trip 2 fits q by one stop more
    assert got == [("p", "A>B", "1970-01-01", 0, 1.0), ("p", "B>C", "1970-01-01", 0, 1.0), ("p", "C>B", "1970-01-01", 1, 1.0), ("q", "A>C", "1970-01-01", 0, 1.0), ("q", "C>E", "1970-01-01", 1, 1.0)]
    feed = spark.createDataFrame([(0, "A>B", "p", 3.0), (0, "A>B", "r", 1.0), (5, "Y>Z", "p", 2.0)], "hour int, link_key string, pattern_uid string, n_feed double")
    both = placement.merged_passages(feed, placement.event_passages(events, links, ["net"], ["trip"], [F.col("t")]), ["hour", "link_key"])
    assert sorted(tuple(r) for r in both.collect()) == [(0, "A>B", "p", 4.0, 1.0, 4.0), (0, "A>C", "q", 0.0, 1.0, 1.0), (0, "B>C", "p", 0.0, 1.0, 1.0), (1, "C>B", "p", 0.0, 1.0, 1.0), (1, "C>E", "q", 0.0, 1.0, 1.0), (5, "Y>Z", "p", 2.0, 0.0, 2.0)]
