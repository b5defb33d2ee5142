"""Hotspots against plain sums over the same draws of days."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from transitmill.operators import analysis

DAYS = [dt.date(2025, 3, 1) + dt.timedelta(i) for i in range(20)]


def test_runs_and_intervals_are_those_of_the_draws(spark):
    rng = random.Random(5)
    rows = []
    for line in "ab":
        for place in range(14):
            slow = 9.0 if place in (2, 3, 4, 9, 13) else 0.3
            for d in DAYS:
                if rng.random() < 0.9:
                    rows.append((line, place, d, slow * 10 + rng.gauss(0, 20), 10.0))
    rows += [("a", 5, DAYS[0], 50.0, 0.0), ("a", 20, DAYS[0], 50.0, 0.0), ("c", 1, DAYS[0], None, None)]
    daily = spark.createDataFrame(rows, "line string, place int, service_date date, value double, weight double").repartition(4)
    rounds = 60
    # how often each day counts in each round: the Poisson count of mean 1 at a hash of seed, round and day
    days = spark.createDataFrame([(d,) for d in DAYS], "service_date date").withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    at = days.select("service_date", "_b", (F.pmod(F.xxhash64(F.lit(1), "_b", "service_date"), F.lit(1 << 30)) / float(1 << 30)).alias("u")).collect()
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    counts = {(r.service_date, r._b): int((r.u >= upto).sum()) for r in at}

    def ratio_of(line, place, weigh):
        own = [(v, w, d) for x, p, d, v, w in rows if (x, p) == (line, place) and v is not None]
        v, w = sum(v * weigh(d) for v, _, d in own), sum(w * weigh(d) for _, w, d in own)
        return v / w if w else None

    want = []
    for line in "ab":
        each = {p: [ratio_of(line, p, lambda d, b=b: counts[d, b]) for b in range(1, rounds + 1)] for p in (*range(14), 20)}
        low = lambda x: np.percentile([y for y in x if y is not None], 5) if any(y is not None for y in x) else None
        hot = [p for p in each if (q := low(each[p])) is not None and q > 0.5]
        runs = []
        for p in hot:
            runs = [*runs[:-1], [*runs[-1], p]] if runs and runs[-1][-1] == p - 1 else [*runs, [p]]
        for run in runs:
            sums = [sum(each[p][b] or 0 for p in run) for b in range(rounds)]
            est = sum(ratio_of(line, p, lambda d: 1) for p in run)
            want.append((line, run[0], run[-1], len(run), round(est, 6), round(np.percentile(sums, 5), 6), round(np.percentile(sums, 95), 6)))
    got = analysis.hotspots(daily, ["line"], "place", "value", "weight", rounds, least=0.5)
    assert sorted((r.line, r.first, r.last, r.n, round(r.est, 6), round(r.lo, 6), round(r.hi, 6)) for r in got.collect()) == sorted(want)
    assert {(2, 4), (9, 9), (13, 13)} <= {x[1:3] for x in want}
    assert analysis.hotspots(daily.limit(0), ["line"], "place", "value", "weight").count() == 0
