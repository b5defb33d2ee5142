"""Interval queries over all rows, against brute force."""

import datetime as dt
import random
from collections import Counter

import pytest

from transitmill import catalog


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    rng = random.Random(3)
    at = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(40))
    orders = [(k, rng.randrange(150), at()) for k in range(1, 151)]
    lines = [(rng.randrange(150), rng.randrange(150), at()) for _ in range(400)]
    top = str(tmp_path_factory.mktemp("feed"))
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(f"{top}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_shipdate timestamp").write.parquet(f"{top}/lineitem.parquet")
    day = lambda t: (t - dt.datetime(1970, 1, 1)).days
    return top, [(k, c % 50, day(t), day(t) + c % 7) for k, c, t in orders], [(s % 50, day(t)) for _, s, t in lines]


def test_chosen_parts_of_every_order(spark, feed):
    top, iv, _ = feed
    inside = lambda a, b: b[1] == a[1] and b[0] != a[0] and b[2] <= a[2] and b[3] >= a[3] and (b[2] < a[2] or b[3] > a[3] or b[0] < a[0])
    want = Counter(a[1:] for a in iv if not any(inside(a, b) for b in iv))
    assert Counter(map(tuple, catalog.queries()["chosen_parts"](spark, top).collect())) == want


def test_uncovered_polls_of_every_row(spark, feed):
    top, iv, points = feed
    want = Counter((g, d) for g, d in points if not any(b[1] == g and b[2] <= d < b[3] for b in iv))
    assert {(r.g, r.day): r.n for r in catalog.queries()["uncovered_polls"](spark, top).collect()} == want
