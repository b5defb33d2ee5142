"""The pipeline's near copies against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from transitmill.llm import copies

SYLLABLES = ["ka", "lo", "mi", "tu", "re", "so", "ne", "pa"]


def jaccard(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.lower().split(), y.lower().split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("small", [copies.SMALL, 1])
def test_edited_copies(spark, small):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(3))
    passage = [word() for _ in range(30)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two"), (None, "no id here"), (None, "no id here")]
    for k in range(40):
        base = [word() for _ in range(rng.choice([5, 12, 60, 150]))] + (passage if k % 4 == 0 else [])
        for c in range(rng.choice([1, 2, 3, 6])):
            own = list(base)
            for _ in range(rng.randrange(4) if c else 0):
                own[rng.randrange(len(own))] = word()
            rows.append((100 + 10 * k + c, " ".join(own + ([word() for _ in range(rng.randrange(9))] if c else []))))
    # a chain: each like the next, the first not like the last; the least id isn't at an end
    chain = [word() for _ in range(100)]
    rows += [(1000 + (i + 3) % 7, " ".join(chain[6 * i : 6 * i + 64])) for i in range(7)]
    rows.append(rows[-1])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            x, y = rows[i][1] or "", rows[j][1] or ""
            if (not x.split() and not y.split()) or (x.split() and y.split() and jaccard(x, y) >= 0.8):
                linked += x != y
                root[find(i)] = find(j)
    assert linked > 40
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    want = Counter(min((-1 if x is None else x) for x in g) for g in groups.values())
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = copies.one_of_each(docs, small=small).collect()
    assert Counter(-1 if r.doc_id is None else r.doc_id for r in got) == want
    assert sum(1000 <= r.doc_id < 1007 for r in got if r.doc_id is not None) == 1


def test_bands_agree_as_the_similarity_says():
    rng = np.random.default_rng(4)
    odd, met, want, lost = copies.multipliers(), 0, 0, 0
    for s in (0.3, 0.6, 0.8, 0.9):
        for _ in range(60):
            n = int(rng.integers(20, 400))
            both = round(2 * n * s / (1 + s))
            x = rng.integers(0, 2**64, n, dtype=np.uint64)
            y = np.concatenate([x[:both], rng.integers(0, 2**64, n - both, dtype=np.uint64)])
            same = (copies.band_keys(x, odd) == copies.band_keys(np.sort(y), odd)).sum()
            exact = both / (2 * n - both)
            met, want = met + same, want + copies.BANDS * exact**copies.ROWS
            lost += exact >= 0.8 and not same
    assert not lost and abs(met / want - 1) < 0.1
    assert len(copies.band_keys(np.zeros(0, np.uint64), odd)) == 0


def test_a_large_group_around_one_text(spark):
    """Copies that are near the text they were made of, and not near each other, next to unlike texts that share a passage."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(4))
    base, passage = [word() for _ in range(200)], " ".join(word() for _ in range(40))
    rows = [(5000, " ".join(base))]
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(0, 200, 8), 4):
            own[at] = word()
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(150)]
    near = sum(jaccard(rows[i][1], rows[i + 1][1]) >= 0.8 for i in range(1, 150))
    assert near < 15 and all(jaccard(rows[0][1], t) >= 0.8 for _, t in rows[1:151])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(r.doc_id for r in copies.one_of_each(docs).collect())
    assert got == [0, *range(1000, 1150)]


def test_shared_tokens_keep_all_that_two_sets_share(spark):
    rng = random.Random(8)
    rows = [(i, 7, rng.sample(range(-400, 400), rng.randint(0, 30))) for i in range(80)]
    distinct = spark.createDataFrame(rows, "set_key bigint, n bigint, held array<bigint>")
    count = Counter(t for _, _, held in rows for t in held)
    for bits in (15, 20):
        got = Counter(map(tuple, copies.shared_tokens(distinct, bits).collect()))
        assert got == Counter((t, i, n) for i, n, held in rows for t in held if count[t] > 1)


def test_links_that_no_hub_has(spark):
    """A large bucket of unlike texts in which a few pairs, far from the hub, are near each other, and all are found."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(4))
    passage = [word() for _ in range(150)]
    rows = [(i, " ".join(passage + [word() for _ in range(70)])) for i in range(300)]
    for i in range(0, 300, 30):
        rows.append((1000 + i, rows[i][1] + " " + word()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert 0.4 < jaccard(rows[0][1], rows[1][1]) < 0.8
    for small in (copies.SMALL, 1):
        assert sorted(r.doc_id for r in copies.one_of_each(docs, small=small).collect()) == list(range(300))


def test_shareable_counts_what_no_other_set_has(spark):
    rng = random.Random(3)
    held = {i: rng.sample(range(120), rng.randint(0, 30)) for i in range(12)}
    sets = spark.createDataFrame([*held.items()], "set_key bigint, held array<bigint>")
    keys = spark.createDataFrame([(i,) for i in range(10)], "set_key bigint")
    count = Counter(x for i in range(10) for x in held[i])
    want = {i: n for i in range(10) if (n := sum(count[x] == 1 for x in held[i]))}
    assert {r.set_key: r.u for r in copies.shareable(sets, keys).collect()} == want


def folders(spark):
    import os

    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {x for x in os.listdir(top) if x.startswith("rdd-")}


def test_the_stage_leaves_only_the_checkpoints_that_its_result_reads(spark):
    from transitmill.llm import common

    docs = spark.createDataFrame([(i, f"a few words of text number {i // 2} and no more") for i in range(40)], "doc_id bigint, text string")
    common.cut(docs.limit(1))
    before = folders(spark)
    out = copies.one_of_each(docs)
    assert 1 <= len(folders(spark) - before) <= 4 and before <= folders(spark)
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 40, 2)) == sorted(r.doc_id for r in out.collect())


def test_calls_at_once_keep_each_others_checkpoints(spark):
    from concurrent.futures import ThreadPoolExecutor

    from transitmill.llm import common

    docs = spark.createDataFrame([(i, f"a few words of text number {i // 2} and no more") for i in range(40)], "doc_id bigint, text string")
    with ThreadPoolExecutor(3) as pool:
        runs = [pool.submit(lambda: sorted(r.doc_id for r in copies.one_of_each(docs).collect())) for _ in range(2)]
        cuts = [common.cut(docs.filter(f"doc_id % 7 = {k}")) for k in range(7)]
        assert [r.result() for r in runs] == [list(range(0, 40, 2))] * 2
    assert sum(c.count() for c in cuts) == 40


def test_a_set_that_many_are_compared_with_is_dealt_out(spark):
    from pyspark.sql import functions as F

    from transitmill.llm import common

    pairs = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("a"), F.col("id").alias("b"))
    small = spark.createDataFrame([(k, [k, k]) for k in [-1, *range(45)]], "a bigint, held array<bigint>")
    weights = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    out = common.salted_join(pairs, small, weights, "a", 30_000)
    assert sorted(map(tuple, out.select("a", "b").collect())) == sorted(map(tuple, pairs.filter("a < 45").collect()))
    assert out.filter("held[0] <> a").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "held" not in "".join(x for x in plan.split("\n") if "broadcast" in x)
