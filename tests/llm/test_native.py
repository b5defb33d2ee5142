"""The native operators against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from transitmill.llm import bottomk, lines, mixing, rules, shards

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, _tie string, row string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z") for i, t, s in rows], SCHEMA).repartition(3)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocab = ["un", "deux", "trés", "bü", "漢", "d,", "e#", "&f", "go"]
    out = []
    for i in range(n):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        out.append((i * 3, "\n".join(parts), rng.choice(["a", "b", "c", None])))
    long = " ".join(rng.choice(vocab) for _ in range(30_000))
    return [*out, (1, None, "a"), (2, "", "b"), (4, " \t\n\x0b\x0c\r", "c"), (5, long, "a"), (7, out[0][1], "b"), (8, out[0][1], "b"), (8, out[0][1], "b"), (None, "null id", "b"), (None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards_are_contiguous_balanced_and_gapless(docs, rows):
    got = shards.balanced_shards(docs, 4).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [(-1 if r.doc_id is None else r.doc_id) for r in ordered]
    assert ids == sorted(ids)
    for s in range(4):
        slots = [r.slot for r in ordered if r.shard == s]
        assert slots == list(range(len(slots)))
    total, before = sum(r["size"] for r in got), 0
    for r in ordered:
        assert r.shard == (2 * before + r["size"]) * 4 // (2 * total)
        before += r["size"]


def test_shards_of_nothing(empty):
    assert shards.balanced_shards(empty).count() == 0


def fill(sizes, weights, cap):
    """Targets by sharing the excess again and again."""
    total, out, open_ = sum(sizes.values()), {}, dict(weights)
    left = total
    while open_:
        w = sum(open_.values())
        over = {s for s in open_ if left * open_[s] / w > cap * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * open_[s] / w for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def test_mix_meets_targets(docs, rows):
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    taken = defaultdict(int)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(WORDS.findall(t or ""))) for i, t, _ in rows)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
    for s in sizes:
        assert taken[s] == round(want[s])
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_mix_repeats_epochs_and_caps(spark):
    docs = table(spark, [(1, "a b c d", "s1"), (2, "e f", "s2"), (3, " ".join(["w"] * 94), "s3"), (4, "", "s4")])
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert got[1].target == 12 and got[1].taken == 12
    assert got[2].target == 6 and got[2].taken == 6
    assert got[3].taken == 82 and got[4].taken == 0


def test_mix_of_nothing(empty, spark):
    assert mixing.mix(empty).count() == 0
    assert [r.taken for r in mixing.mix(table(spark, [(1, None, "a"), (2, " ", "b")])).collect()] == [0, 0]


def test_widespread_lines_stay_once(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        own = [f"own line {i} {rng.random()}", "All rights reserved." if i % 2 else f"x{i}", "  nine sites " if i % 10 != 9 and i < 60 else "", ""]
        rows.append((i, "\n".join(own), f"site{i % 20}" if i < 100 else None))
    rows += [(200, None, "site1"), (201, "", "site2"), (100, "another text under a known id", "site3")]
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if x := x.strip(" \t\x0b\x0c\r"):
                first[x] = min(first.get(x, i), i)
                if s is not None:
                    sites[x].add(s)
    want = {}
    for i, t, _ in rows:
        keep = None if t is None else [x for x in t.split("\n") if not (len(sites[y := x.strip(" \t\x0b\x0c\r")]) >= 9 and y and first[y] != i)]
        want[(i, t)] = None if t is None else "\n".join(keep)
    got = lines.without_boilerplate(table(spark, rows), min_sites=9).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.clean == want[(r.row.doc_id, r.row.text)]
        assert r.row["size"] == "x"
    assert sum(r.n_removed for r in got) > 50


def test_lines_on_either_side_of_the_threshold(spark):
    """Lines on 1 to 30 sites with a threshold of 12: sure ones by the sketch, near ones by an exact count."""
    rows = [(100 * n + k, f"line on {n} sites\nown {n} {k}\neverywhere", f"site{k % n}") for n in range(1, 31) for k in range(40)]
    rng = random.Random(1)
    rng.shuffle(rows)
    got = {r.row.doc_id: r.n_removed for r in lines.without_boilerplate(table(spark, rows), min_sites=12).collect()}
    for n in range(1, 31):
        for k in range(40):
            assert got[100 * n + k] == (n >= 12 and k > 0) + (100 * n + k != 100)


def test_hot_lines_join_as_the_others_do(spark):
    rows = [(i, "hot line\n" * 3 + f"own {i}", f"s{i % 15}") for i in range(3000)]
    got = lines.without_boilerplate(table(spark, rows)).collect()
    assert sum(r.n_removed for r in got) == 2999 * 3 and all(r.clean == f"own {r.row.doc_id}" for r in got if r.row.doc_id)


def test_lines_of_nothing(empty):
    assert lines.without_boilerplate(empty).count() == 0


def shingles(text, width=5):
    ws = WORDS.findall(text)
    return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else ({tuple(ws)} if ws else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints_against_exact_sets(docs, rows):
    got = bottomk.edited_fingerprints(docs, k=100_000).collect()
    assert len(got) == len(rows)
    key = lambda r: (-1 if r[0] is None else r[0])
    by_id = defaultdict(list)
    for r in rows:
        by_id[key(r)].append(r[1] or "")
    order = sorted(by_id)
    for r in got:
        i = -1 if r["_id"] is None else r["_id"]
        later = by_id[order[(order.index(i) + 1) % len(order)]] + (by_id[i] if len(by_id[i]) > 1 else [])
        n = len(r["_text"])
        fits = [t for t in later if r["_edited"] == r["_text"][: n - n // 2] + t[: n // 2]]
        assert fits
        assert r.near_edited == pytest.approx(jaccard(shingles(r["_text"]), shingles(r["_edited"])))
        assert any(r.near_next == pytest.approx(jaccard(shingles(r["_text"]), shingles(t))) for t in fits)


@pytest.mark.parametrize("parts", [1, 2, 40])
def test_null_and_equal_ids_are_split_over_ranges(spark, parts):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " * (1 + i % 5), "a") for i in range(300)]
    held = bottomk.beside_next(table(spark, rows), parts=parts)
    got = held.select("_bucket", "_id", "_tie", "_tail", F.spark_partition_id().alias("p")).collect()
    own = sorted(((r["_id"] is not None, r["_id"] or 0, r["_tie"]), r["_bucket"]) for r in got if not r["_tail"])
    assert len(own) == 300 and [b for _, b in own] == sorted(b for _, b in own)
    assert len({b for _, b in own}) == parts and max(Counter(b for _, b in own).values()) <= 3 * 300 / parts
    # one partition a range, and each range ends with the first row of the next one
    assert len({(r.p, r["_bucket"]) for r in got}) == len({r.p for r in got}) == parts
    firsts = {}
    for key, b in own:
        firsts.setdefault(b, key)
    assert sorted(((r["_id"] is not None, r["_id"] or 0, r["_tie"]), r["_bucket"]) for r in got if r["_tail"]) == sorted((firsts[(b + 1) % parts], b) for b in firsts)


def test_sketches_estimate(spark):
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(6000)]
    a, b = " ".join(base[:4000]), " ".join(base[1000:6000])
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = bottomk.with_sketch(bottomk.with_sketch(df, F.col("a"), "sa"), F.col("b"), "sb")
    r = df.select(bottomk.resemblance(F.col("sa"), F.col("sb")).alias("j"), bottomk.containment(F.col("sa"), F.col("sb")).alias("c"), bottomk.distinct_shingles(F.col("sa")).alias("n"), F.size("sa").alias("k")).first()
    assert abs(r.j - 0.5) < 0.12 and abs(r.c - 0.75) < 0.15 and abs(r.n / 4000 - 1) < 0.25 and r.k == bottomk.K


def test_merged_groups_equal_the_sketch_of_all_parts(spark):
    parts = [("g", "a b c d e f g"), ("g", "c d e f g h i"), ("g", "a b c d e f g"), ("h", "q r s t u")]
    df = bottomk.with_sketch(spark.createDataFrame(parts, "g string, t string"), F.col("t"), "s", k=3)
    got = {r.g: r.s for r in bottomk.merge_groups(df, ["g"], "s", k=3).collect()}
    one = bottomk.with_sketch(spark.createDataFrame(parts, "g string, t string"), F.col("t"), "s", k=1000).collect()
    for g in "gh":
        assert got[g] == sorted({h for r in one if r.g == g for h in r.s})[:3]


def test_fingerprints_of_nothing(empty):
    assert bottomk.edited_fingerprints(empty).count() == 0


def measures(text):
    ws = WORDS.findall(text)
    at = defaultdict(list)
    for i in range(len(ws) - 2):
        at[tuple(ws[i : i + 3])].append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORDS.search(x):
            dup += x in seen
            seen.add(x)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_against_brute_force(docs, rows):
    got = rules.judged(docs, sample_rows=20).collect()
    want = Counter((i, *measures(t or "")) for i, t, _ in rows)
    assert Counter((r.row.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        if r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words:
            assert r.failed_rule is not None


def test_cascade_order_never_changes_the_verdict(docs):
    std = rules.standard_rules()
    verdicts = []
    for base in (rules.BASE, ()):
        m = rules.opened(docs, base=base)
        verdicts += [sorted((str(r.row), r.f is None) for r in rules.cascade(m, order, "f").collect()) for order in (std, std[::-1])]
    assert all(v == verdicts[0] for v in verdicts)


def test_rules_prefer_rejection_per_cost(docs):
    m = rules.opened(docs).cache()
    m.count()
    ordered = rules.order_rules(m, rules.standard_rules())
    rates = [share / seconds for _, seconds, share in ordered]
    assert rates == sorted(rates, reverse=True)


@pytest.mark.parametrize("bits", [0, 2, 6, 64])
def test_windows_that_share_a_hash_are_told_apart(docs, rows, bits):
    got = rules.opened(docs.filter("n_chars < 5000")).select("row.doc_id", rules.n_repeat_words(F.col("words"), bits).alias("n")).collect()
    assert Counter(map(tuple, got)) == Counter((i, measures(t or "")[4]) for i, t, _ in rows if len(t or "") < 5000)


def test_the_sample_of_rules_comes_from_all_over(spark):
    docs = spark.range(0, 4000, 1, 4).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    got = sorted(int(r.words[1]) for r in rules.sampled(docs, rows=400).collect())
    assert 300 < len(got) < 500 and got[0] < 200 and got[-1] > 3800 and 150 < sum(x < 2000 for x in got) < 250


def test_rules_of_nothing(empty):
    assert rules.judged(empty).count() == 0
