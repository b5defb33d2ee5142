"""The audit of sources against plain counts, and its trie against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from transitmill.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, part string, k string, docs string"


def plain(rows, min_docs, top):
    found, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        own = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang].add(source)
        found[lang, source].update(own)
        seen[lang].update(set(own))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        size = lambda counts: sum(counts[x] for x in kept) + 5 * len(kept)
        share = lambda counts, n: {t: 1 + 1_000_000_000 * (counts[t] + 5) // n for t in kept}
        p = {s: share(found[lang, s], size(found[lang, s])) for s in sources}
        every = sum((found[lang, s] for s in sources), Counter())
        q = share(every, size(every))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if found[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def corpus(seed=4, n=400):
    rng = random.Random(seed)
    vocab = ["Haus", "haus", "HÄUSER", "häuser", "Ä", "a1b", "漢字", "漢", "x", "xy", "xyz", "xya", "don't", "\x00é", "𝔘", "￿", "e\xa0f"]
    rows = [(" ".join(rng.choice(vocab[: rng.randint(3, len(vocab))]) for _ in range(rng.randint(0, 30))), rng.choice(["de", "fr", None]), rng.choice(["s", "t", "ü", "", None])) for _ in range(n)]
    return [*rows, (None, "de", "none"), ("", "xx", "a"), (None, "xx", "b"), (None, None, None), ("only once", "yy", "z"), ("long Text " * 40_000, "de", "s"), ("x" * 2_500_000 + " end", "fr", "t"), rows[3], rows[3]]


def answers(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("min_docs", "top", "full"), [(30, 50, 150_000), (2, 3, 7), (1, 1000, 1)])
def test_equals_plain_counts(spark, monkeypatch, min_docs, top, full):
    monkeypatch.setattr(divergence, "FULL", full)
    monkeypatch.setattr(divergence, "PORTION", full * 20)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, s, "a", "b", "c", "d") for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(6)
    assert answers(divergence.divergence(docs, min_docs=min_docs, top=top)) == plain(rows, min_docs, top)


def test_nothing_and_no_kept_terms(spark):
    docs = spark.createDataFrame([("a b", "de", s) for s in "zyx"], "text string, lang string, source string")
    assert answers(divergence.divergence(docs.limit(0))) == []
    assert answers(divergence.divergence(docs)) == plain([tuple(r) for r in docs.collect()], 30, 50)
    assert all(r[4] == 0 for r in answers(divergence.divergence(docs)))


def test_shares_are_exact_for_large_counts():
    counts, total = np.array([0, 1, 10**12, 3 * 10**13], np.int64), 9 * 10**14 + 7
    assert divergence.shares(counts, total).tolist() == [1 + 1_000_000_000 * (c + 5) // total for c in counts.tolist()]


def test_trie_is_a_sorted_dictionary_and_merges():
    rng = random.Random(8)
    words = ["".join(rng.choice("abé漢") for _ in range(rng.randint(0, 6))).encode() for _ in range(3000)]
    halves = [divergence.RadixTrie(), divergence.RadixTrie()]
    want = defaultdict(Counter)
    for i, w in enumerate(words):
        halves[i % 2].add(w, [(i % 3, 1)])
        want[w][i % 3] += 1
    halves[0].merge(halves[1])
    assert [(t, dict(c)) for t, c in halves[0]] == [(t, dict(want[t])) for t in sorted(want)]
    assert halves[0].size == len(want)


def test_a_full_range_is_merged_in_portions(spark, monkeypatch):
    rows = [(" ".join(f"{a}{b}{c}" for c in "abcdefghijklmnopqrstuvwxyz"), "de", s) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for s in "uvv"]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = divergence.divergence(docs, min_docs=3, top=17_576 + 1)
    assert answers(got) == plain(rows, 3, 17_577)
