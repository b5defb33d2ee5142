"""Importance resampling against a plain computation over single words and strings."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from transitmill.llm import resample
from transitmill.llm.queries import op12_resample

SCHEMA = "doc_id bigint, text string, score string, weight string, _id string, _pos string, n_words string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, target, words=1, buckets=10_000, percent=10, least=20):
    def found(text):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return len(own), [" ".join(own[i : i + n]) for n in range(1, words + 1) for i in range(len(own) - n + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(at, found(text)[1]))
    for text in target:
        t.update(map(at, found(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text in rows:
        n, own = found(text)
        weight = sum(gain(at(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0], -x[2], x[1]))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return [tuple(x[:5]) for x in out]


def answers(frame):
    return [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in frame.collect()]


def corpus(seed=2, n=300):
    rng = random.Random(seed)
    vocab = ["Aber", "ÄRGER", "straße", "x1", "don't", "漢字", "a-b", "\x00z", "e\xa0f", "𝔘", "foo", "bar"]
    rows = [(k * 7, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 5, 19, 20, 40, 90])))) for k in range(n)]
    return [*rows, (None, None), (None, " ".join(["null", "id"] * 20)), (1, ""), (2, None), (3, "?! --"), (4, "word " * 30_000), (5, "x" * 3_000_000 + " tail" * 30), rows[9], rows[9]]


@pytest.mark.parametrize(("words", "percent"), [(1, 10), (1, 100), (2, 35), (3, 0)])
def test_draws_as_computed_plainly(spark, words, percent):
    rows, target = corpus(), ["foo bar foo", "ärger Straße", None, ""]
    docs = spark.createDataFrame([(i, t, "s", "w", "i", "p", "n") for i, t in rows], SCHEMA).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = answers(resample.drawn(docs, aim, words=words, percent=percent))
    assert sorted(got, key=str) == sorted(plain(rows, target, words, percent=percent), key=str)


def test_ties_blocks_and_empty_tables(spark, monkeypatch):
    rows = [(k, "same words here " * 10) for k in range(100)]
    docs, aim = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([("here",)], "text string")
    got = answers(resample.drawn(docs, aim))
    assert sorted(got, key=str) == sorted(plain(rows, ["here"]), key=str)
    assert {r[4] for r in got} == {None, *range(1, 11)}
    assert answers(resample.drawn(docs.limit(0), aim)) == []
    assert sorted(answers(resample.drawn(docs, aim.limit(0))), key=str) == sorted(plain(rows, []), key=str)
    whole = [w for own in resample.word_blocks("ab, cd Éf" * 500) for w in own]
    monkeypatch.setattr(resample, "BLOCK", 64)
    assert [w for own in resample.word_blocks("ab, cd Éf" * 500) for w in own] == whole
    bucket = resample.Bucket(97)
    short = Counter(b for _, x in resample.features("a b c d " * 300, bucket, 3) for b in x.tolist())
    monkeypatch.setattr(resample, "BLOCK", 1 << 20)
    assert Counter(b for _, x in resample.features("a b c d " * 300, bucket, 3) for b in x.tolist()) == short


def test_query_over_the_whole_tables(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    rows = [tuple(r) for r in read("documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in read("benchmark").collect()]
    assert sorted(answers(op12_resample(spark, "/root/testdata/sf0.001"))) == sorted(plain(rows, target), key=lambda r: r[0])
