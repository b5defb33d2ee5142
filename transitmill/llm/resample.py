"""Importance resampling to a target distribution: hashed word counts of both sides, a gain a bucket, and a draw by Gumbel scores."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, running, small_batches, widened

BUCKETS, WORDS, PERCENT, MIN_WORDS, SEED = 10_000, 1, 10, 20, "2024"
#: Bytes of a text that are split into words at a time, and features whose bucket is remembered.
BLOCK, KEPT = 1 << 20, 200_000
#: Vectors that reach the driver at once, at most.
FAN = 64
#: Bytes of a word: digits, small letters and all of other characters; capitals become small, everything else a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Bucket(dict):
    """Feature bytes to bucket, remembered up to KEPT features."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def word_blocks(text: str) -> Iterator[list[bytes]]:
    """The words of a text in lists of about BLOCK bytes; blocks end between words."""
    data = text.encode().translate(_TABLE)
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + BLOCK) if lo + BLOCK < len(data) else -1
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi


def features(text: str | None, bucket: Bucket, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the features that end in them) for every block of a text: all runs of 1 to `words` words."""
    before: list[bytes] = []
    for own in word_blocks(text or ""):
        run = before + own
        found = own
        for n in range(2, words + 1):
            found = found + [b" ".join(run[i - n + 1 : i + 1]) for i in range(max(len(before), n - 1), len(run))]
        before = run[len(run) - words + 1 :] if words > 1 else []
        yield len(own), np.fromiter(map(bucket.__getitem__, found), np.int64, len(found))


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, words: int = WORDS) -> np.ndarray:
    """Features of all texts in each bucket: a vector a partition, merged in a tree whose last step brings FAN vectors to the driver."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total = Bucket(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                for _, held in features(text, bucket, words):
                    total += np.bincount(held, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = docs.select(F.col(text_col).alias("_t")).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64).copy())
    parts = max(2, vectors.getNumPartitions())
    return vectors.treeAggregate(np.zeros(buckets, np.int64), np.add, np.add, depth=max(2, math.ceil(math.log(parts, FAN // 2))))


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the corpus's) of each bucket, in doubles."""
    n, s, t = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gains: Broadcast[np.ndarray], keep: list[str], text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The columns `keep` of docs with n_words, n_features and weight, the floored mean of the gains of a text's features (none: 0)."""
    small_batches(docs.sparkSession)
    new = {"n_words": "bigint", "n_features": "bigint", "weight": "bigint"}
    given, at, schema = widened(docs, keep, new, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains.value
        bucket = Bucket(len(gain))
        for b in batches:
            n = np.zeros((2, b.num_rows), np.int64)
            total = np.zeros(b.num_rows, np.int64)
            rows: list[int] = []
            held: list[np.ndarray] = []
            size = 0
            for k, text in enumerate(b.column(at).to_pylist()):
                for count, found in features(text, bucket, words):
                    n[:, k] += count, len(found)
                    rows.append(k)
                    held.append(found)
                    size += len(found)
                    if size >= BLOCK:
                        total += _sums(rows, held, gain, b.num_rows)
                        rows, held, size = [], [], 0
            total += _sums(rows, held, gain, b.num_rows)
            made = [n[0], n[1], total // np.maximum(n[1], 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *map(pa.array, made)], names=[*keep, *new])

    return given.mapInArrow(run, schema)


def _sums(rows: list[int], held: list[np.ndarray], gain: np.ndarray, n: int) -> np.ndarray:
    """Sums of gains by row; doubles hold them exactly, as a call has few features."""
    if not held:
        return np.zeros(n, np.int64)
    return np.bincount(np.repeat(rows, [len(x) for x in held]), weights=gain[np.concatenate(held)], minlength=n).astype(np.int64)


def gumbel(id_col: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the SHA-256 of seed and id; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, words: int = WORDS, seed: str = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document: rank 1, 2, 3... for the drawn ones, null for the others.

    A document's score is its weight plus Gumbel noise from its id, so that drawing the highest scores samples without
    replacement by exp(weight / 1000). Of the N documents with min_words words or more, floor(percent * N / 100) are drawn; ties
    go to the smaller id, null first, and rows that agree in id stand in the order of their weight. Null texts have no words.
    An empty target, or an empty table, is counted as such. A long text is read block by block. Only `docs` columns named here
    are read.

    The cut is found from the number of documents at each score, an integer between bounds that the logarithms set, so the list
    has some ten thousand entries whatever the corpus; only documents at or above the cut are put in order.
    """
    spark = docs.sparkSession
    gains = spark.sparkContext.broadcast(bucket_gains(bucket_counts(docs, text_col, buckets, words), bucket_counts(target, target_col, buckets, words)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    scored = cut(weighted(rows, gains, ["_id"], "_t", words).withColumn("score", F.col("weight") + gumbel(F.col("_id"), seed)))
    able = F.col("n_words") >= min_words
    sizes = sorted((r["score"], r["n"]) for r in scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect())
    draw = percent * sum(n for _, n in sizes) // 100
    lowest, above = None, 0
    while above < draw:
        lowest, n = sizes.pop()
        above += n
    out = [F.col("_id").alias(id_col), "n_words", "n_features", "weight", "score"]
    if lowest is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    in_question = able & (F.col("score") >= lowest)
    ordered = running(scored.filter(in_question), [F.col("score").desc(), F.col("_id").asc(), F.col("weight").desc(), F.col("n_features").asc()], {})
    rank = F.when(F.col("_pos") < draw, F.col("_pos") + 1).cast("long")
    return ordered.select(*out, rank.alias("rank")).unionByName(scored.filter(~in_question).select(*out, F.lit(None).cast("long").alias("rank")))
