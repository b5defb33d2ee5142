"""Near copies by the exact Jaccard similarity of word shingles, among candidates from SimHash classes and from bands of least hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import FEW_ROWS, checkpoints_of_call, cut, drop_checkpoints, free_shuffles, hot_join, salted_join, small_batches
from .simhash import components, kept_rows

#: Words of a shingle, and the similarity from which texts are near copies, in hundredths.
WIDTH, SIMILARITY = 5, 80
#: Bands, and least hashes in each: two sets of similarity s share none with a chance of (1 - s^ROWS)^BANDS, 1.4e-7 at 0.8.
BANDS, ROWS = 30, 4
#: Sets in a bucket up to which all its pairs are compared at once; pivots that the rest of a larger one is first compared with,
#: and how many times as many each next round takes.
SMALL, PIVOTS, MORE = 24, 8, 8
#: Sets of a large bucket that one task compares with its pivots.
PART = 1000
#: log2 of the bits of the bitmap that keeps out bands which only one set has: 8 MB, whatever the size of the data.
SLOT_BITS = 26
#: Up to so many candidates their ids are broadcast, so that only their texts are moved.
BROADCAST = 1_000_000


def multipliers(n: int = BANDS * ROWS, seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, odd: np.ndarray, block: int = 4096) -> np.ndarray:
    """One key a band for a set of shingle hashes: made of the least values under ROWS multiplications each. None for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), block):
        np.minimum(least, (hashes[lo : lo + block, None] * odd[None, :]).min(axis=0), out=least)
    rows = least.reshape(BANDS, -1)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = (key ^ (rows[:, k] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + rows[:, k]
    return key.view(np.int64)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int, whole: bool = False) -> DataFrame:
    """(_id, _key, set_key, n, fp, held) for every row: hash of the set of shingles, its size, the SimHash fingerprint, and the
    set's band keys, or the whole set."""
    import xxhash

    odd = multipliers()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n, fps, held = [], [], [], []
            for t in b.column(2).to_pylist():
                every = simhash.shingle_hashes(t, width)
                own = np.unique(every)
                key.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                n.append(len(own))
                fps.append(0 if whole else simhash.vote(every))
                held.append(own.view(np.int64) if whole else band_keys(own, odd))
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), signed(key), pa.array(n, pa.int64()), signed(fps), pa.array(held, pa.list_(pa.int64()))], names=["_id", "_key", "set_key", "n", "fp", "held"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(F.col(text_col)).alias("_key"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, "_id bigint, _key bigint, set_key bigint, n bigint, fp bigint, held array<bigint>")


def simhash_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b): the least set of each SimHash class and every other one: fingerprints within the radius, through the operator's tree."""
    fps = cut(distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("_n")))
    size = fps.agg(F.count(F.lit(1)).alias("fps"), F.coalesce(F.sum("_n"), F.lit(0)).alias("sets")).first()
    roots = components(simhash.links(fps, size["fps"]))
    own = cut(hot_join(distinct.select("set_key", "fp"), fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "_n", F.coalesce("root", "fp").alias("root")), "fp", "_n", size["sets"]))
    least = own.groupBy("root").agg(F.min("set_key").alias("a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return hot_join(own.select("root", F.col("set_key").alias("b")), least, "root", "_n", size["sets"]).filter("a < b").select("a", "b")


def shared_slots(tokens: DataFrame, bits: int = SLOT_BITS) -> np.ndarray:
    """A bitmap of 2**bits slots, packed as bytes: those that a token falls into which more than one row bears. Its size is fixed."""
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    slot = F.pmod(F.col("token"), F.lit(1 << bits)) + 1  # these functions count from 1
    rows = shared.groupBy(F.call_function("bitmap_bucket_number", slot).alias("b")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", slot)).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        at = (r["b"] - 1) * len(r["bits"])
        out[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def shared_tokens(distinct: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """(token, set_key, n) of the band keys, without most of those that only one set has: those in a slot without a shared one."""
    slots = shared_slots(distinct.select(F.explode("held").alias("token")), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
            slot = flat % (1 << bits)
            good = np.nonzero((slots[slot >> 3] >> (slot & 7) & 1).astype(bool))[0]
            at = pa.array(owner[good])
            yield pa.RecordBatch.from_arrays([pa.array(flat[good]), b.column(0).take(at), b.column(1).take(at)], names=["token", "set_key", "n"])

    return distinct.select("set_key", "n", "held").mapInArrow(run, "token bigint, set_key bigint, n bigint")


class Verifier:
    """Keeps of candidate pairs (a, b) those whose whole sets have the similarity. Sets are read once, for all that may come."""

    def __init__(self, docs: DataFrame, distinct: DataFrame, keys: DataFrame, id_col: str, text_col: str, width: int, similarity: int):
        reps = cut(distinct.join(keys, "set_key", "left_semi").select(F.col("least._id").alias("_i"), F.col("least._key").alias("_k")))
        reps = F.broadcast(reps) if reps.count() <= BROADCAST else reps
        rows = docs.select(F.col(id_col), F.col(text_col), F.col(id_col).cast("bigint").alias("_i2"), F.xxhash64(F.col(text_col)).alias("_k2"))
        chosen = rows.join(reps, F.col("_i").eqNullSafe(F.col("_i2")) & (F.col("_k") == F.col("_k2")), "left_semi").dropDuplicates(["_i2", "_k2"])
        self.sets, self.similarity = cut(shingle_sets(chosen, id_col, text_col, width, whole=True).select("set_key", "held")), similarity

    def __call__(self, pairs: DataFrame) -> DataFrame:
        count = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")))
        total = count.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        x, y = (self.sets.select(F.col("set_key").alias(k), F.col("held").alias(f"s{k}")) for k in "ab")
        common = F.size(F.array_intersect("sa", "sb"))
        # sets are long: one that very many others are compared with is dealt out, and the pairs move without sets first
        held = salted_join(pairs.select("a", "b"), x, count, "a", total).join(y, "b").filter(common * 100 >= (F.size("sa") + F.size("sb") - common) * self.similarity)
        return cut(held.select("a", "b"))


def shareable(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(set_key, u): how many of a set's shingles no other set of `keys` (set_key) has, for those that have such ones."""
    own = sets.join(keys, "set_key", "left_semi").select("set_key", F.explode("held").alias("s"))
    return own.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("set_key").alias("set_key")).filter("k = 1").groupBy("set_key").agg(F.count(F.lit(1)).alias("u"))


def joined(edges: DataFrame) -> DataFrame:
    """components() of links (a, b); where these are FEW_ROWS or fewer, which any task can take, by one short job and as a frame to broadcast."""
    now = cut(edges.select("a", "b").filter("a <> b").distinct())
    if now.count() > FEW_ROWS:
        return components(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = sorted((find(x), find(y)))
                root[y] = x
        nodes = [x for x in root if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])

    return F.broadcast(cut(now.coalesce(1).mapInArrow(run, "node bigint, root bigint")))


def renamed(held: DataFrame, roots: DataFrame) -> DataFrame:
    """held with the root of its `root`, where that has another one."""
    return held.join(roots.select("node", F.col("root").alias("_root")), F.col("root") == F.col("node"), "left").withColumn("root", F.coalesce("_root", "root")).drop("node", "_root")


def grouped(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, width: int, similarity: int, small: int = SMALL) -> DataFrame:
    """distinct (set_key, least) with `root`, the same for all sets that a chain of pairs of the similarity joins, as all pairs would.

    Candidates are the pairs of a SimHash class, each set with the least one, and those of a bucket (sets that share a band).
    In each bucket all sets are first compared with the one that shares most bands with others, such as the text that many
    copies were made of: a large group of near copies becomes one component by that. Pairs that this left in different
    components are compared too: all of a small bucket at once, those of a large one with more and more pivots, chosen by a
    hash, until the bucket is one component or every set was a pivot. So no pair of a bucket is left out, but for those that
    a bound rules out: of a set of n shingles, c of which another set still in question has, nothing shares more than c. Two
    sets have the similarity s only if min(c1, c2) * (1 + s) >= s * (n1 + n2), and one set has a partner only if c >= s * n.
    In a large group whose texts were each edited by themselves the bound leaves few pairs.
    """
    tokens = cut(shared_tokens(distinct))
    shared = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").withColumn("size", F.col("_k")))
    total = shared.agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("t")).first()
    members = cut(hot_join(tokens, shared, "token", "_k", total["t"]))
    close = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * similarity)
    degree = members.groupBy("set_key").agg(F.sum("size").alias("d"))
    best = members.join(degree, "set_key").groupBy("token").agg(F.max(F.struct("d", "set_key", "n")).alias("p"), F.first("size").alias("_k"))
    star = hot_join(members, best, "token", "_k", total["t"]).filter((F.col("p.set_key") != F.col("set_key")) & close(F.col("p.n"), F.col("n")))
    tried = cut(star.select(F.col("p.set_key").alias("a"), F.col("set_key").alias("b")).union(simhash_pairs(distinct)).distinct())
    keys = members.select("set_key").union(tried.select("a")).union(tried.select("b")).distinct()
    verified = Verifier(docs, distinct, keys, id_col, text_col, width, similarity)

    def mixed(held: DataFrame) -> DataFrame:
        """The members of buckets that hold more than one component, with the number of them."""
        more = cut(held.groupBy("token").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count(F.lit(1)).alias("_k")).filter("_lo < _hi").select("token", "_k", F.col("_k").alias("size")))
        return cut(hot_join(held.drop("size"), more, "token", "_k", total["t"]))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))

    roots, pivots = [joined(verified(tried))], PIVOTS
    live = mixed(renamed(members.withColumn("root", F.col("set_key")), roots[0]))
    free_shuffles(docs.sparkSession)
    alone = shareable(verified.sets, live.select("set_key").distinct())
    live = mixed(live.join(alone, "set_key", "left").withColumn("c", F.col("n") - F.coalesce("u", F.lit(0))).drop("u").filter(F.col("c") * 100 >= F.col("n") * similarity))
    while live.take(1):
        few = F.col("size") <= small
        chance = F.pmod(F.xxhash64("set_key", F.lit(pivots)), F.lit(1 << 20)) * F.col("size") < pivots * (1 << 20)
        # a bucket is dealt out by some hundred sets, and its pivots go to each part
        ways = F.ceil(F.col("size") / PART).cast("int")
        salt = F.pmod(F.xxhash64("set_key"), ways)
        y = live.select("token", F.col("set_key").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("root").alias("rb"), "size", salt.alias("salt"))
        x = live.filter(few | chance).select(F.col("token").alias("token_"), F.col("set_key").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("root").alias("ra"), F.explode(F.sequence(F.lit(0), ways - 1)).alias("salt_"))
        can = F.least("ca", "cb") * (100 + similarity) >= (F.col("na") + F.col("nb")) * similarity
        met = x.join(y, (F.col("token_") == F.col("token")) & (F.col("salt_") == F.col("salt")) & (F.col("ra") != F.col("rb")) & can & ((F.col("a") < F.col("b")) | (F.col("size") > small)))
        # the roots of a pair's sets come along, so that only links between what is apart so far are joined up
        pairs = cut(met.select("a", "b", "ra", "rb", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).dropDuplicates(["lo", "hi"]).join(ordered(tried), ["lo", "hi"], "left_anti").select("a", "b", "ra", "rb"))
        roots.append(joined(pairs.join(verified(pairs), ["a", "b"], "left_semi").select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
        tried = tried.union(pairs.select("a", "b"))
        live = mixed(renamed(live.filter(F.col("size") > max(small, pivots)), roots[-1]))
        pivots *= MORE
        free_shuffles(docs.sparkSession)
    out = distinct.select("set_key", "least", F.col("set_key").alias("root"))
    for r in roots:
        out = renamed(out, r)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: int = SIMILARITY, small: int = SMALL) -> DataFrame:
    """The rows of docs that stay if one document of each group of near copies does: that of least id, then least hash of the text.

    Documents are in one group if a chain of pairs of the similarity joins them; texts without words (null included) are one
    group. A pair's similarity is computed from both whole sets, and a pair at the threshold is missed with a chance of
    1.4e-7, less above it. Shingles and sets are told apart by 64-bit hashes. Rows that agree in id and text count as one.
    Null ids come first. All columns pass through. A very long text counts whole, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    with checkpoints_of_call() as made:
        sets = shingle_sets(docs, id_col, text_col, width)
        distinct = cut(sets.groupBy("set_key").agg(F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("held").alias("held"), F.min(F.struct("_id", "_key")).alias("least")))
        held = grouped(docs, distinct, id_col, text_col, width, similarity, small)
        done = list(made)
        stay = cut(held.groupBy("root").agg(F.min("least").alias("_s")).select(F.col("_s._id").alias("_id"), F.col("_s._key").alias("_key")))
        drop_checkpoints(spark, done)
        free_shuffles(spark)
        return kept_rows(docs, stay, id_col, text_col)
