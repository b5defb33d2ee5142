"""SimHash near-duplicates: exact pairs within a Hamming radius, found in the shards of a vantage-point tree."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, cut, hot_join, small_batches

RADIUS, WIDTH = 2, 3
#: Fingerprints that a tree is fitted on, about; those that a shard should hold; and the deepest tree that routes rows to tasks.
TREE_SAMPLE, SHARD_ROWS, MAX_DEPTH = 8000, 3000, 16
#: Rows of ids and hashes up to which a list of documents is broadcast (16 MB).
BROADCAST_ROWS = 1_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, repeats included; of the whole sequence if it is shorter, none without words."""
    import xxhash

    text = text or ""
    own = _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))
    if not own:
        return np.zeros(0, np.uint64)
    n = len(own) - width + 1
    digest = xxhash.xxh64_intdigest
    if n < 1:
        return np.array([digest(" ".join(own), 42)], np.uint64)
    if width == 3:
        return np.fromiter((digest(f"{a} {b} {c}", 42) for a, b, c in zip(own, own[1:], own[2:], strict=False)), np.uint64, n)
    return np.fromiter((digest(" ".join(own[i : i + width]), 42) for i in range(n)), np.uint64, n)


def vote(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is set if it is set in over half of them; 0 for none."""
    total, rows = np.zeros(64, np.int64), 8192
    for i in range(0, len(hashes), rows):
        block = hashes[i : i + rows].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    return vote(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(_id, _key, fp): id, hash of the text (null for null) and fingerprint as a signed long, for every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, width) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.view(np.int64))], names=["_id", "_key", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(F.col(text_col)).alias("_key"), F.col(text_col).alias("_t")).mapInArrow(run, "_id bigint, _key bigint, fp bigint")


class VantageTree:
    """Routes fingerprints to shards so that any two within `radius` of each other meet in one.

    A node has a vantage point and a bound; those nearer than the bound go inside, the rest outside. By the triangle
    inequality two fingerprints within the radius differ by at most the radius in their distance to the vantage point.
    So one that lies inside by no more than the radius also visits the outer branch: a pair that is split there meets
    in the outer one, and no other branch need be searched for it.
    """

    def __init__(self, sample: np.ndarray, depth: int, radius: int = RADIUS, seed: int = 11):
        self.depth, self.radius = depth, radius
        self.points = np.zeros(2**depth, np.uint64)
        self.bounds = np.full(2**depth, -1, np.int16)
        self.rng = np.random.default_rng(seed)
        self._grow(1, np.asarray(sample, np.uint64), depth)

    def _grow(self, node: int, rows: np.ndarray, depth: int) -> None:
        if not depth or len(rows) < 8:
            return
        best = None
        for v in rows[self.rng.integers(0, len(rows), 5)]:
            d = np.bitwise_count(rows ^ v).astype(np.int64)
            counts = np.bincount(d, minlength=65 + self.radius)
            below = np.concatenate([[0], np.cumsum(counts)])
            for bound in range(1, 65):
                inside, outside = below[bound], len(rows) - below[max(bound - self.radius, 0)]
                if inside and below[bound] < len(rows) and (best is None or max(inside, outside) < best[0]):
                    best = (max(inside, outside), v, bound)
        if best is None or best[0] > 0.95 * len(rows):
            return
        self.points[node], self.bounds[node] = best[1], best[2]
        d = np.bitwise_count(rows ^ best[1])
        self._grow(2 * node, rows[d < best[2]], depth - 1)
        self._grow(2 * node + 1, rows[d >= best[2] - self.radius] if best[2] > self.radius else rows, depth - 1)

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into fps, shard), one or more shards for each."""
        at, node, done = np.arange(len(fps)), np.ones(len(fps), np.int64), []
        for _ in range(self.depth):
            bound = self.bounds[node]
            end = bound < 0
            done.append((at[end], node[end]))
            at, node, bound = at[~end], node[~end], bound[~end]
            if not len(at):
                break
            d = np.bitwise_count(fps[at] ^ self.points[node]).astype(np.int64)
            inside, outside = d < bound, d >= bound - self.radius
            at, node = np.concatenate([at[inside], at[outside]]), np.concatenate([2 * node[inside], 2 * node[outside] + 1])
        done.append((at, node))
        return np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])


def near_links(fps: np.ndarray, radius: int = RADIUS, block: int = 512) -> np.ndarray:
    """For distinct fingerprints: each one's component among those linked within the radius, as the least index in it.

    First all pairs are compared in blocks, to set those without a neighbour aside. Then the rest is searched breadth first
    among what no component holds yet: a dense group leaves that set at once, and its pairs are never listed.
    """
    n = len(fps)
    root, near = np.arange(n), np.zeros(n, bool)
    for lo in range(0, n, block):
        rows = fps[lo : lo + block]
        hits = np.zeros(len(rows), np.int64)
        for at in range(0, n, 8 * block):
            hits += (np.bitwise_count(rows[:, None] ^ fps[None, at : at + 8 * block]) <= radius).sum(axis=1)
        near[lo : lo + block] = hits > 1
    left = np.nonzero(near)[0]
    while len(left):
        seed, left = left[0], left[1:]
        edge = np.array([seed])
        while len(edge) and len(left):
            met = np.zeros(len(left), bool)
            for lo in range(0, len(edge), block):
                rest = np.nonzero(~met)[0]
                for at in range(0, len(rest), 8 * block):
                    part = rest[at : at + 8 * block]
                    met[part] = (np.bitwise_count(fps[edge[lo : lo + block]][:, None] ^ fps[left[part]][None, :]) <= radius).any(axis=0)
            edge, left = left[met], left[~met]
            root[edge] = seed
    return root


def shard_links(fps: np.ndarray, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links among distinct fingerprints that connect all pairs within the radius; a spanning forest of each part.

    More than shard_rows are split by a tree of their own, again and again, as long as that makes the largest part smaller
    by a tenth. What no vantage point splits is one dense group, which near_links takes apart in whole components.
    """
    if len(fps) > shard_rows:
        depth = max(1, math.ceil(math.log(len(fps) / shard_rows) / math.log(1 / 0.6)))
        rng = np.random.default_rng(seed)
        tree = VantageTree(fps if len(fps) <= TREE_SAMPLE else rng.choice(fps, TREE_SAMPLE, replace=False), min(depth, 10), radius, seed)
        at, shard = tree.route(fps)
        order = np.argsort(shard, kind="stable")
        at, cuts = at[order], np.nonzero(np.diff(shard[order]))[0] + 1
        parts = np.split(at, cuts)
        if max(map(len, parts)) <= 0.9 * len(fps):
            found = [shard_links(np.sort(fps[p]), radius, shard_rows, seed + 1) for p in parts if len(p) > 1]
            return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    root = near_links(fps, radius)
    own = root != np.arange(len(fps))
    return fps[own], fps[root[own]]


def links(distinct: DataFrame, rows: int, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links that connect every pair of fingerprints in `distinct` (column fp, `rows` of them) within the radius.

    The tree that deals fingerprints to tasks is fitted on about TREE_SAMPLE of them, chosen by a hash; it only decides the
    routes, and any tree gives the same components. A task splits a shard that is too large further (shard_links) and
    returns no more links than rows that it compared.
    """
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log(max(rows, 1) / shard_rows) / math.log(1 / 0.6)))) if rows > shard_rows else 0
    sample = np.zeros(0, np.uint64)
    if depth:
        share = min(1.0, TREE_SAMPLE / rows)
        picked = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(share * (1 << 40))).select("fp")
        sample = np.sort(np.array([r[0] for r in picked.collect()], dtype=np.int64)).view(np.uint64)
    tree = VantageTree(sample, depth, radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, shard = tree.route(fps)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fps[at].view(np.int64))], names=["shard", "fp"])

    def forest(t: pa.Table) -> pa.Table:
        a, b = shard_links(np.sort(t.column("fp").to_numpy().view(np.uint64)), radius, shard_rows)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.select("fp").mapInArrow(route, "shard bigint, fp bigint").groupBy("shard").applyInArrow(forest, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the links reaches, for all but those least nodes themselves.

    Alternating stars: every node hands its larger neighbours to the least node around it, then the smaller ones, until
    the links are stars, which takes a logarithmic number of rounds. Both steps keep what is connected connected; each round's
    links are checkpointed, and the neighbours of a node that has very many are joined with it by a broadcast. FEW_ROWS links
    or fewer are one partition, so that the rounds need no shuffle.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if not now.take(1):
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    last, total = None, now.count()
    while True:
        now = now.coalesce(1) if total <= FEW_ROWS else now
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
        large = hot_join(both.filter("v > u"), least, "u", "_n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = hot_join(large, least2, "u", "_n", total).select(F.col("u").alias("_o"), F.col("v").alias("u"), F.col("m").alias("v"))
        # the links of a node's neighbours, and its own, once a node
        small = small.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("_o").alias("u"), F.col("v")))).alias("e")).select("e.*").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = cut(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last, total = state, state[0]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """One row per row of docs: _id, _key (hash of the text), fp, root (least fingerprint of the component), component_id.

    component_id is the least id among all documents that links reach. Equal fingerprints are linked, those of texts without
    words (null included) among them. Rows of null id take part and count for no least id. Repeated rows come back as often.
    A very long text counts whole. An empty table gives no rows, other columns of docs are ignored.
    """
    own = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(own.groupBy("fp").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("_n")))
    size = distinct.agg(F.count(F.lit(1)).alias("fps"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
    roots = components(links(distinct, size["fps"], radius))
    held = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "_n", F.coalesce("root", "fp").alias("root")))
    total = held.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_m"))
    classes = hot_join(held, total, "root", "_m", size["fps"])
    return hot_join(own, classes, "fp", "_n", size["rows"]).select("_id", "_key", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """The rows of docs that stay if one document of each component does: that of least id, then least hash of the text.

    Rows that agree in id and text count as one. Null ids come first. All columns pass through.
    """
    held = near_duplicates(docs, id_col, text_col, radius, width)
    stay = held.groupBy("root").agg(F.min(F.struct("_id", "_key")).alias("_s")).select(F.col("_s._id").alias("_id"), F.col("_s._key").alias("_key"))
    return kept_rows(docs, stay, id_col, text_col)


def kept_rows(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id and hash of the text are in stay (_id, _key); those that agree in both come once.

    Rows that go, and those that come more than once, are found in a narrow table. Where they are BROADCAST_ROWS at most, they
    are broadcast, so that the texts aren't moved.
    """
    narrow = cut(docs.select(F.col(id_col).cast("bigint").alias("_i"), F.xxhash64(F.col(text_col)).alias("_k")).groupBy("_i", "_k").agg(F.count(F.lit(1)).alias("_n")))
    same = lambda x: F.col("_i").eqNullSafe(x["_i2"]) & (F.col("_k") == x["_k2"])
    named = lambda df: df.select(F.col(df.columns[0]).alias("_i2"), F.col(df.columns[1]).alias("_k2"))
    good = named(stay)
    gone, twice = cut(named(narrow.join(good, same(good), "left_anti"))), cut(named(narrow.filter("_n > 1").join(good, same(good), "left_semi")))
    few = gone.count() + twice.count() <= BROADCAST_ROWS
    held = lambda df: F.broadcast(df) if few else df
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("bigint").alias("_i"), F.xxhash64(F.col(text_col)).alias("_k"))
    once = rows.join(held(gone.union(twice)), same(gone), "left_anti")
    more = rows.join(held(twice), same(twice), "left_semi").dropDuplicates(["_i", "_k"])
    return once.union(more).select("_row.*")
