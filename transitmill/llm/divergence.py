"""How far sources of a language differ: terms counted in byte tries, merged by ranges of terms, and compared in exact integers."""

from __future__ import annotations

import heapq
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .common import shuffle_parts, small_batches

#: Documents of a language that a kept term is in, at least; what is added to every count; the unit of a share; ranks of terms.
MIN_DOCS, PRIOR, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Terms that a trie holds before its leaves are handed on.
FULL = 300_000
#: Characters of texts that are counted at once; a longer text is counted by itself.
PORTION = 1 << 24
#: Cells of a matrix of terms and sources that is computed at once.
CELLS = 1 << 20
#: Bytes of a text that are split into terms at a time.
BLOCK = 1 << 20
#: Bytes of a term: letters without accents, made small, and all bytes of other characters; everything else becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: The leaf's counter of documents; sources count from 0.
_DOCS = -1


class Node:
    """A node of a radix trie: the bytes on the edge to it, the nodes below by their first byte, and the counters of the term that ends here."""

    __slots__ = ("below", "counts", "label")

    def __init__(self, label: bytes, below: dict[int, Node] | None, counts: dict[int, int] | None):
        self.label, self.below, self.counts = label, below, counts


class RadixTrie:
    """Terms as bytes, each with counters by key. Two tries merge by adding leaf to leaf, so counting parts and merging equals counting all."""

    def __init__(self) -> None:
        self.top, self.size = Node(b"", {}, None), 0

    def leaf(self, term: bytes) -> dict[int, int]:
        """The counters of a term, made if it is new: an edge that the term leaves half-way is split there."""
        node, at = self.top, 0
        while at < len(term):
            if node.below is None:
                node.below = {}
            child = node.below.get(term[at])
            if child is None:
                node.below[term[at]] = node = Node(term[at:], None, None)
                break
            label = child.label
            if len(label) == 1 or term.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = 1
            while at + k < len(term) and label[k] == term[at + k]:
                k += 1
            upper = Node(label[:k], {label[k]: child}, None)
            child.label = label[k:]
            node.below[term[at]] = upper
            node, at = upper, at + k
        if node.counts is None:
            node.counts = {}
            self.size += 1
        return node.counts

    def __iter__(self) -> Iterator[tuple[bytes, dict[int, int]]]:
        """All terms in the order of their UTF-8 bytes, with their counters."""
        stack = [(b"", self.top)]
        while stack:
            head, node = stack.pop()
            term = head + node.label
            if node.counts is not None:
                yield term, node.counts
            if node.below:
                stack += [(term, node.below[b]) for b in sorted(node.below, reverse=True)]

    def add(self, term: bytes, counts: Iterator[tuple[int, int]]) -> None:
        held = self.leaf(term)
        for k, n in counts:
            held[k] = held.get(k, 0) + n

    def merge(self, other: RadixTrie) -> None:
        for term, counts in other:
            self.add(term, counts.items())


def term_blocks(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in lists of about BLOCK bytes."""
    data = text.encode().translate(_TABLE)
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + BLOCK) if lo + BLOCK < len(data) else -1
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi


_LEAF = "lang int, term string, docs bigint, sources array<int>, counts array<bigint>"


def _leaves(lang: int, leaves: Iterator[tuple[bytes, dict[int, int]]], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Leaves as rows of _LEAF, a batch for each `size` of them. Their counters of documents are taken out."""
    terms: list[bytes] = []
    docs: list[int] = []
    ends, sources, counts = [0], [], []  # type: tuple[list[int], list[int], list[int]]

    def batch() -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((sources, pa.int32()), (counts, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.int32()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(docs, pa.int64()), *lists], names=["lang", "term", "docs", "sources", "counts"])

    for term, held in leaves:
        terms.append(term)
        docs.append(held.pop(_DOCS))
        sources.extend(held)
        counts.extend(held.values())
        ends.append(len(sources))
        if len(terms) >= size:
            yield batch()
            terms, docs, ends, sources, counts = [], [], [0], [], []
    if terms:
        yield batch()


def _fold(tries: dict[int, RadixTrie], places: list[tuple[int, int]], texts: list[bytes]) -> None:
    """Adds texts, as bytes of terms and spaces, to the tries. Occurrences are counted by number, so a trie is walked once a term."""
    words = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
    coded = words.flatten().dictionary_encode()
    terms = coded.dictionary.cast(pa.binary()).to_pylist()
    n = len(terms)
    doc = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    each, times = np.unique(doc * n + coded.indices.to_numpy(), return_counts=True)
    doc, term = np.divmod(each, max(n, 1))
    langs, sources = (np.array([p[i] for p in places], np.int64) for i in range(2))
    most = int(sources.max(initial=0)) + 1
    pairs, at = np.unique((langs[doc] * n + term) * most + sources[doc], return_inverse=True)
    counts = np.bincount(at, weights=times, minlength=len(pairs)).astype(np.int64).tolist()
    own = (pairs % most).tolist()
    keys = pairs // most
    first = np.nonzero(np.diff(keys, prepend=-1))[0]
    docs = np.add.reduceat(np.bincount(at, minlength=len(pairs)), first) if len(first) else first
    for k, d, lo, hi in zip(keys[first].tolist(), docs.tolist(), first.tolist(), np.append(first, len(own))[1:].tolist(), strict=True):
        lang, i = divmod(k, n)
        if not terms[i]:
            continue
        held = tries[lang].leaf(terms[i])
        if held:
            held[_DOCS] += d
            for j in range(lo, hi):
                held[own[j]] = held.get(own[j], 0) + counts[j]
        else:
            held[_DOCS] = d
            held.update(zip(own[lo:hi], counts[lo:hi], strict=True))


def _fold_long(trie: RadixTrie, source: int, text: str) -> None:
    """The same for one text of any length, block by block."""
    counts: Counter = Counter()
    for terms in term_blocks(text):
        counts.update(terms)
    for term, n in counts.items():
        trie.add(term, [(_DOCS, 1), (source, n)])


def counted(docs: DataFrame, places: dict[tuple[str, str], tuple[int, int]]) -> DataFrame:
    """Rows of _LEAF from docs (lang, source, text), a row for each term that a task's trie holds when it is full or the task ends."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[int, RadixTrie] = defaultdict(RadixTrie)
        held: list[tuple[tuple[int, int], bytes]] = []
        size = 0

        def folded(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                _fold(tries, *map(list, zip(*held, strict=True)))
            held, size = [], 0
            if sum(t.size for t in tries.values()) >= least:
                for lang, trie in tries.items():
                    yield from _leaves(lang, trie)
                tries.clear()

        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                place = places[lang, source]
                if len(text) >= PORTION:
                    _fold_long(tries[place[0]], place[1], text)
                elif text:
                    held.append((place, text.encode().translate(_TABLE)))
                    size += len(text)
                if size >= PORTION:
                    yield from folded(FULL)
        yield from folded(0)

    return docs.mapInArrow(run, _LEAF)


def merged(leaves: DataFrame, min_docs: int) -> DataFrame:
    """Rows of _LEAF, one for each term of a language in min_docs documents or more.

    Tasks take ranges of terms, and in a range rows come in order, so that a term's rows stand together. Those whose documents sum up
    to too few are passed over; the others, and a batch's first and last term, of which more may lie outside it, are merged in a
    trie, which is read out by thousands of terms, all but the last.
    """
    dealt = leaves.repartitionByRange(shuffle_parts(leaves.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at, last = RadixTrie(), None, b""

        def kept(done: bool) -> Iterator[pa.RecordBatch]:
            nonlocal trie
            waiting = None if done else trie.leaf(last)
            yield from _leaves(at, ((t, c) for t, c in trie if c is not waiting and c[_DOCS] >= min_docs))
            trie = RadixTrie()
            if waiting is not None:
                trie.add(last, waiting.items())

        for b in batches:
            langs, docs = b.column(0).to_numpy(), b.column(2).to_numpy()
            if not len(docs):
                continue
            other = (langs[1:] != langs[:-1]) | pc.not_equal(b.column(1).slice(1), b.column(1).slice(0, len(docs) - 1)).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.nonzero(other)[0] + 1])
            good = np.add.reduceat(docs, first) >= min_docs
            good[[0, -1]] = True
            few = b.take(pa.array(np.nonzero(np.repeat(good, np.diff([*first, len(docs)])))[0]))
            terms = few.column(1).cast(pa.binary()).to_pylist()
            for lang, term, n, sources, counts in zip(few.column(0).to_pylist(), terms, *(few.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if lang != at:
                    if at is not None:
                        yield from kept(True)
                    at = lang
                trie.add(term, [(_DOCS, n), *zip(sources, counts, strict=True)])
                last = term
                if trie.size >= 20_000:
                    yield from kept(False)
        if at is not None:
            yield from kept(True)

    return dealt.mapInArrow(run, _LEAF)


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / total), exact: long division by three digits at a time, so that nothing exceeds 64 bits."""
    whole, rest = np.divmod(counts + PRIOR, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def compared(kept: DataFrame, sizes: dict[int, np.ndarray], terms: dict[int, int], top: int) -> DataFrame:
    """(lang, source, item, term, value): for each pair of sources its sum over the rows of a task (item set), and for each source
    the task's `top` terms (term set). sizes: kept occurrences by source, terms: number of kept terms, each by language."""
    small_batches(kept.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        best: dict[tuple[int, int], list[tuple[int, bytes]]] = defaultdict(list)
        for b in batches:
            langs = b.column(0).to_numpy()
            for lang in np.unique(langs).tolist():
                own = b.take(pa.array(np.nonzero(langs == lang)[0]))
                n = len(sizes[lang])
                step = max(1, CELLS // n)
                for lo in range(0, own.num_rows, step):
                    _compare(own.slice(lo, step), sizes[lang], terms[lang], sums.setdefault(lang, np.zeros((n, n), np.int64)), lang, best, top)
        rows = [(lang, s, k, None, int(total[s, k])) for lang, total in sums.items() for s in range(len(total)) for k in range(s + 1, len(total))]
        rows += [(lang, s, None, term.decode(), -value) for (lang, s), found in best.items() for value, term in found]
        for lo in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[lo : lo + 50_000]], schema=schema)

    names = ["lang", "source", "item", "term", "value"]
    schema = pa.schema([("lang", pa.int32()), ("source", pa.int32()), ("item", pa.int32()), ("term", pa.string()), ("value", pa.int64())])
    return kept.mapInArrow(run, "lang int, source int, item int, term string, value bigint")


def _compare(rows: pa.RecordBatch, sizes: np.ndarray, terms: int, sums: np.ndarray, lang: int, best: dict, top: int) -> None:
    """Adds the rows' part of every pair to sums, and keeps the best terms of each source: largest value first, then least bytes."""
    n = len(sizes)
    lists = rows.column(3)
    row = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(lists.offsets)))
    count = np.zeros((rows.num_rows, n), np.int64)
    count[row, lists.flatten().to_numpy()] = rows.column(4).flatten().to_numpy()
    p = shares(count, sizes + PRIOR * terms)
    q = shares(count.sum(axis=1), int(sizes.sum()) + PRIOR * terms)
    for s in range(n - 1):
        sums[s, s + 1 :] += np.abs(p[:, s + 1 :] - p[:, s : s + 1]).sum(axis=0)
    above = np.where(count > 0, p - q[:, None], 0)
    names = rows.column(1).cast(pa.binary())
    for s in range(n):
        at = np.nonzero(above[:, s] > 0)[0]
        if len(at) > top:
            at = at[above[at, s] >= np.partition(above[at, s], -top)[-top]]
        found = zip((-above[at, s]).tolist(), names.take(pa.array(at)).to_pylist(), strict=True)
        best[lang, s] = heapq.nsmallest(top, [*best[lang, s], *found])


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for every source of a language the other sources by their distance (part `pair`),
    and the terms that it uses more than the language as a whole, the first `top` (part `term`).

    Nulls of the three columns count as ''. Terms are runs of letters (A-Z made small) and characters beyond ASCII; a language
    keeps those that min_docs of its rows have. With N the kept occurrences of a source and V the kept terms, a term's share is
    p = 1 + floor(UNIT * (count + PRIOR) / (N + PRIOR * V)), and q the language's. The distance of two sources is the sum of the
    difference of their shares over all kept terms, 0 if there are none; a term's value is p - q. Ranks go by value, largest first, ties by UTF-8 bytes.
    Repeated rows count as often as they come, a source without terms is compared like any other, an empty table gives no
    rows, and other columns aren't read. A long text is read block by block.

    Tasks hold a trie of bounded size, later a number for each pair of sources of a language. The list of sources goes to the
    driver and the executors: the result has a row for each pair of them, so it is no longer than the root of the result.
    """
    spark = docs.sparkSession
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    groups: dict[str, list[str]] = defaultdict(list)
    for r in own.select("lang", "source").distinct().collect():
        groups[r["lang"]].append(r["source"])
    langs = sorted(groups)
    places = {(lang, source): (k, s) for k, lang in enumerate(langs) for s, source in enumerate(sorted(groups[lang]))}
    folder = f"{shared_folder(spark)}/divergence-{uuid.uuid4().hex}"
    counted(own, places).write.parquet(f"{folder}/leaves")
    merged(spark.read.parquet(f"{folder}/leaves"), min_docs).write.parquet(f"{folder}/kept")
    kept = spark.read.parquet(f"{folder}/kept")
    sizes = {k: np.zeros(len(groups[lang]), np.int64) for k, lang in enumerate(langs)}
    for r in kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", "x.sources").agg(F.sum("x.counts").alias("n")).collect():
        sizes[r["lang"]][r["sources"]] = r["n"]
    terms = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = compared(kept, sizes, terms, top)
    names = spark.createDataFrame([(k, s, lang, source) for (lang, source), (k, s) in places.items()], "k int, s int, lang string, source string")
    sums = found.filter("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select(F.col("lang").alias("k"), F.col("source").alias("x"), F.col("item").alias("y"), "value")
    both = names.join(names.select("k", F.col("s").alias("t"), F.col("source").alias("item")), "k").filter("s <> t")
    pairs = both.select("*", F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y")).join(sums, ["k", "x", "y"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    few = found.filter("term is not null").select(F.col("lang").alias("k"), F.col("source").alias("s"), F.col("term").alias("item"), "value").join(F.broadcast(names), ["k", "s"])
    few = few.select("lang", "source", F.lit("term").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
