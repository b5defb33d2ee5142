"""Toxicity: a factorization machine over hashed terms, trained on a bounded sample of labelled rows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, widened
from .langid import learned_rows, thinned

#: Bits of a term's hash.
BITS = 24
_WORD = re.compile(r"[^\W\d_]+")
_KEPT_WORDS = 200_000


def term_hashes(word: str) -> tuple[int, ...]:
    """Hashes of a word's terms: the word, and its beginnings of 4, 5 and 6 letters if it is longer."""
    mask = (1 << BITS) - 1
    out = [zlib.crc32(word.encode()) & mask]
    out += [zlib.crc32(f"{word[:n]}*".encode()) & mask for n in (4, 5, 6) if len(word) > n]
    return tuple(out)


def hashed_terms(text: str | None) -> list[int]:
    """The distinct term hashes of a whole text, ascending."""
    return sorted({h for w in set(_WORD.findall((text or "").lower())) for h in term_hashes(w)})


@dataclass
class Model:
    """score = logistic(bias + sum of w + sum over pairs of the dot product of their rows in v), over the learned terms present."""

    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float

    def score(self, rows: np.ndarray) -> float:
        if not len(rows):
            return float(1 / (1 + np.exp(-self.bias)))
        v = self.v[rows]
        total = v.sum(axis=0)
        z = self.bias + self.w[rows].sum() + 0.5 * float(total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Rows(dict):
    """word -> rows of its learned terms; bounded, begun anew when full."""

    def __init__(self, terms: np.ndarray):
        super().__init__()
        self.row = {int(t): i for i, t in enumerate(terms)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        row = self.row
        found = tuple(row[h] for h in term_hashes(word) if h in row)
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = found
        return found


def train(docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, factors: int = 4, epochs: int = 25, rate: float = 0.08, l2: float = 2e-5, l2_pairs: float = 2e-5, seed: int = 5) -> Model:
    """Fits the machine over all terms in docs by minibatch AdaGrad on the weighted logistic loss. Without factors it is a linear model."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    prior = float(np.clip((labels * weights).sum() / max(weights.sum(), 1e-9), 1e-4, 1 - 1e-4)) if len(labels) else 0.01
    bias = float(np.log(prior / (1 - prior)))
    terms, row = np.unique(flat, return_inverse=True)
    start = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    m = len(terms)
    w, v = np.zeros(m), rng.normal(0, 0.02, (m, factors))
    gw, gv, gb = np.full(m, 1e-6), np.full((m, factors), 1e-6), 1e-6
    scale = weights / weights.mean() if len(weights) else weights
    for _ in range(epochs if m else 0):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), 128):
            batch = order[lo : lo + 128]
            lengths = start[batch + 1] - start[batch]
            at = np.concatenate([np.arange(start[i], start[i + 1]) for i in batch]) if lengths.sum() else np.zeros(0, np.int64)
            own, r = np.repeat(np.arange(len(batch)), lengths), row[at]
            out = bias + np.bincount(own, weights=w[r], minlength=len(batch))
            vr, total = v[r], np.zeros((len(batch), factors))
            for f in range(factors):
                total[:, f] = np.bincount(own, weights=vr[:, f], minlength=len(batch))
            out = out + 0.5 * ((total * total).sum(axis=1) - np.bincount(own, weights=(vr * vr).sum(axis=1), minlength=len(batch)))
            err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[batch]) * scale[batch] / len(batch)
            touched, back = np.unique(r, return_inverse=True)
            dw = np.bincount(back, weights=err[own], minlength=len(touched)) + l2 * w[touched]
            dv = l2_pairs * v[touched]
            for f in range(factors):
                dv[:, f] += np.bincount(back, weights=err[own] * (total[own, f] - vr[:, f]), minlength=len(touched))
            gw[touched] += dw * dw
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            gv[touched] += dv * dv
            v[touched] -= 0.3 * rate * dv / np.sqrt(gv[touched])
            gb += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(gb)
    return Model(terms.astype(np.int64), w.astype(np.float32), v.astype(np.float32), bias)


def telling_terms(lists: DataFrame, n_pos: int, n_neg: int, max_terms: int, min_z: float) -> np.ndarray:
    """The terms of lists (_label, terms), ascending, whose log-odds between the classes lie min_z standard errors or more from
    zero, max_terms at most, those furthest from it; the rest are noise to a text of thousands of words."""
    counts = lists.select("_label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("_label").alias("pos"), F.count(F.lit(1)).alias("n"))
    p, q = F.col("pos") + 0.5, F.col("n") - F.col("pos") + 0.5
    z = F.abs(F.log(p / (max(n_pos, 1) + 1)) - F.log(q / (max(n_neg, 1) + 1))) / F.sqrt(1 / p + 1 / q)
    best = counts.filter(F.col("n") >= 4).select("term", z.alias("z")).filter(F.col("z") >= min_z).orderBy(F.desc("z"), "term").limit(max_terms)
    return np.sort(np.array([r[0] for r in best.select("term").collect()], dtype=np.int64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 6000, max_terms: int = 20_000, min_z: float = 3.0, factors: int = 4) -> Model:
    """Learns from at most per_class labelled documents of each class, those of least hash of the id among the rows to learn
    from; their class weights restore the share that each class has among all labelled rows.

    Terms are counted by class on the executors. The telling ones, max_terms at most, and where they stand in the sampled
    documents are all that reaches the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter(F.col(label_col).isin(0, 1) & learned_rows(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    size = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = Window.partitionBy("_label").orderBy(F.shiftrightunsigned(F.xxhash64("_id"), 11), "_id")
    chosen = thinned(known, per_class).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= per_class).select("_id", "_label")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hashed_terms(t) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))], names=["_key", "_label", "terms"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_id").select(F.xxhash64("_id").alias("_key"), "_label", "_t")
    # rows that share an id and a label are one example, so that an id on many rows weighs no more than others
    lists = cut(rows.mapInArrow(listed, "_key bigint, _label int, terms array<int>").groupBy("_key", "_label").agg(F.min("terms").alias("terms")))
    read = {r["_label"]: r["n"] for r in lists.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    terms = telling_terms(lists, read.get(1, 0), read.get(0, 0), max_terms, min_z)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.intersect1d(np.asarray(x.values, dtype=np.int64), terms, assume_unique=True).astype(np.int32) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["_key", "_label", "terms"])

    table = lists.mapInArrow(kept, "_key bigint, _label int, terms array<int>").toArrow().sort_by([("_key", "ascending"), ("_label", "ascending")])
    held = table.column("terms").combine_chunks()
    flat, offsets = np.asarray(held.flatten()), np.concatenate([[0], np.cumsum([len(x) for x in held])])
    own = np.asarray(table.column("_label"), dtype=np.int64)
    weight = {k: n / max(int((own == k).sum()), 1) for k, n in size.items()}
    return train([flat[offsets[i] : offsets[i + 1]] for i in range(len(own))], own, np.array([weight[int(k)] for k in own]), factors)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns named by keep) with `score` (0 to 1) of each whole text.

    Null and empty texts have no terms and score as the bias says. Repeated rows, and texts of equal terms, get equal scores.
    A very long text counts by its distinct terms, all of them. An empty table gives no rows. An own column of that name is
    replaced, other columns pass through.
    """
    spark = docs.sparkSession
    small_batches(spark)
    new = {"score": "double"}
    own = [c for c in (docs.columns if keep is None else keep) if c not in new]
    given, at, schema = widened(docs, own, new, text_col)
    shared = spark.sparkContext.broadcast(model)  # max_terms rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        rows = Rows(held.terms)
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                met: set[int] = set()
                for w in set(_WORD.findall((t or "").lower())):
                    if found := rows[w]:
                        met.update(found)
                out.append(held.score(np.array(sorted(met), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(own))], pa.array(out, pa.float64())], names=[*own, *new])

    return given.mapInArrow(run, schema)
