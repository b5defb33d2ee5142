"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running, shuffle_parts, words

#: Hashes kept in a sketch, and words in a shingle.
K, WIDTH = 256, 5
_SPAN = float(2**64)
#: Bytes of text in a range of ids, about, and ranges at most.
RANGE_BYTES, MAX_RANGES = 64 << 20, 20_000


def shingle_hashes(word_hashes: Column, width: int = WIDTH) -> Column:
    """Hash of every window of `width` words, from the hashes of the words; of the whole sequence if it is shorter."""
    n = F.size(word_hashes)
    window = lambda i: F.xxhash64(*[F.get(word_hashes, i + j) for j in range(width)])
    short = F.aggregate(word_hashes, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x))
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), window)).when(n > 0, F.array(short)).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    """The k least distinct hashes, ascending: the sketch."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: Column, out: str, width: int = WIDTH, k: int = K) -> DataFrame:
    """df and the sketch of a text. Each step is a projection of its own, so that arrays are made once a row."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    step = df.select(*cols, F.transform(words(text), lambda w: F.xxhash64(w)).alias("_words"))
    return step.select(*cols, bottom(shingle_hashes(F.col("_words"), width), k).alias(out))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the merged sketch's hashes that are in both. Two empty ones agree."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in the range."""
    place = (F.element_at(sketch, -1).cast("double") + _SPAN / 2) / _SPAN
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / F.greatest(place, F.lit(1e-18)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are in b: resemblance times the union's size over a's."""
    share = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / F.greatest(distinct_shingles(a, k), F.lit(1.0))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def hex_string(sketch: Column) -> Column:
    """The sketch as text: the hashes as 16 hexadecimal digits each, joined by nothing."""
    return F.concat_ws("", F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def merge_groups(df: DataFrame, group_cols: list[str], sketch_col: str, k: int = K, salts: int = 32) -> DataFrame:
    """One sketch for each group. Groups are merged in two steps, first per salt, so that a hot one is spread out.

    A hash among the k least of a group is among the k least of its part, so nothing is lost. Every step drops repeated
    hashes before they move.
    """
    each = df.select(*group_cols, F.explode(sketch_col).alias("_h")).distinct()
    parts = each.withColumn("_salt", F.pmod(F.xxhash64("_h", F.lit(7)), F.lit(salts)))
    least = Window.partitionBy(*group_cols, "_salt").orderBy("_h")
    kept = parts.withColumn("_r", F.row_number().over(least)).filter(F.col("_r") <= k)
    return kept.groupBy(*group_cols).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(sketch_col))


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(_id, _text, _tie, _bucket, _tail): every document in a range of its own, with `_tail` false, and the first one of each
    range again in the range before it, with `_tail` true. So each document's successor lies in its own range.

    Ranges are runs of (id, hash of the text) of equal bytes, cut by global prefix sums over a narrow table; their number grows
    with the data, up to MAX_RANGES. The first document's id and hash, one row a range, are all that reaches the driver. Each
    range is one partition, and the text moves once. The successor of the last document is the first one; null ids come
    first, and rows of equal id are split like others; null texts are empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(text).alias("_tie")]
    narrow = cut(docs.select(*own, F.octet_length(text).cast("long").alias("_size")).withColumn("_size", F.col("_size") + 64))
    total = narrow.agg(F.sum("_size")).first()[0] or 1
    n = parts or min(MAX_RANGES, max(3 * shuffle_parts(docs.sparkSession), -(-total // RANGE_BYTES)))
    placed = running(narrow, [F.col("_id").asc_nulls_first(), F.col("_tie")], {"_before": "_size"})
    firsts = placed.groupBy(F.expr(f"_before * {n} div {total}").alias("_b")).agg(F.min(F.struct("_id", "_tie")).alias("_m"))
    marks = [(r["_m"]["_id"], r["_m"]["_tie"]) for r in firsts.orderBy("_b").collect()]
    # equal marks, of many equal rows, are one range
    marks = [m for k, m in enumerate(marks) if not k or m != marks[k - 1]]
    rows = docs.select(*own, text.alias("_text")).withColumn("_at", F.struct("_id", "_tie")).withColumn("_bucket", in_range(F.col("_at"), marks))
    here, before = F.struct(F.col("_bucket"), F.lit(False).alias("_tail")), F.struct(F.pmod(F.col("_bucket") - 1, F.lit(max(len(marks), 1))).alias("_bucket"), F.lit(True).alias("_tail"))
    places = F.when(F.col("_at") == mark(marks, F.col("_bucket")), F.array(here, before)).otherwise(F.array(here))
    return rows.select("_id", "_tie", "_text", F.explode(places).alias("_place")).select("_id", "_tie", "_text", "_place.*").repartitionById(max(len(marks), 1), F.col("_bucket"))


def blocks(marks: list[tuple]) -> tuple[Column, int]:
    """The marks as one literal of blocks of about sqrt(n) each, and a block's size."""
    step = max(1, int(len(marks) ** 0.5))
    held = [[{"_id": i, "_tie": t} for i, t in marks[k : k + step]] for k in range(0, len(marks), step)]
    return F.from_json(F.lit(json.dumps(held)), "array<array<struct<_id:bigint,_tie:bigint>>>"), step


def in_range(value: Column, marks: list[tuple]) -> Column:
    """The number of the range that a struct (_id, _tie) lies in: how many of the ascending marks after the first are at most
    the value, looked up in two steps of about sqrt(n) each."""
    if len(marks) < 2:
        return F.lit(0)
    held, step = blocks(marks)
    at_most = lambda xs: F.size(F.filter(xs, lambda m: m <= value))
    block = F.greatest(at_most(F.transform(held, lambda x: F.get(x, 0))) - 1, F.lit(0))
    return F.greatest(block * step + at_most(F.get(held, block)) - 1, F.lit(0))


def mark(marks: list[tuple], at: Column) -> Column:
    """The at-th mark."""
    if not marks:
        return F.lit(None)
    held, step = blocks(marks)
    return F.get(F.get(held, F.floor(at / step).cast("int")), (at % step).cast("int"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = K) -> DataFrame:
    """One row per document: its id, text and sketch, those of its edited text, and how alike they and the next one's are.

    The edited text has the last floor(n / 2) of n code points replaced by the first as many (or all) of the next document
    in ascending id. Equal ids are ordered by a hash of the text. A text of fewer than `width` words is one shingle; one
    without words has an empty sketch, which is alike only to another empty one. An empty table gives no rows.
    """
    own = with_sketch(beside_next(docs, id_col, text_col), F.col("_text"), "_sketch", width, k)
    order = Window.partitionBy("_bucket").orderBy("_tail", F.col("_id").asc_nulls_first(), "_tie")
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    paired = own.select("_id", "_text", "_sketch", "_tail", F.lead("_text").over(order).alias("_next"), F.lead("_sketch").over(order).alias("_next_sketch")).filter(~F.col("_tail"))
    edited = paired.select("_id", "_text", "_sketch", "_next_sketch", F.concat(F.substring("_text", F.lit(1), n - half), F.substring("_next", F.lit(1), half)).alias("_edited"))
    both = with_sketch(edited, F.col("_edited"), "_edited_sketch", width, k)
    return both.select("_id", "_text", "_edited", "_sketch", "_edited_sketch", resemblance(F.col("_sketch"), F.col("_edited_sketch"), k).alias("near_edited"), resemblance(F.col("_sketch"), F.col("_next_sketch"), k).alias("near_next"))
