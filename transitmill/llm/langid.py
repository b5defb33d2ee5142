"""Language identification by compression: the dictionary that makes a text smallest names its language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, widened

UNKNOWN = "und"
#: Letters that are compressed at once. A dictionary saves little beyond them, so the lead's share of a whole long text would shrink with its length.
WINDOW = 20_000
_OTHER = re.compile(r"[\W\d_]+")


def learned_rows(id_col: str = "doc_id") -> Column:
    """Rows to learn from: those whose crc32 of the id as text isn't 2 modulo 4."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2


def thinned(ids: DataFrame, per_label: int, count: Column | None = None) -> DataFrame:
    """(_id, _label): of a label with more than four times per_label rows, the part of them with the least hashes, about four
    times per_label. So the rows that are ranked in one task stay as few however many tasks read the table. One row a label is
    collected. `count` says what counts in place of rows, such as ids.
    """
    size = {r["_label"]: r["n"] for r in ids.groupBy("_label").agg((F.count(F.lit(1)) if count is None else count).alias("n")).collect()}
    share = F.lit(1.0)
    for label, n in sorted(size.items()):
        if n > 4 * per_label:
            share = F.when(F.col("_label") == F.lit(label), F.lit(4.0 * per_label / n)).otherwise(share)
    return ids.filter((F.shiftrightunsigned(F.xxhash64("_id"), 11) / float(1 << 53)) < share) if size else ids


def letters(text: str) -> str:
    """The text in lower case, with everything between letters, and signs that stand for numbers, as one space."""
    return _OTHER.sub(" ", text.lower()).strip()


@dataclass(frozen=True)
class Model:
    """languages and their raw dictionaries, and the margin (share of the runner-up's bytes) under which a text is rejected."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = 6
    min_margin: float = 0.004


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", docs_per_language: int = 400, chars_per_doc: int = 1000, dictionary_bytes: int = 110_000, min_margin: float = 0.004) -> Model:
    """A dictionary for each label, from a bounded sample: docs_per_language ids in the order of their hash, and from each the middle
    chars_per_doc letters of its text, of the least text if an id has several. The sample is chosen over ids and labels
    alone; only its texts are read, and one piece of an id and a label reaches the driver.
    """
    own = rows.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    ranked = thinned(own, docs_per_language, F.approx_count_distinct("_id")).distinct()
    first = Window.partitionBy("_label").orderBy(F.shiftrightunsigned(F.xxhash64("_id"), 11), "_id")
    chosen = ranked.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= docs_per_language).select("_id").distinct()
    ids = [r[0] for r in chosen.collect()]
    piece = F.substring(F.col(text_col), F.greatest(F.lit(1), F.floor(F.length(text_col) / 2).cast("int") - chars_per_doc), F.lit(2 * chars_per_doc))
    few = rows.filter(F.col(id_col).isin(ids) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    texts = few.groupBy(F.col(label_col).alias("_label"), F.col(id_col).alias("_id")).agg(F.min(piece).alias("_text")).collect()
    parts: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r["_label"], r["_id"], r["_text"])):
        if own := letters(r["_text"])[:chars_per_doc]:
            parts.setdefault(r["_label"], []).append(own)
    held = []
    for label, own in sorted(parts.items()):
        share = max(200, dictionary_bytes // len(own))
        held.append((label, " ".join(x[:share] for x in own).encode()[-dictionary_bytes:]))
    return Model(tuple(held), min_margin=min_margin)


@lru_cache(maxsize=2)
def _compressors(model: Model) -> list:
    import zstandard

    out = []
    for label, raw in model.dictionaries:
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=model.level)
        out.append((label, zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def identify(text: str | None, model: Model) -> tuple[str, float, bool]:
    """(language, score, rejected). The score is the logistic of the bytes that the runner-up needs more: 0.5 for a tie.

    Each WINDOW of the whole text is compressed by itself, and a language's sizes are summed, so the margin doesn't depend on length.
    """
    own = letters(text or "")
    if not model.dictionaries or not any(map(str.isalpha, own)):
        return UNKNOWN, 0.0, True
    raw = [own[i : i + WINDOW].encode() for i in range(0, len(own), WINDOW)]
    sizes = sorted((sum(len(c.compress(x)) for x in raw), label) for label, c in _compressors(model))
    best = sizes[0]
    if len(sizes) == 1:
        return best[1], 1.0, False
    gap = sizes[1][0] - best[0]
    return best[1], 1 / (1 + 2.0 ** -min(gap, 60)), gap < max(1, model.min_margin * sizes[1][0])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns named by keep) with lang_pred, score and rejected, from the whole text alone.

    A null text, or one without a letter, is `und`, has score 0 and is rejected; a tie is rejected too. Repeated rows get the
    same answer, a very long text is compressed window by window, an empty table gives no rows. Other columns pass through, unless they bear one of the three names: those are replaced.
    """
    small_batches(docs.sparkSession)
    new = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    own = [c for c in (docs.columns if keep is None else keep) if c not in new]
    given, at, schema = widened(docs, own, new, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [identify(t, model) for t in b.column(at).to_pylist()]
            cols = [b.column(i) for i in range(len(own))] + [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*own, *new])

    return given.mapInArrow(run, schema)
