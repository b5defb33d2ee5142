"""The corpus pipeline: documents of known language, without boilerplate lines or near copies, mixed by source and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitmill.llm import bpe, copies, langid, lines, mixing
from transitmill.llm.common import table
from transitmill.llm.queries import tokenizer_path
from transitmill.sources.shared import delete, shared_folder

#: Language models and the tokenizer aren't SQL.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear stay; a text without letters, null ones among them, or with near-equal sizes under two
    languages, goes. Repeated rows fare alike, other columns pass through whatever their names, an empty table stays empty."""
    model = langid.fit(docs.filter(langid.learned_rows()))
    own = [f"_c{k}" for k in range(len(docs.columns))]
    held = langid.predict(docs.toDF(*own), model, own[docs.columns.index("text")]).filter(~F.col("rejected"))
    return held.select(*own).toDF(*docs.columns)


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, null and empty texts too; lines on many sites stay in one document only. n_chars follows the text."""
    out = lines.without_boilerplate(docs)
    changed = {"text": F.col("clean"), "n_chars": F.when(F.col("n_removed") > 0, F.length("clean").cast("long")).otherwise(F.col("row")["n_chars"])}
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity of 0.8 or more, every pair. Its
    first candidates are the SimHash classes. Texts without words are one group; ties go to the least id, null first."""
    return copies.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes its words, in whole copies; those that it doesn't reach, and those without
    words, go. Rows that agree in id, source and text come as often as all of them together, as the first of them."""
    key = F.xxhash64(F.col("text"))
    taken = mixing.mix(docs, tie=key)
    per_row = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("_tie").alias("_text"), mixing.copies(F.col("taken"), F.col("size")).alias("_n"))
    per_row = per_row.filter("_n > 0").groupBy("_id", "_source", "_text").agg(F.sum("_n").alias("_n"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_i"), F.col("source").alias("_s"), key.alias("_t"))
    held = rows.join(per_row, rows["_i"].eqNullSafe(per_row["_id"]) & rows["_s"].eqNullSafe(per_row["_source"]) & (rows["_t"] == per_row["_text"]))
    one = held.dropDuplicates(["_i", "_s", "_t"])
    return one.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every text (null: empty), as digests of the ids and of the decoded text beside the document's columns."""
    return bpe.encoded(docs, tokenizer_path(), keep=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_spread_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again. What a stage wrote is deleted once the next
    one is written; the last folder stays, as the result is read from it."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
