"""Line deduplication: a line that spreads over many distinct sites is boilerplate and stays in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 10
#: log2 of the sketch's registers, and the relative distance from the threshold within which sites are counted exactly.
LG_K, BAND = 11, 0.2


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\x0b\f\r"))


def line_hashes(text: Column) -> Column:
    """A hash of each line without its outer blanks; null for a blank line."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(stripped(x) != "", F.xxhash64(stripped(x))))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(_id, _key, _site, _lines) of every row with a text: its id, hash of the text, site, and the hashes of its lines in order
    (null for a blank one). It is cut, as all later steps read it in place of the texts.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_key"), F.col(site_col).cast("string").alias("_site"), line_hashes(F.col(text_col)).alias("_lines"))
    return cut(rows.filter(F.col("_lines").isNotNull()))


def spread(held: DataFrame) -> DataFrame:
    """(_line, _n, _first, _sites): documents that hold a line, the least id of them, and about how many distinct sites it is on.

    Each task sketches the sites of its own lines, and the sketches merge as they meet, so a line on a third of all pages
    moves as one row a task. A row without a site adds to no line's spread.
    """
    each = held.select("_id", "_site", F.explode(F.array_compact(F.array_distinct("_lines"))).alias("_line"))
    return each.groupBy("_line").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"), F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(LG_K))).alias("_sites"))


def widespread(held: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(_line, _n, _first): the lines of a line_table() on min_sites distinct sites or more.

    A line whose sketch lies over BAND above the threshold is one, and one over BAND below it isn't; for those between
    alone, the distinct pairs of line and site are made and counted.
    """
    total = held.agg(F.sum(F.size("_lines"))).first()[0] or 0
    likely = cut(spread(held).filter(F.col("_sites") >= min_sites * (1 - BAND)))
    is_sure = F.col("_sites") > min_sites * (1 + BAND)
    near = likely.filter(~is_sure).select("_line", "_n", "_first")
    each = held.filter(F.col("_site").isNotNull()).select("_site", F.explode(F.array_compact(F.array_distinct("_lines"))).alias("_line"))
    pairs = hot_join(each, near.select("_line", "_n"), "_line", "_n", total).distinct()
    exact = pairs.groupBy("_line").agg(F.count(F.lit(1)).alias("_exact")).filter(F.col("_exact") >= min_sites)
    return cut(likely.filter(is_sure).select("_line", "_n", "_first").unionByName(near.join(exact.select("_line"), "_line", "left_semi")))


def without_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """One row per row of docs: `row` (all its columns, as a struct), `clean` (its text without boilerplate), n_lines, n_removed.

    A line counts without outer blanks; blank lines always stay. A widespread line stays in the document of least id
    and goes from all others, so that no line leaves the corpus altogether. Null texts stay null and have no
    lines; documents left without text stay as rows. Rows are found again by id and text, so that repeated ids do no
    harm, and columns of any name pass through inside `row`. An empty table gives no rows. A very long text is one array of
    hashes, 8 bytes a line.

    Lines are told apart by 64-bit hashes that aren't compared with the texts: a line goes wrongly if its hash is that of a
    widespread one, which for 10^6 of these and 10^10 distinct lines happens to one line with a chance of 0.05 %.
    """
    held = line_table(docs, id_col, text_col, site_col)
    flagged = widespread(held, min_sites)
    total = held.agg(F.sum(F.size("_lines"))).first()[0] or 0
    each = held.select("_id", "_key", F.posexplode("_lines").alias("_at", "_line")).filter("_line is not null")
    hits = hot_join(each, flagged, "_line", "_n", total).filter(~F.col("_id").eqNullSafe(F.col("_first"))).groupBy("_id", "_key").agg(F.collect_set("_at").alias("_gone")).select(F.col("_id").alias("_id2"), F.col("_key").alias("_key2"), "_gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_key"))
    both = rows.join(hits, rows["_id"].eqNullSafe(hits["_id2"]) & (rows["_key"] == hits["_key2"]), "left")
    split = both.select("row", "_gone", F.split(F.col("row")[text_col], "\n").alias("_lines"))
    stay = F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))), lambda i: F.get(F.col("_lines"), i))
    clean = F.when(F.col("_gone").isNull(), F.col("row")[text_col]).otherwise(F.concat_ws("\n", stay))
    return split.select("row", clean.alias("clean"), F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
