"""The registered queries over these operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, bpe, bytebpe, divergence, langid, lines, mixing, resample, rules, secrets, shards, simhash, toxicity
from .common import table

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.learned_rows()
    model = langid.fit(docs.filter(learned))
    out = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (~learned).alias("held_out"), "lang_pred", "score", "rejected")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.find(docs, secrets.fit(docs), keep=["doc_id"])


def op3_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bottomk.edited_fingerprints(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), F.length("_text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), bottomk.hex_string(F.col("_sketch")).alias("fingerprint"), bottomk.hex_string(F.col("_edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.balanced_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", (~langid.learned_rows()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judged(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(F.col("row")["doc_id"].alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_boilerplate(table(spark, sf_dir, "documents"))
    return out.select(F.col("row")["doc_id"].alias("doc_id"), "n_lines", "n_removed", F.sha2(F.col("clean").cast("binary"), 256).alias("clean_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path(RANKS), public_tokenizers.PATTERN, keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_langid, op2_secrets, op3_bottomk, op4_shards, op5_mixing, op6_toxicity, op7_rules, op8_simhash, op9_line_spread, op10_bpe, op11_divergence, op12_resample, op13_byte_bpe)}


_BLANK = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

_OP5 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS wt, 3.0 * source_size AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(wt) OVER o, 0) AS wts FROM w
      WINDOW o AS (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(((SELECT sum(source_size) FROM s) - caps) / ((SELECT sum(wt) FROM w) - wts)) AS lvl FROM c),
t AS (SELECT source, source_size, least(cap, wt * lvl)::DOUBLE AS target FROM c, l),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (round(target)::BIGINT // source_size) * size
            + least(greatest(round(target)::BIGINT % source_size - before, 0), size) END::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""

_OP9 = f"""
WITH r AS (SELECT doc_id, source, text, i, trim(x, {_BLANK}) AS line FROM (
             SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
f AS (SELECT line, min(doc_id) AS first FROM r WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {lines.MIN_SITES}),
g AS (SELECT r.*, (f.line IS NOT NULL AND r.doc_id <> f.first) AS gone FROM r LEFT JOIN f USING (line)),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM g GROUP BY doc_id),
x AS (SELECT d.doc_id, string_agg(u.x, chr(10) ORDER BY u.i) AS clean FROM documents d
      JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) u USING (doc_id)
      JOIN g ON g.doc_id = u.doc_id AND g.i = u.i AND NOT g.gone GROUP BY d.doc_id)
SELECT doc_id, o.n_lines::BIGINT AS n_lines, o.n_removed::BIGINT AS n_removed, sha256(coalesce(x.clean, '')) AS clean_sha256 FROM o LEFT JOIN x USING (doc_id)
"""


_OP7 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM k, (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS lettered,
             len(list_filter(list_transform(w, lambda x: regexp_replace(x, '[^\p{L}]', '', 'g')), lambda x: length(x) > 1 AND x = upper(x))) AS shouted
      FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols / greatest(n_words, 1) > 0.2 OR 10 * n_dup_lines > n_words OR word_chars / greatest(n_words, 1) NOT BETWEEN 2 AND 20
            OR lettered < 0.6 * n_words OR shouted > 0.5 * n_words) AS kept FROM f
"""


_OP11 = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, i, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
y AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own, sum(n) OVER (PARTITION BY lang, term) AS m, sum(n) OVER (PARTITION BY lang) AS every FROM x),
p AS (SELECT y.lang, source, term, n, 1 + (1000000000 * (n + 5)) // (own::HUGEINT + 5 * v) AS p, 1 + (1000000000 * (m::HUGEINT + 5)) // (every::HUGEINT + 5 * v) AS q FROM y JOIN v ON v.lang = y.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": _OP5, "op7_rules": _OP7, "op9_line_spread": _OP9, "op11_divergence": _OP11}
