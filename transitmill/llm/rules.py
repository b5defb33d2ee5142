"""Quality rules: a short-circuit cascade, ordered by measured rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, words

#: Rows that the order of the rules is estimated on, about.
SAMPLE_ROWS = 500
SYMBOLS = "#*$%&|<>"
#: Bits of a window's hash that are compared before its words are.
HASH_BITS = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row and only where the expression is."""
    return F.get(F.transform(F.array(value), body), 0)


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one, as they are."""
    return let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def covered(places: Column) -> Column:
    """Words in 3-word windows that begin at the places (ascending)."""
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(3).cast("long"))).alias("n")), lambda a: a["n"])


def n_repeat_words(ws: Column, hash_bits: int = HASH_BITS) -> Column:
    """Words that stand in a 3-word window found twice or more, the first time included.

    Each window's hash and place are packed into one long, as few low bits as the text's length needs hold the place, and
    sorted. Neighbours of equal hash are compared word by word; a text in which two that differ share a hash is counted
    anew with the words themselves as the key, so the count is exact.
    """
    call = F.call_function
    three = lambda i: F.struct(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    windows = F.sequence(F.lit(0), F.size(ws) - 3)

    def packed(hashes: Column, bits: Column) -> Column:
        own = lambda i: call("shiftleft", call("shiftrightunsigned", F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)), F.greatest(bits, F.lit(64 - hash_bits))), bits)
        return F.sort_array(F.transform(windows, lambda i: own(i).bitwiseOR(i.cast("long"))))

    def counted(at: Column, bits: Column) -> Column:
        key = lambda x: call("shiftrightunsigned", x, bits)
        place = lambda x: x.bitwiseAND(call("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
        after = lambda j: F.get(at, j + 1)
        clash = F.exists(F.sequence(F.lit(0), F.size(at) - 1), lambda j: (key(F.get(at, j)) == key(after(j))) & (three(place(F.get(at, j))) != three(place(after(j)))))
        twice = F.filter(at, lambda x, j: (key(x) == key(after(j))) | ((j > 0) & (key(x) == key(F.get(at, F.greatest(j - 1, F.lit(0)))))))
        return F.when(F.coalesce(clash, F.lit(False)), exactly()).otherwise(covered(F.sort_array(F.transform(twice, lambda x: place(x).cast("long")))))

    def exactly() -> Column:
        rows = F.sort_array(F.transform(windows, lambda i: F.struct(three(i).alias("w"), i.cast("long").alias("i"))))
        same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
        return let(rows, lambda r: covered(F.sort_array(F.transform(F.filter(r, lambda x, j: same(x, F.get(r, j + 1)) | ((j > 0) & same(x, F.get(r, F.greatest(j - 1, F.lit(0)))))), lambda x: x["i"]))))

    bits = F.greatest(F.ceil(F.log2(F.size(ws).cast("double") + 1)), F.lit(1)).cast("int")
    found = let(bits, lambda b: let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: let(packed(h, b), lambda at: counted(at, b))))
    return F.when(F.size(ws) >= 4, found).otherwise(F.lit(0)).cast("long")


#: What each measure is made of: the text (never null) and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, ws: F.size(ws).cast("long"),
    "word_chars": lambda text, ws: without(text, SPACE_CHARS).cast("long"),
    "n_symbols": lambda text, ws: (F.length(text) - without(text, SYMBOLS)).cast("long"),
    "n_dup_lines": lambda text, ws: n_dup_lines(text),
    "n_repeat_words": lambda text, ws: n_repeat_words(ws),
    "n_lettered": lambda text, ws: F.size(F.filter(ws, lambda w: w.rlike("\\p{L}"))).cast("long"),
    "n_shouted": lambda text, ws: F.size(F.filter(F.transform(ws, lambda w: F.regexp_replace(w, "[^\\p{L}]", "")), lambda w: (F.length(w) > 1) & (w == F.upper(w)))).cast("long"),
}
#: The measures that a verdict comes with.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule rejects a row for which `fails` holds; null counts as no. `fails` gets the row's measures by name."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


def standard_rules() -> list[Rule]:
    """Each rule names something that running prose doesn't do."""
    per_word = lambda m, part: m(part) / F.greatest(m("n_words"), F.lit(1))
    return [
        Rule("too_few_words", lambda m: m("n_words") < 50),
        Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
        Rule("symbols", lambda m: per_word(m, "n_symbols") > 0.2),
        Rule("repeated_lines", lambda m: 10 * m("n_dup_lines") > m("n_words")),
        Rule("word_length", lambda m: ~per_word(m, "word_chars").between(2, 20)),
        Rule("without_letters", lambda m: m("n_lettered") < 0.6 * m("n_words")),
        Rule("shouting", lambda m: m("n_shouted") > 0.5 * m("n_words")),
    ]


def opened(docs: DataFrame, text_col: str = "text", base: tuple[str, ...] = ()) -> DataFrame:
    """docs as one struct `row`, with `_text` (null as empty), `words`, and the measures in `base`, each made once."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    held = held.select("row", "_text", words(F.col("_text")).alias("words"))
    return held.select("row", "_text", "words", *[MEASURES[m](F.col("_text"), F.col("words")).alias(m) for m in base])


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs as one struct `row`, with the BASE measures, `words` and `_text`. Null texts have no words."""
    return opened(docs, text_col, BASE)


def measure_of(df: DataFrame) -> Callable[[str], Column]:
    """A measure's column if df has it, else the expression that makes it, which runs only where it is needed."""
    return lambda name: F.col(name) if name in df.columns else MEASURES[name](F.col("_text"), F.col("words"))


def order_rules(sample: DataFrame, rules: list[Rule], runs: int = 2) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected), by rejection per cost, best first. Every rule runs over the whole sample alone.

    `sample` is an opened() table without measures, so a rule's time is that of all it has to compute: the least of `runs`
    times, less what a job over the sample takes by itself.
    """
    m = measure_of(sample)

    def timed(fails: Column) -> tuple[float, float]:
        times, share = [], None
        for _ in range(runs):
            began = time.perf_counter()
            share = sample.agg(F.avg(F.coalesce(fails, F.lit(False)).cast("double"))).first()[0]
            times.append(time.perf_counter() - began)
        return min(times), share or 0.0

    timed(F.col("words").isNull())
    alone, found = timed(F.col("words").isNull())[0], []
    for rule in rules:
        took, share = timed(rule.fails(m))
        found.append((rule, max(took - alone, 1e-4), share))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(df: DataFrame, ordered: list[Rule], out: str = "failed_rule") -> DataFrame:
    """df (opened) and the first rule that each row fails (null: none). CASE evaluates a rule, with the measures that df doesn't
    have, only for rows that passed those before."""
    case, m = None, measure_of(df)
    for rule in ordered:
        case = F.when(rule.fails(m), F.lit(rule.name)) if case is None else case.when(rule.fails(m), F.lit(rule.name))
    return df.withColumn(out, case if case is not None else F.lit(None).cast("string"))


def sampled(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS, seed: int = 11) -> DataFrame:
    """The words of about `rows` rows from all over the table, each taken by chance, opened and cut."""
    n = docs.count()
    picked = docs.select(F.col(text_col).alias("_t")).filter(F.rand(seed) < min(1.0, rows / max(n, 1)))
    return cut(opened(picked, "_t").drop("row"))


def judged(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, base: tuple[str, ...] = BASE) -> DataFrame:
    """`row` (all columns of docs, as a struct), the measures in `base`, and `failed_rule`, the first failed one.

    The rules' order is estimated on a bounded sample; it changes what a row costs, never whether it passes. Measures that
    aren't in `base` are made only for rows that reach a rule which needs them: with base=() the cascade saves all that it can.
    Rules of equal rejection per cost go by name, so ties change nothing either. Repeated rows are judged alike; columns of
    any name pass through inside `row`; a very long text costs its own length (the sorted windows take 8 bytes a word). An
    empty table gives no rows.
    """
    rules = rules or standard_rules()
    sample = sampled(docs, text_col, sample_rows)
    ordered = [rule for rule, _, _ in order_rules(sample, rules)]
    return cascade(opened(docs, text_col, base), ordered).drop("words", "_text")
