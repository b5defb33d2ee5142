"""The pipeline on a small table with planted cases, stage by stage, and the queries' contracts."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from transitmill.llm import bpe, queries

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "re", "so"], "bb": ["sch", "ein", "ung", "lich", "ver", "an"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(17)
    prose = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = []
    for i in range(240):
        lang = "aa" if i % 3 else "bb"
        rows.append((i, "\n".join([prose(lang, 25), "All of this may be used freely by anyone." if i % 5 else "", prose(lang, 40)]), lang, f"s{i % 12}"))
    rows += [(1000 + i, rows[5][1] + ("" if i % 2 else " extra"), "aa", "s1") for i in range(30)]
    rows += [(2000, None, "aa", "s1"), (2001, "", "bb", None), (2002, "123 456", "aa", "s2"), (2003, " \n ", None, "s3"), (5, rows[5][1], "aa", "s5")]
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(0, 240, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(i, rows[i][1][:80]) for i in range(9)] + [(9, None)], "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def stage(spark, name, docs, folder, where):
    out = dict(cp.STAGES)[name](spark, docs, folder)
    out.write.parquet(where)
    return spark.read.parquet(where)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_of(rows):
    """The least id of each group of chained near copies, by comparing all pairs."""
    sets, root = [shingles(r.text or "") for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return set(least.values())


def test_rows_of_one_id_in_two_sources_and_repeated_rows(spark, folder):
    text = lambda n: " ".join(f"w{n}x{k}" for k in range(10))
    rows = [(i, text(i), "aa", f"s{i % 3}", 5) for i in range(60)] + [(1, text(1), "aa", "s2", 5), (1, text(99), "aa", "s1", 5)] + [(7, text(7), "aa", "s1", 5)] * 4 + [(None, text(70), "aa", None, 5), (80, None, "aa", "s1", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    plan = cp.mixing.mix(docs, tie=F.xxhash64("text")).collect()
    want = defaultdict(int)
    for r in plan:
        want[r.doc_id, r.source] += (2 * r.taken + r["size"]) // (2 * r["size"]) if r["size"] else 0
    got = Counter((r.doc_id, r.source) for r in cp.mix_sources(spark, docs, folder).collect())
    assert got == {k: n for k, n in want.items() if n}


def test_odd_tables(spark, folder):
    """Extra columns of clashing names, nulls in any column, and a very long text, in every stage."""
    rng = random.Random(3)
    prose = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    names = ["doc_id bigint", "text string", "lang string", "source string", "n_chars bigint"]
    clash = ["row", "rejected", "lang_pred", "score", "clean", "_id", "_key", "_text", "_n", "_row", "size", "taken", "_tie", "fp", "root", "held", "n", "n_tokens", "a.b"]
    rows = [(i, prose("aa" if i % 2 else "bb", 60), "aa" if i % 2 else "bb", f"s{i % 12}", 7) for i in range(40)]
    rows += [(None, prose("aa", 50), None, None, None), (50, None, None, "s1", None), (51, prose("bb", 200_000), "bb", "s2", 1), (52, "", "aa", None, 0), (3, rows[3][1], "aa", "s3", 7)]
    docs = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in clash]) for r in rows], ", ".join([*names, *[f"`{c}` string" for c in clash]])).repartition(5)
    for name, f in cp.STAGES:
        out = f(spark, docs, folder)
        if name == "bpe":
            assert out.count() == len(rows)
            continue
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r["a.b"] == f"a.b{r.doc_id}" and r["row"] == f"row{r.doc_id}" for r in got), name
        assert any(r.doc_id == 51 for r in got) or name == "mix_sources", name


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    first = stage(spark, "language_id", docs, folder, f"{tmp_path}/0")
    gone = {r.doc_id for r in docs.select("doc_id").subtract(first.select("doc_id")).collect()}
    assert gone == {2000, 2001, 2002, 2003} and first.columns == columns

    second = stage(spark, "line_dedup", first, folder, f"{tmp_path}/1")
    before = first.collect()
    sites, least = defaultdict(set), {}
    for r in before:
        for x in r.text.split("\n"):
            if y := x.strip(" \t\x0b\x0c\r"):
                sites[y].add(r.source)
                least[y] = min(least.get(y, r.doc_id), r.doc_id)
    clean = lambda r: "\n".join(x for x in r.text.split("\n") if not (x.strip() and len(sites[x.strip()]) >= 10 and least[x.strip()] != r.doc_id))
    assert Counter((r.doc_id, r.text, r.n_chars) for r in second.collect()) == Counter((r.doc_id, clean(r), len(clean(r))) for r in before)
    assert second.filter(F.col("text").contains("may be used freely")).count() == 1

    third = stage(spark, "simhash_near_dedup", second, folder, f"{tmp_path}/2")
    assert {r.doc_id for r in third.collect()} == kept_of(second.collect()) and third.columns == columns
    assert third.count() == len({r.doc_id for r in third.collect()})
    assert not {r.doc_id for r in third.collect()} & set(range(1000, 1030))

    fourth = stage(spark, "mix_sources", third, folder, f"{tmp_path}/3")
    plan = {r.doc_id: r for r in cp.mixing.mix(third).collect()}
    copies = Counter(r.doc_id for r in fourth.collect())
    words = re.compile(r"[^\x20\x09-\x0D]+")
    for i, r in plan.items():
        assert copies[i] == ((2 * r.taken + r["size"]) // (2 * r["size"]) if r["size"] else 0) <= 3
    taken, target = defaultdict(int), {r.source: r.target for r in plan.values()}
    for r in fourth.collect():
        taken[r.source] += len(words.findall(r.text))
    longest = max(r["size"] for r in plan.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in target)
    assert fourth.columns == columns

    last = cp.encode(spark, fourth, folder).collect()
    tokenizer = bpe.load(queries.tokenizer_path())
    texts = {r.doc_id: r.text for r in fourth.collect()}
    assert len(last) == fourth.count()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == bpe.digests(tokenizer, texts[r.doc_id]) for r in last)


def test_run_equals_its_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, f) in enumerate(cp.STAGES):
        f(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert Counter(map(tuple, cp.run(spark, folder).collect())) == Counter(map(tuple, docs.collect()))


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, f in cp.STAGES:
        assert f(spark, docs, folder).count() == 0


def test_every_operator_is_registered(spark, folder):
    held = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} <= {f"{n.split('_')[0]}_" for n in held} and "pipeline" in held
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = Counter(r.doc_id for r in docs.collect())
    for name, f in queries.queries().items():
        if name == "op11_divergence":  # its rows are sources, not documents
            continue
        assert Counter(r.doc_id for r in f(spark, folder).collect()) == ids, name
