"""Byte-level BPE against tiktoken, offsets against the bytes, and decoding as an exact round trip."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from transitmill.llm import bytebpe
from transitmill.llm.queries import RANKS, op13_byte_bpe, tokenizer_path

PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id bigint, text string, n_tokens string, ids string, _id string, part string"


@pytest.fixture(scope="module")
def ranks():
    with open(tokenizer_path(RANKS), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def other(ranks):
    return tiktoken.Encoding("other", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bytebpe.load(tokenizer_path(RANKS), PATTERN)


def odd_texts(seed=5, n=3000):
    rng = random.Random(seed)
    pools = [range(0x20, 0x7F), range(0x300), range(0x300, 0x3000), range(0x3000, 0xD800), range(0xE000, 0x11000), range(0x10000, 0x110000), [0x20, 0x0A, 0x09, 0xA0, 0x3000, 0x85, 0x1C, 0x1F, 0x61, 0x27, 0x73]]
    made = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*made, "", " ", "\x00\x00", "don't we'LL  \n\n x", "<|endoftext|>", "½ Ⅷ ①", "é 👩‍👩‍👧", "a" * 70_000, " " * 70_000 + "x", "漢字" * 40_000, "ab  \n" * 30_000, "é\x85" * 40_000, "x\x1cy " * 30_000]


def test_ids_equal_those_of_the_other_library(own, other):
    texts = odd_texts()
    got = [[] for _ in texts]
    for k, pieces in own.encode(texts):
        got[k] += [i for p in pieces for i in p[0]]
    for text, ids in zip(texts, got, strict=True):
        assert ids == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_every_token_has_the_pair_of_its_last_merge(ranks):
    assert bytebpe.merge_pair(b"abc", {b"ab": 1, b"abc": 2, b"bc": 3}) == (b"ab", b"c")
    assert bytebpe.merge_pair(b"abcd", {b"bc": 1, b"abcd": 9}) is None
    longer = [t for t in ranks if len(t) > 1]
    assert all(a + b == t for t in longer[:5000] for a, b in [bytebpe.merge_pair(t, ranks)])


def test_classes_agree_where_python_splits():
    safe = "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if not bytebpe._UNSURE.search(c))
    assert len(safe) > 30_000
    for kind in (r"\p{L}", r"\p{N}", r"\s", r"\S", r"[^\s\p{L}\p{N}]", r"[\p{N}x]"):
        seen = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        assert set(bytes(seen.encode_ordinary(safe)).decode()) == set(bytebpe.own_pattern(kind).findall(safe))


def test_decoding_in_parts_puts_split_characters_together(own):
    text = "naïve 漢字 👩‍👩‍👧 𝔘𝔫𝔦 " * 20
    ids = [i for _, pieces in own.encode([text]) for p in pieces for i in p[0]]
    assert "".join(own.decode_text([i] for i in ids)) == text
    assert any(b"\xff" not in own.token_bytes[i] and own.token_bytes[i].decode(errors="replace").count("�") for i in ids)
    assert "".join(own.decode_text([own.library.token_to_id("ð") and [own.library.token_to_id("ð")]])) == "�"


def test_offsets_hold_the_characters_of_each_token(own):
    for text in odd_texts(7, 200):
        split = 0
        for ids, starts, ends in own.spans(text):
            before = 0
            for i, lo, hi in zip(ids, starts, ends, strict=True):
                held = text[lo:hi].encode()
                assert own.token_bytes[i] in held and lo < hi
                split += lo < before
                before = hi
        assert split == sum(p[2] for _, pieces in own.encode([text]) for p in pieces)


def test_rows_and_digests(spark, other):
    rows = [(i, t) for i, t in enumerate(odd_texts(9, 300))] + [(None, "null id"), (4000, None), (4001, "twice"), (4001, "twice")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, bytebpe.encoded(docs, tokenizer_path(RANKS), PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "part").collect()), key=str)
    want = []
    for i, t in rows:
        ids = other.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), "w"))
    assert got == sorted(want, key=str)
    parts = bytebpe.tokens(docs, tokenizer_path(RANKS), PATTERN)
    back = {}
    for r in bytebpe.detokenized(parts.filter("_id < 4000"), tokenizer_path(RANKS), PATTERN).collect():
        back.setdefault(r["_id"], {})[r["part"]] = r["text"]
    assert {i: "".join(t for _, t in sorted(x.items())) for i, x in back.items()} == {i: t for i, t in rows if i is not None and i < 4000 and t}
    assert bytebpe.encoded(docs.limit(0), tokenizer_path(RANKS), PATTERN).count() == 0


def test_query_over_the_whole_table(spark, other):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    got = op13_byte_bpe(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"] for r in got} == set(docs)
    for r in got:
        ids = other.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
