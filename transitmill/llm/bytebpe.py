"""Byte-level BPE from a rank file: the tokenizers library over Arrow batches, bytes as stand-in characters, offsets, and decoding."""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache, reduce
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import small_batches, widened

#: Characters of a text that are encoded at a time, at least, and of a call to the library.
BLOCK, CALL = 1 << 16, 1 << 18
#: Pieces that are remembered, in each of two generations; those of a call come on top.
KEPT = 200_000
#: Where a text may be cut: no match of the pattern holds a white-space character behind another one, and none looks back.
_EDGE = re.compile(r"(?<=[^\s\x1c-\x1f])[^\S\x1c-\x1f]")
#: Characters outside the ranges in which the library's Unicode tables and Python's are held to agree (by a test).
_UNSURE = re.compile("[^\u0000-\u0557\u1e00-\u1eff\u2000-\u2064\u20a0-\u20bf\u2100-\u218b\u2190-\u23ff\u3040-\u3096\u3099-\u30ff\u4e00-\u9fef\uac00-\ud7a3]")


def merge_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the last merge into token joins, or None if merges by rank, leftmost first, don't make it.

    Whatever stands beside it in a piece, a token comes from these two parts alone: no merge crosses its borders before it is
    whole, so inside them the merges are those of the token by itself.
    """
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def own_pattern(pattern: str) -> re.Pattern[str]:
    """The pattern for Python's own engine, over characters that aren't unsure: classes of letters, numbers and white space are written
    out, in brackets as well as alone."""
    names: dict[str, list[list[int]]] = {"L": [], "N": [], "Z": []}
    for code in range(0xD800):
        if _UNSURE.match(c := chr(code)):
            continue
        kind = "Z" if c.isspace() and not "\x1c" <= c <= "\x1f" else unicodedata.category(c)[0]
        if kind in names and names[kind] and names[kind][-1][1] == code - 1:
            names[kind][-1][1] = code
        elif kind in names:
            names[kind].append([code, code])
    spans = {k: "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in v) for k, v in names.items()}
    classes = {r"\s": spans["Z"], r"\p{L}": spans["L"], r"\p{N}": spans["N"]}
    inside = re.sub(r"\[[^\]]*\]", lambda m: reduce(lambda x, c: x.replace(c, classes[c]), classes, m[0]), pattern)
    alone = reduce(lambda x, c: x.replace(c, f"[{classes[c]}]"), classes, inside)
    return re.compile(alone.replace(r"\S", f"[^{classes[r'\s']}]"))


def split_places(offsets: Sequence[tuple[int, int]]) -> int:
    """Places between two tokens that lie inside a character: the offsets of both hold it."""
    return sum(y[0] < x[1] for x, y in pairwise(offsets))


class ByteTokenizer:
    """The tokenizer of a rank file and a pattern: each match of the pattern is encoded by itself.

    The library works on characters, so each byte goes in as its stand-in; a piece that is a token by itself is one at once,
    others are merged by rank. Two pieces of a text stay apart at a white-space character behind another one, by which long
    texts are cut into blocks (of a pattern that has no match across such a place, as the one in use). The different pieces of
    some blocks go to the library in one call, and a bounded number of them is remembered. A block with characters on which
    the pattern's classes may differ between the library and Python goes to the library whole, to be split there.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each Spark task is a thread by itself
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        letters = byte_letters()
        shown = lambda data: "".join(map(letters.__getitem__, data))
        pairs = (merge_pair(t, ranks) for t in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__))
        merges = [(shown(a), shown(b)) for a, b in filter(None, pairs)]
        model = models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.library, self.splitter = Tokenizer(model), Tokenizer(model)
        self.library.pre_tokenizer = as_bytes
        self.splitter.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "removed", invert=True), as_bytes])
        self.pattern = own_pattern(pattern)
        self.known: dict[str, tuple[tuple[int, ...], str, int]] = {}
        self.old: dict[str, tuple[tuple[int, ...], str, int]] = {}
        byte_of = {c: b for b, c in letters.items()}
        self.token_bytes = {i: bytes(map(byte_of.__getitem__, t)) for t, i in self.library.get_vocab(with_added_tokens=False).items()}
        self.id_text = {i: str(i) for i in self.token_bytes}

    def blocks(self, text: str) -> Iterator[str]:
        """A text in blocks whose tokens together are those of the whole: cut before white space that follows another character."""
        lo = 0
        while lo < len(text):
            hi = lo + BLOCK
            if hi < len(text):
                m = _EDGE.search(text, hi)
                hi = m.start() if m else len(text)
            yield text[lo:hi]
            lo = hi

    def encode(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[tuple[int, ...], str, int]]]]:
        """(number of the text, pieces) of every block of every text, in order; a piece is its ids, the same as text, and the places
        between two of them inside a character. A call of the library takes the new pieces of CALL characters of text."""
        held: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            for block in self.blocks(text):
                held.append((k, block))
                size += len(block)
                if size >= CALL:
                    yield from self._call(held)
                    held, size = [], 0
        yield from self._call(held)

    def _call(self, held: list[tuple[int, str]]) -> Iterator[tuple[int, list[tuple[tuple[int, ...], str, int]]]]:
        if len(self.known) > KEPT:
            self.old, self.known = self.known, {}
        known = self.known
        found = [None if _UNSURE.search(x) else self.pattern.findall(x) for _, x in held]
        new = []
        for p in set(chain.from_iterable(filter(None, found))) - known.keys():
            if p in self.old:
                known[p] = self.old[p]
            else:
                new.append(p)
        if new:
            e = self.library.encode(new, is_pretokenized=True, add_special_tokens=False)
            lo, ids, offsets, last = 0, e.ids, e.offsets, [*e.word_ids, None]
            for hi in range(1, len(last)):
                if last[hi] != last[hi - 1]:
                    text = new[last[lo]]
                    known[text] = self.piece(ids[lo:hi], () if text.isascii() else offsets[lo:hi])
                    lo = hi
        for (k, x), own in zip(held, found, strict=True):
            if own is None:
                e = self.splitter.encode(x, add_special_tokens=False)
                yield k, [self.piece(e.ids, e.offsets)] if e.ids else []
            else:
                yield k, list(map(known.__getitem__, own))

    def piece(self, ids: list[int], offsets: Sequence[tuple[int, int]]) -> tuple[tuple[int, ...], str, int]:
        return tuple(ids), ",".join(map(self.id_text.__getitem__, ids)), split_places(offsets) if len(offsets) > 1 else 0

    def spans(self, text: str) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """(ids, starts, ends) of each block: the characters [start, end) of the text that a token touches."""
        at = 0
        for block in self.blocks(text):
            e = self.splitter.encode(block, add_special_tokens=False)
            yield e.ids, [at + lo for lo, _ in e.offsets], [at + hi for _, hi in e.offsets]
            at += len(block)

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids: the byte table reversed."""
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode_text(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of lists of ids, a part for each: a character whose bytes lie in two tokens, or two lists, comes once it is whole;
        bytes that never make one give U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for ids in parts:
            yield state.decode(self.decode(ids))
        yield state.decode(b"", final=True)


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteTokenizer:
    return ByteTokenizer(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns named by keep) with n_tokens, ids_sha256 (ids joined by commas), decoded_sha256 (of the decoded bytes)
    and n_split (places between two tokens inside a character) of each whole text.

    `path` is the rank file, present on every executor. Null and empty texts have no tokens. Columns that bear one of the four
    names are replaced, others pass through. Repeated rows get equal answers, an empty table gives no rows. A long text is
    encoded block by block, each block's ids going into the digests at once, so that memory follows the longest stretch without
    an edge of white space and not the text.
    """
    small_batches(docs.sparkSession)
    new = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "n_split": "bigint"}
    own = [c for c in (docs.columns if keep is None else keep) if c not in new]
    given, at, schema = widened(docs, own, new, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path, pattern)
        for b in batches:
            n, split = [0] * b.num_rows, [0] * b.num_rows
            digests = [(hashlib.sha256(), hashlib.sha256()) for _ in range(b.num_rows)]
            for k, pieces in tokenizer.encode([t or "" for t in b.column(at).to_pylist()]):
                if pieces:
                    ids = list(chain.from_iterable([p[0] for p in pieces]))
                    digests[k][0].update((("," if n[k] else "") + ",".join([p[1] for p in pieces])).encode())
                    digests[k][1].update(tokenizer.decode(ids))
                    n[k] += len(ids)
                    split[k] += sum([p[2] for p in pieces])
            made = [pa.array(n, pa.int64()), *(pa.array([d[i].hexdigest() for d in digests], pa.string()) for i in range(2)), pa.array(split, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(own))), *made], names=[*own, *new])
        tokenizer.known, tokenizer.old = {}, {}  # the worker lives on, beside whatever its executor does next

    return given.mapInArrow(run, schema)


def tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, part, ids, starts, ends): every block of every text with its ids and the characters [start, end) of the text that each
    token touches. Tokens that share a character both name it. Empty and null texts have no row, repeated rows have rows each."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path, pattern)
        for b in batches:
            for k, text in enumerate(b.column(1).to_pylist()):
                for part, found in enumerate(tokenizer.spans(text or "")):
                    lists = [pa.array([x], pa.list_(kind)) for x, kind in zip(found, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([part], pa.int64()), *lists], names=["_id", "part", "ids", "starts", "ends"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, part bigint, ids array<int>, starts array<bigint>, ends array<bigint>")


def detokenized(parts: DataFrame, path: str, pattern: str) -> DataFrame:
    """(_id, part, text): the text of each row of ids by itself; a row that ends inside a character shows U+FFFD there. Blocks of
    tokens() end at whole characters, so their texts joined by part are the document's. Null ids give a null text."""
    small_batches(parts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path, pattern)
        for b in batches:
            texts = [None if ids is None else "".join(tokenizer.decode_text([ids])) for ids in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["_id", "part", "text"])

    return parts.select("_id", "part", "ids").mapInArrow(run, f"_id {parts.schema['_id'].dataType.simpleString()}, part bigint, text string")
