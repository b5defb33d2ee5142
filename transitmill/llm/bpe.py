"""BPE encoding by a transducer with bounded lookahead, and decoding by a state machine from bytes to text."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, widened

#: Pieces between white space (and as many words) whose result is kept, and the longest that is.
CACHE_PIECES, CACHE_LENGTH = 120_000, 64
#: Characters of a text that are taken at a time, and ids of a long piece.
BLOCK, PART = 1 << 16, 1 << 13
#: Characters on which the library's Unicode tables and Python's may differ: texts that hold one go to the library's own normalizer and splitter.
_UNSURE = re.compile("[^\x00-\x1b\x20-՗ -⁯぀-ヿ一-鿿가-힣]")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 character, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols after which no text can change the tokens that end before them.

    Two continuations first differ to the right of a border. The difference moves left only by a merge of the token that
    ends at it, and each such merge comes later in the list than the one before. reach[t] bounds how far right of a border
    the cause can lie when token t starts there in one of the two; a merge (x, y) carries the border over x and leaves x
    or xy there, while a token at the border that grows to the right keeps its reach. Merges are taken in their order, so
    one pass over the list bounds all chains.
    """
    reach: dict[str, int] = {}
    most = 0
    for x, y in merges:
        far = len(x) + reach.get(y, 0)
        own = reach.get(x, 0)
        reach[x] = max(own, far)
        reach[x + y] = max(reach.get(x + y, 0), far, own)
        most = max(most, far)
    return most


class Tokenizer:
    """A byte-level BPE with word ends, read from a tokenizer file: NFC, white space dropped, lower case, split by pattern."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in self.letters.items()}
        self.pattern = regex.compile(held["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = Library.from_file(path)
        # a word end counts as one symbol, as it belongs to the last one
        one = lambda t: t.removesuffix(self.end) if self.end and t.endswith(self.end) else t
        self.lookahead = lookahead([(one(a), one(b)) for a, b in pairs])
        self.window = max(CACHE_LENGTH, self.lookahead)
        self.id_text = {i: str(i) for i in self.tokens}
        self.token_bytes = {i: t.encode() for i, t in self.tokens.items()}
        self.known = Kept(self.word_ids)
        self.pieces = Kept(self.piece_ids)

    def merge(self, symbols: list[str]) -> list[str]:
        """The tokens of symbols: the pair of least rank, leftmost first, until none is left."""
        n, ranks = len(symbols), self.ranks
        if n < 2:
            return symbols
        get = ranks.get
        if n <= 48:
            own, none = list(symbols), len(ranks)
            order = [get(p, none) for p in zip(own, own[1:], strict=False)]
            while (best := min(order, default=none)) < none:
                i = order.index(best)
                own[i : i + 2] = [own[i] + own[i + 1]]
                del order[i]
                if i:
                    order[i - 1] = get((own[i - 1], own[i]), none)
                if i < len(order):
                    order[i] = get((own[i], own[i + 1]), none)
            return own
        own, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
        alive = [True] * n
        heap = [(r, i, own[i], own[i + 1]) for i in range(n - 1) if (r := ranks.get((own[i], own[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or own[i] != a or own[j] != b:
                continue
            own[i], alive[j], after[i] = a + b, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := ranks.get((own[i], own[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, own[i], own[after[i]]))
            if before[i] >= 0 and (r := ranks.get((own[before[i]], own[i]))) is not None:
                heapq.heappush(heap, (r, before[i], own[before[i]], own[i]))
        return [t for t, live in zip(own, alive, strict=True) if live]

    def transduce(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word's symbols, each emitted once no further symbol can change it; holds about twice `window`.

        Tokens that end `lookahead` symbols before the end of what has come are stable, and the rest of the word merges by
        itself from the border of any stable token on. A word that ends before the window is full is emitted at its end.
        """
        if isinstance(symbols, list) and len(symbols) < 2 * self.window + 64:
            return iter(self.merge(symbols))
        return self._stream(symbols)

    def _stream(self, symbols: Iterable[str]) -> Iterator[str]:
        held: list[str] = []
        for s in symbols:
            held.append(s)
            if len(held) >= 2 * self.window + 64:
                used, sure = 0, len(held) - self.lookahead
                for t in self.merge(held):
                    if used + len(t) > sure:
                        break
                    used += len(t)
                    yield t
                held = held[used:]
        yield from self.merge(held)

    def symbols(self, word: str) -> Iterable[str]:
        """The stand-ins of a word's bytes, the last with the word end."""
        if len(word) <= CACHE_LENGTH:
            own = list(word) if word.isascii() and word.isprintable() else [self.letters[b] for b in word.encode()]
            own[-1] += self.end
            return own
        return self._long_symbols(word)

    def _long_symbols(self, word: str) -> Iterator[str]:
        letters, last = self.letters, None
        for i in range(0, len(word), 1024):
            for b in word[i : i + 1024].encode():
                if last is not None:
                    yield last
                last = letters[b]
        yield last + self.end

    def words(self, piece: str) -> Iterable[str]:
        """The words of a piece without white space, normalized."""
        if not piece.isascii():
            if _UNSURE.search(piece):
                own = self.library.normalizer.normalize_str(piece)
                return [bytes(self.bytes_of[c] for c in word).decode() for word, _ in self.library.pre_tokenizer.pre_tokenize_str(own)]
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        piece = piece.lower()
        if piece.isalpha():
            return (piece,)
        if piece[:-1].isalpha() and piece[-1] in ",.;:!?":
            return (piece[:-1], piece[-1])
        return (m.group() for m in self.pattern.finditer(piece))

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of a short word, from the transducer."""
        return tuple(map(self.vocab.__getitem__, self.transduce(self.symbols(word))))

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        """Ids of a short piece."""
        found = [self.known[w] for w in self.words(piece)]
        return found[0] if len(found) == 1 else tuple(chain.from_iterable(found))

    def long_ids(self, piece: str) -> Iterator[int]:
        """Ids of a long piece as the transducer emits them; nothing of it is remembered."""
        for word in self.words(piece):
            yield from map(self.vocab.__getitem__, self.transduce(self.symbols(word)))

    def blocks(self, text: str) -> Iterator[list[str] | int]:
        """A text as the ids of special tokens in it and, between them, lists of pieces without white space."""
        parts = self.cut_special.split(text) if self.cut_special and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part]
                continue
            split = _SPACES.split if any(c in part for c in _SEPARATORS) else str.split
            lo = 0
            while lo < len(part):
                hi = lo + BLOCK
                if hi < len(part) and (m := _SPACES.search(part, hi)):
                    hi = m.start()
                elif hi < len(part):
                    hi = len(part)
                yield [p for p in split(part[lo:hi]) if p]
                lo = hi

    def parts(self, text: str) -> Iterator[list[int]]:
        """The ids of a text in lists, each as soon as its part of the text is encoded: a block's pieces, or up to PART ids of a long piece."""
        for block in self.blocks(text):
            if isinstance(block, int):
                yield [block]
            elif max(map(len, block), default=0) <= CACHE_LENGTH:
                yield list(chain.from_iterable(map(self.pieces.__getitem__, block)))
            else:
                for piece in block:
                    if len(piece) <= CACHE_LENGTH:
                        yield list(self.pieces[piece])
                        continue
                    ids = self.long_ids(piece)
                    while part := list(islice(ids, PART)):
                        yield part

    def encode(self, text: str) -> Iterator[int]:
        """The ids of a text, as its pieces come."""
        return chain.from_iterable(self.parts(text))


class Kept(dict):
    """A bounded memory in two generations: when the young one is full it becomes the old one, and what is met there again moves on."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        if (found := self.old.get(key)) is None:
            found = self.make(key)
            if len(key) > CACHE_LENGTH:
                return found
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found

    def forget(self) -> None:
        self.old = {}
        self.clear()


class Utf8Machine:
    """Bytes to text, a byte at a time: the state is how many continuation bytes are due, and the code point so far.

    `feed` gives the characters that have become complete; an invalid byte gives U+FFFD, as does an unfinished one at the end.
    """

    def __init__(self) -> None:
        self.due, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.due:
            # no sequence is open: bytes that are whole and valid leave the machine in the same state
            try:
                return data.decode()
            except UnicodeDecodeError:
                pass
        out = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.code, self.due, self.low, self.high = self.code << 6 | b & 0x3F, self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.due, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.due, self.code = 2, b & 0x0F
                self.low, self.high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F)}.get(b, (0x80, 0xBF))
            elif 0xF0 <= b <= 0xF4:
                self.due, self.code = 3, b & 0x07
                self.low, self.high = {0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.due = "�" * bool(self.due), 0
        return left


def decode_words(tokenizer: Tokenizer, ids: Iterable[int]) -> Iterator[str]:
    """Readable text of ids, in parts: bytes through the machine, word ends as spaces, special tokens as they are."""
    machine, special = Utf8Machine(), set(tokenizer.special.values())
    for i in ids:
        t = tokenizer.tokens[i]
        if i in special:
            yield machine.end() + t
            continue
        ended = bool(tokenizer.end) and t.endswith(tokenizer.end)
        yield machine.feed(bytes(tokenizer.bytes_of[c] for c in t.removesuffix(tokenizer.end) if c in tokenizer.bytes_of)) + (machine.end() + " " if ended else "")
    yield machine.end()


def decode_tokens(tokenizer: Tokenizer, parts: Iterable[list[int]]) -> Iterator[str]:
    """What the library's decode gives for a file without a decoder, in parts: the token strings of lists of ids, joined by one space."""
    machine, lead = Utf8Machine(), b""
    for ids in filter(None, parts):
        yield machine.feed(lead + b" ".join(map(tokenizer.token_bytes.__getitem__, ids)))
        lead = b" "
    yield machine.end()


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


def digests(tokenizer: Tokenizer, text: str | None) -> tuple[int, str, str]:
    """(number of ids, SHA-256 of the ids, SHA-256 of the text that they decode to).

    Every part goes out of the transducer, into the first hash, and through the decoder into the second, before the next one
    is begun. Beside the text there are copies of a block or of its longest piece without white space, and no list of tokens.
    """
    ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0

    def passed() -> Iterator[list[int]]:
        nonlocal n
        for part in tokenizer.parts(text or ""):
            if part:
                ids.update(((" " if n else "") + " ".join(map(tokenizer.id_text.__getitem__, part))).encode())
                n += len(part)
                yield part

    for shown in decode_tokens(tokenizer, passed()):
        decoded.update(shown.encode())
    return n, ids.hexdigest(), decoded.hexdigest()


def encoded(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns named by keep) with n_tokens, ids_sha256 and decoded_sha256 of each whole text; null counts as empty.

    `path` is the tokenizer's file, present on every executor. Columns that bear one of the three names are replaced, others
    pass through. Repeated rows get equal answers, an empty table gives no rows, and a very long text or word is encoded in
    memory that doesn't grow with its number of tokens.
    """
    small_batches(docs.sparkSession)
    new = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    own = [c for c in (docs.columns if keep is None else keep) if c not in new]
    given, at, schema = widened(docs, own, new, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for b in batches:
            found = [digests(tokenizer, t) for t in b.column(at).to_pylist()]
            cols = [b.column(i) for i in range(len(own))] + [pa.array([x[k] for x in found], pa.string() if k else pa.int64()) for k in range(len(new))]
            yield pa.RecordBatch.from_arrays(cols, names=[*own, *new])
        # the worker lives on, beside whatever its executor does next
        tokenizer.pieces.forget()
        tokenizer.known.forget()

    return given.mapInArrow(run, schema)


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids themselves."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([list(tokenizer.encode(b.column(1)[i].as_py() or ""))], pa.list_(pa.int32()))], names=["_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, "_id bigint, ids array<int>")
