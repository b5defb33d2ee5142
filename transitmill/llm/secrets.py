"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags further tokens."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, widened

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.\-]+|[^\sA-Za-z0-9+/_.\-]")
_GAP = re.compile(r"\s")
_NAMES = {"password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "access", "auth", "bearer", "credential", "credentials", "private", "passphrase"}
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, each leftmost and non-overlapping in its kind, in code points."""
    out: list[Span] = []
    lower = text.lower() if not text.isascii() else text.casefold()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def told(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# A token has one value in each group, so that the most that it can add to a label is a sum of maxima.
GROUPS = {"length": 7, "shape": 12, "name": 2, "entropy": 4, "prefix": 2}
_START = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()])[:-1].tolist(), strict=True))
WIDTH = sum(GROUPS.values())
#: Places of the neighbours whose features count, the token itself first; and the features of the whole file.
PLACES, FILE = (0, -1, -2, -3, 1), 4
#: Tokens that scores are held for at a time.
BLOCK = 1 << 15


def shape(token: str) -> int:
    if len(token) == 1 and not token.isalnum():
        return 9 if token in "=:" else 10 if token in "\"'`" else 11
    bare = token.strip("+/_.-")
    if not bare:
        return 11
    if bare.isdigit():
        return 3
    if bare.isalpha():
        return 0 if bare.islower() else 1 if bare.isupper() else 2
    digit, upper, lower = any(c.isdigit() for c in bare), any(c.isupper() for c in bare), any(c.islower() for c in bare)
    if digit and all(c in "0123456789abcdef" for c in bare):
        return 4
    if digit and upper and lower:
        return 5
    if digit and lower:
        return 6
    if digit and upper:
        return 7
    return 3 if digit else 8


def values(token: str) -> tuple[int, ...]:
    """The token's value in each group, as indices into a weight row."""
    n = len(token)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(token).values())
    own = {"length": sum(n >= x for x in (4, 8, 12, 16, 20, 32)), "shape": shape(token), "name": int(token.lower().strip("._-") in _NAMES), "entropy": sum(bits >= x for x in (2.0, 3.0, 3.7)), "prefix": int(token.startswith(("AKIA", "ghp_", "sk-", "xox")))}
    return tuple(_START[g] + v for g, v in own.items())


Counts = tuple[int, int, int, bool]


def file_counts(text: str) -> Counts:
    """Of a whole text: code points, digits, symbols of code, and whether it names a secret."""
    lower = text.lower()
    return len(text), sum(map(text.count, "0123456789")), sum(map(text.count, "={}<>;$#|")), any(w in lower for w in _ASSIGN_WORDS)


def file_values(counts: Counts) -> list[float]:
    """The file's features: names a secret, many digits, many symbols, short."""
    n, digits, symbols, named = counts
    return [float(named), float(digits > 0.05 * n), float(symbols > 0.03 * n), float(n < 500)]


_SIZES = tuple(GROUPS.values())
CLASSES = math.prod(_SIZES)


def token_class(token: str) -> int:
    """The values of all groups in one number."""
    out = 0
    for (_, k), v, s in zip(GROUPS.items(), values(token), _START.values(), strict=True):
        out = out * k + v - s
    return out


class Classes(dict):
    """token -> class; bounded, begun anew when full."""

    def __missing__(self, token: str) -> int:
        found = token_class(token)
        if len(self) >= 200_000:
            self.clear()
        self[token] = found
        return found


class Model:
    """emission[place, feature, label], file[feature, label], moves[from, to] and start[label]; an inside tag follows a begin or inside one."""

    def __init__(self, emission: np.ndarray, file: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.emission, self.file, self.moves, self.start = emission, file, moves, start
        self.classes = Classes()
        cells = np.indices(_SIZES).reshape(len(_SIZES), -1)
        #: What a token of each class adds to each label at each place.
        self.adds = sum(emission[:, s + v, :] for s, v in zip(_START.values(), cells, strict=True))
        switch = (self.adds[:, :, INSIDE] - self.adds[:, :, BEGIN]).max(axis=1).clip(0).sum() + (file[:, INSIDE] - file[:, BEGIN]).clip(0).sum()
        step = (moves[1:, :2] - moves[:1, :2]).max()
        #: Most that being in a secret can be worth over being outside, for all that follows.
        self.lead = max(0.0, step, switch + moves[1:, INSIDE].max() - moves[OUTSIDE, BEGIN] + max(0.0, (moves[INSIDE] - moves[BEGIN])[:2].max(), moves[INSIDE, INSIDE] - moves[BEGIN, INSIDE]))
        self.enter = max(moves[OUTSIDE, BEGIN] - moves[OUTSIDE, OUTSIDE], start[BEGIN] - start[OUTSIDE])

    def __reduce__(self) -> tuple:
        return Model, (self.emission, self.file, self.moves, self.start)

    def numbers(self, tokens: list[str]) -> np.ndarray:
        """The class of each token."""
        return np.fromiter(map(self.classes.__getitem__, tokens), np.int32, len(tokens))

    def emissions(self, own: np.ndarray, file: list[float], lo: int = 0, hi: int | None = None) -> np.ndarray:
        """scores[token, label] without moves, of the tokens lo to hi of all whose classes are given."""
        hi = len(own) if hi is None else hi
        out = self.adds[0][own[lo:hi]] + np.asarray(file) @ self.file
        for p, off in enumerate(PLACES):
            a, b = max(lo + off, 0), min(hi + off, len(own))
            if off and a < b:
                out[a - off - lo : b - off - lo] += self.adds[p][own[a:b]]
        return out


def viterbi(model: Model, own: np.ndarray, file: list[float], block: int = BLOCK) -> list[tuple[int, int]]:
    """The secrets in Viterbi's best path over tokens of the given classes, as (first token, last token).

    The path is sought over the stretches in which a secret can begin. One opens at a token whose begin score, with all that
    being inside may gain later, beats being outside; it closes once being outside leads by more than any continuation
    could make up. All other tags are outside, so the result is that of the whole lattice, whose scores are held for
    `block` tokens at a time.
    """
    out: list[tuple[int, int]] = []
    moves, start, n, done = model.moves.tolist(), model.start.tolist(), len(own), 0
    for lo in range(0, n, block):
        scores = model.emissions(own, file, lo, min(lo + block, n))
        for i in (lo + np.nonzero(scores[:, BEGIN] - scores[:, OUTSIDE] + model.enter + model.lead > 0)[0]).tolist():
            if i < done:
                continue
            held, base = scores, lo
            e = held[i - base].tolist()
            first = start if i == 0 else moves[OUTSIDE]
            score, back, j = [first[OUTSIDE] + e[OUTSIDE], first[BEGIN] + e[BEGIN], -1e9], [[OUTSIDE] * 3], i + 1
            while j < n and score[OUTSIDE] <= max(score[BEGIN], score[INSIDE]) + model.lead:
                if j - base >= len(held):
                    held, base = model.emissions(own, file, j, min(j + block, n)), j
                e, now, came = held[j - base].tolist(), [], []
                for s in range(3):
                    options = [score[r] + moves[r][s] for r in range(3)]
                    r = max(range(3), key=options.__getitem__)
                    came.append(r)
                    now.append(options[r] + e[s])
                score, j = now, j + 1
                back.append(came)
            s, path = max(range(3), key=score.__getitem__), []
            for k in range(len(back) - 1, -1, -1):
                path.append(s)
                s = back[k][s]
            for k, s in enumerate(reversed(path), i):
                if s == BEGIN:
                    out.append((k, k))
                elif s == INSIDE:
                    out[-1] = (out[-1][0], k)
            done = j
    return out


def crf_spans(model: Model, text: str) -> list[Span]:
    """(start, end, "crf") of the tagged secrets of a whole text. Beside the text, 4 bytes a token are held, and the tokens of
    one block between white space."""
    cuts, own, lo = [], [], 0
    while lo < len(text):
        hi = min(lo + 8 * BLOCK, len(text))
        if hi < len(text):
            hi = m.start() if (m := _GAP.search(text, hi)) else len(text)
        cuts.append(lo)
        own.append(model.numbers(_TOKEN.findall(text, lo, hi)))
        lo = hi
    if not own:
        return []
    first = np.cumsum([0, *map(len, own)]).tolist()
    out, at = [], (-1, [])

    def place(k: int) -> tuple[int, int]:
        nonlocal at
        b = bisect_right(first, k) - 1
        if at[0] != b:
            at = b, [(m.start(), m.end()) for m in _TOKEN.finditer(text, cuts[b], cuts[b + 1] if b + 1 < len(cuts) else len(text))]
        return at[1][k - first[b]]

    for a, b in viterbi(model, np.concatenate(own), file_values(file_counts(text))):
        out.append((place(a)[0], place(b)[1], "crf"))
    return out


def scan(model: Model, text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): a tagged span that overlaps a base one isn't added."""
    own = text or ""
    base = base_spans(own)
    begins = sorted(base)
    ends = list(accumulate((b[1] for b in begins), max))

    def free(s: Span) -> bool:
        """No base span that begins before its end reaches beyond its begin."""
        k = bisect_left(begins, (s[1],))
        return not k or ends[k - 1] <= s[0]

    return base, ordered(base + [s for s in crf_spans(model, own) if free(s)])


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(sequences: list[tuple[list[str], list[int], list[float]]], steps: int = 150, rate: float = 0.15, l2: float = 1e-3, settled: float = 2e-4) -> Model:
    """Maximum likelihood by Adam; gradients from the forward-backward algorithm over all (tokens, labels, file) at once.

    It ends after `steps`, or once ten of them gain less than `settled` of log-likelihood a sequence.
    """
    n, length = len(sequences), max(len(s[0]) for s in sequences)
    x, extra = np.zeros((n, length, len(PLACES) * WIDTH), np.float32), np.zeros((n, FILE), np.float32)
    y, mask = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for k, (tokens, labels, file) in enumerate(sequences):
        own = [values(t) for t in tokens]
        for i in range(len(tokens)):
            for p, off in enumerate(PLACES):
                if 0 <= i + off < len(tokens):
                    x[k, i, [p * WIDTH + v for v in own[i + off]]] = 1
        y[k, : len(labels)], mask[k, : len(tokens)], extra[k] = labels, True, file
    flat = x.reshape(-1, x.shape[-1])
    theta = {"w": np.zeros((x.shape[-1], 3)), "f": np.zeros((FILE, 3)), "m": np.zeros((3, 3)), "s": np.zeros(3)}
    mean, var = ({k: np.zeros_like(v) for k, v in theta.items()} for _ in range(2))
    never = np.zeros((3, 3))
    never[OUTSIDE, INSIDE] = -1e4
    first = np.array([0, 0, -1e4])
    gold = np.eye(3)[y] * mask[..., None]
    steps_gold = np.einsum("kti,ktj->ij", gold[:, :-1], gold[:, 1:])
    gains: list[float] = []
    for step in range(1, steps + 1):
        e = (flat @ theta["w"]).reshape(n, length, 3) + (extra @ theta["f"])[:, None, :]
        moves = theta["m"] + never
        alpha = np.zeros((n, length, 3))
        alpha[:, 0] = theta["s"] + first + e[:, 0]
        for t in range(1, length):
            now = _logsumexp(alpha[:, t - 1, :, None] + moves, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], now, alpha[:, t - 1])
        beta = np.zeros((n, length, 3))
        for t in range(length - 2, -1, -1):
            now = _logsumexp(moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], now, beta[:, t + 1] * 0)
        z = _logsumexp(alpha[:, -1], 1)
        gains.append(float(((gold * e).sum() + (steps_gold * theta["m"]).sum() + (gold[:, 0] @ theta["s"]).sum() - z.sum()) / n))
        if step > 30 and gains[-1] - gains[-11] < settled:
            break
        post = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        d = gold - post
        grad = {"w": flat.T @ d.reshape(-1, 3), "f": extra.T @ d.sum(axis=1), "m": steps_gold - pair.sum(axis=(0, 1)), "s": d[:, 0].sum(axis=0)}
        for k in theta:
            g = grad[k] / n - l2 * theta[k]
            mean[k], var[k] = 0.9 * mean[k] + 0.1 * g, 0.99 * var[k] + 0.01 * g * g
            theta[k] = theta[k] + rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
    return Model(theta["w"].reshape(len(PLACES), WIDTH, 3), theta["f"], theta["m"] + never, theta["s"] + first)


Piece = tuple[str, str, Counts]


def window(text: str, rng: random.Random) -> Piece | None:
    """A place in a whole text: up to 8 words before it and 6 after it (200 characters at most each), and the text's counts.
    None if the text has secrets by the fixed patterns."""
    if base_spans(text):
        return None
    at = rng.randrange(len(text) + 1)
    before, after = text[max(0, at - 200) : at].split(), text[at : at + 200].split()
    return " ".join(before[-8:]), " ".join(after[:6]), file_counts(text)


def examples(pieces: list[Piece], count: int = 900, seed: int = 3) -> list[tuple[list[str], list[int], list[float]]]:
    """Training windows from places in texts without secrets of their own: into some, a secret is written in one of many ways;
    others get what only looks like one, such as numbers, names without a value, addresses and long words.

    The file's features are those of the place's whole text with what is written into it; every fourth window is a
    file by itself. Nothing but the places and a seed goes in, so the same ones give the same windows.
    """
    rng = random.Random(seed)
    pools = {"hex": "0123456789abcdef", "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"}
    draw = lambda pool, lo, hi: "".join(rng.choice(pools[pool]) for _ in range(rng.randint(lo, hi)))
    digits = lambda lo, hi: "".join(rng.choice("0123456789") for _ in range(rng.randint(lo, hi)))
    pieces = pieces or [("a few plain", "words stand here", (28, 0, 0, False))]

    def secret() -> tuple[str, str]:
        kind = rng.random()
        value = draw("hex", 20, 64) if kind < 0.3 else draw("mixed", 16, 48) if kind < 0.55 else draw("url", 20, 60) if kind < 0.75 else "AKIA" + draw("upper", 16, 16) if kind < 0.85 else rng.choice(["ghp_", "sk-", "xoxb-"]) + draw("mixed", 24, 40)
        name = rng.choice(["password", "secret", "token", "api_key", "Auth", "access_key", "key", "PASSWORD", "credentials", "passphrase", "bearer"])
        quote = rng.choice(["", '"', "'"])
        lead = rng.choice([f"{name} = {quote}", f"{name}: {quote}", f"{name}={quote}", f"{name} ", f"{name} is {quote}", "", ""])
        return lead, value + "\0" + quote

    def decoy() -> str:
        return rng.choice([digits(7, 20), f"+1 ({digits(3, 3)}) {digits(3, 3)}-{digits(4, 4)}", ".".join(digits(1, 3) for _ in range(4)), f"{rng.choice(['token', 'secret', 'password'])} of", "the password is not", f"www.{draw('hex', 4, 6)}.com/a/b", f"{digits(4, 4)}-{digits(2, 2)}-{digits(2, 2)}", "".join(rng.choice(["schaft", "heit", "ment", "tion", "able"]) for _ in range(rng.randint(3, 7))), f"name{digits(1, 3)}@mail.com", f"ISBN {digits(13, 13)}", f"v{digits(1, 1)}.{digits(1, 2)}.{digits(1, 2)}", draw("mixed", 3, 6), rng.choice(["###", "$$$", "!!!", "|"]), "UPPER CASE WORDS " * 2, draw("upper", 2, 6)])

    out = []
    for k in range(count):
        before, after, counts = rng.choice(pieces)
        if k % 2:
            lead, value = secret()
            own, quote = value.split("\0")
            put = f" {lead}{own}{quote} "
            lo = len(before) + 1 + len(lead)
            hi = lo + len(own)
        else:
            put, lo, hi = f" {decoy() if k % 4 else ''} ", -1, -1
        text = before + put + after
        found = list(_TOKEN.finditer(text))[:40]
        if not found:
            continue
        labels, begun = [], False
        for m in found:
            inside = lo <= m.start() < hi
            labels.append((INSIDE if begun else BEGIN) if inside else OUTSIDE)
            begun = inside
        more = file_counts(text if rng.random() < 0.25 else put)
        counts = more if more[0] == len(text) else (*[a + b for a, b in zip(counts[:3], more[:3], strict=True)], counts[3] or more[3])
        out.append(([m.group() for m in found], labels, file_values(counts)))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 400, windows: int = 900) -> Model:
    """Learns from `windows` windows, made of one place in each of at most sample_docs documents: those of least hash among the
    distinct ids. No labels are needed. Places are chosen, and whole texts counted, on the executors.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ids = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_i"))
    order = F.pmod(F.xxhash64("_i"), F.lit(1 << 40))
    share = min(1.0, 8 * sample_docs / max(ids.count(), 1))
    few = ids.filter(order < int(share * (1 << 40))).distinct().orderBy(order, "_i").limit(sample_docs)
    chosen = [r[0] for r in few.collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [window(t, random.Random(zlib.crc32(t.encode()))) for t in b.column(1).to_pylist()]
            rows = [(k, *x[:2], *x[2]) for k, x in enumerate(found) if x]
            held = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([held, *[pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate(kinds)]], names=["i", "before", "after", "n", "digits", "symbols", "named"])

    rows = docs.filter(F.col(id_col).isin(chosen) & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    places = rows.mapInArrow(run, f"i {kind}, before string, after string, n bigint, digits bigint, symbols bigint, named boolean")
    # one place an id, however many rows share it
    one = places.groupBy("i").agg(F.min(F.struct("before", "after", "n", "digits", "symbols", "named")).alias("p")).collect()
    held = [(r.p.before, r.p.after, (r.p.n, r.p.digits, r.p.symbols, r.p.named)) for r in sorted(one, key=lambda r: r.i)]
    return train(examples(held, windows))


def find(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns named by keep) with n_assign, n_access, n_hex, base_sha256 and spans of each whole text.

    Null texts count as empty: no spans, the hash of an empty string. Repeated rows get equal answers; of paths of equal score
    the one with fewer secrets' tokens is taken. Own columns of those names are replaced, others pass through. An empty
    table gives no rows. A very long text is scanned whole, in blocks; beside it 4 bytes a token are held.
    """
    small_batches(docs.sparkSession)
    new = {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}
    own = [c for c in (docs.columns if keep is None else keep) if c not in new]
    given, at, schema = widened(docs, own, new, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                base, every = scan(model, t)
                kinds = Counter(s[2] for s in base)
                out.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(told(base).encode()).hexdigest(), told(every)))
            cols = [pa.array([x[k] for x in out], pa.int64() if k < 3 else pa.string()) for k in range(len(new))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(own))], *cols], names=[*own, *new])

    return given.mapInArrow(run, schema)
