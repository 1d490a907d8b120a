"""Secret scans: fixed patterns plus a linear-chain conditional random field.

Three patterns give the base spans. A CRF tags word and punctuation tokens as
secret begin, inside or outside from the token's shape, the words before and
after it and features of the whole file; its spans are added as kind ``crf``
where they touch no base span. The CRF is learned by exact forward-backward
gradients from base spans in a bounded, hash-drawn sample of texts, whose
windows are cut from the whole text with the whole text's features, and from
SYNTHETIC generated windows with other key words and value forms.

Decoding is Viterbi over whole texts. A token whose outside score leads by more
than transitions can make up is outside on every best path; so the text falls
into short open runs between such tokens and only those are decoded, with the
same result.

Null and empty texts have no spans; a very long text is decoded whole, as any
other. Repeated rows have equal spans; of spans with one start the order of the
kinds decides. Rows with a null id are scanned, but not learned from. Spans are
in code points, end exclusive. Without texts to learn from the generated windows
remain. An empty table gives an empty result; other columns are kept, one named
like the result is replaced.
"""

from __future__ import annotations

import random
import re
import zlib
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, RangeHash, mix, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "crf")
LEAST_HEX = 24
LEAST_VALUE = 6
MOST_TEXTS = 20_000
MOST_WINDOWED = 4000
SYNTHETIC = 1500
REACH = 12
SLOTS = 1 << 16
O, B, I = 0, 1, 2

_hex = np.zeros(256, bool)
_hex[48:58] = _hex[97:103] = True


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of all pattern matches."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def maybe(text: str) -> bool:
    """Whether key words or an access prefix occur; long hex runs are looked for apart."""
    low = text.lower()
    return "AKIA" in text or any(k in low for k in KEYS)


def has_hex(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows with a run of LEAST_HEX hex digits."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _hex[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= LEAST_HEX
    out = np.zeros(len(at) - 1, bool)
    # a run over a row's end is looked at by the pattern in both rows
    out[np.searchsorted(at, start[long], "right") - 1] = True
    out[np.minimum(np.searchsorted(at, end[long] - 1, "right") - 1, len(at) - 2)] = True
    for s, e in zip(start[long], end[long], strict=True):
        a, b = np.searchsorted(at, [s, e - 1], "right") - 1
        out[a : b + 1] = True
    return out


_word = np.zeros(256, bool)
_word[48:58] = _word[65:91] = _word[97:123] = _word[128:] = _word[95] = True
_blank = np.zeros(256, bool)
_blank[[*range(9, 14), *range(28, 33)]] = True
_digit, _upper, _lower, _wide = (np.zeros(256, bool) for _ in range(4))
_digit[48:58] = _upper[65:91] = _lower[97:123] = _wide[128:] = True
_mark = np.zeros(256, bool)
_mark[list(b"=:{}\"'")] = True
OFFSETS = (0, -1, -2, -3, 1, 2)
PARTS = 3


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of words and single marks, and PARTS mixed feature codes of each: characters and length, hex look, the word itself."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, PARTS), np.uint64)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    word, blank = _word[data], _blank[data]
    start = ~blank
    start[1:] &= ~(word[1:] & word[:-1]) | edge[1:-1]
    end = ~blank
    end[:-1] &= ~(word[1:] & word[:-1]) | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    size = e - s

    def share(kind):
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind[data], out=sums[1:])
        return sums[e] - sums[s]

    digits, upper, lower, wide, hexed = map(share, (_digit, _upper, _lower, _wide, _hex))
    length = np.where(size < 8, size, np.minimum(8 + size // 8, 15))
    kinds = (digits > 0) + 2 * (upper > 0) + 4 * (lower > 0) + 8 * (wide > 0)
    mark = np.where(kinds == 0, data[s], 0)
    dense = np.where(size >= 6, np.minimum(4 * digits // size, 3), 4)
    codes = np.empty((len(s), PARTS), np.uint64)
    codes[:, 0] = kinds + 16 * (length + 16 * (dense + 8 * mark.astype(np.int64)))
    codes[:, 1] = 2 * (hexed == size) + (hexed + upper + digits == size) + 4 * length
    codes[:, 2] = np.where((size <= 16) & (digits == 0), RangeHash(LOWER[data])(s, e), 1)
    return s, e, np.searchsorted(at, s, "right") - 1, mix(codes ^ _salt)


_salt = mix(np.arange(1, PARTS + 1, dtype=np.uint64))


def slots_of(mixed: np.ndarray, offset: int) -> np.ndarray:
    """Weight slots of tokens seen from ``offset`` tokens away, from their mixed codes."""
    return (mixed * np.uint64(2 * (offset + 9) * 0x9E3779B97F4A7C15 + 1 & 2**64 - 1) >> np.uint64(48)).astype(np.int64)


def file_slots(data: np.ndarray, keyed: bool, n: int) -> np.ndarray:
    """Features of a whole text: size, share of marks, key words."""
    share = int(200 * np.count_nonzero(_mark[data]) / max(len(data), 1))
    codes = np.array([min(int(log2(n + 1)), 12), 32 + min(share, 6), 64 + keyed], np.uint64)
    return slots_of(mix(codes ^ _salt), 7)


class Crf:
    """Weights of slots for three tags and of tag pairs; text edges count as outside."""

    def __init__(self):
        self.weights = np.zeros((SLOTS, 3), np.float32)
        self.pairs = np.zeros((3, 3))

    def slack(self) -> float:
        """The most that transitions can add when an outside tag is changed."""
        t = self.pairs
        return max(t[x, y] + t[y, z] - t[x, O] - t[O, z] for x in range(3) for y in (B, I) for z in range(3))

    def scores(self, codes: np.ndarray, row: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Tag scores of every token."""
        out = extra[row]
        n = len(row)
        for offset in OFFSETS:
            own = slots_of(codes, offset)
            value = self.weights[own[:, 0]]
            for k in range(1, PARTS):
                value += self.weights[own[:, k]]
            if offset == 0:
                out += value
            elif n > abs(offset):
                here, there = (slice(-offset, n), slice(0, n + offset)) if offset < 0 else (slice(0, n - offset), slice(offset, n))
                out[here] += value[there] * (row[here] == row[there])[:, None]
        return out

    def viterbi(self, score: np.ndarray) -> list[int]:
        best, back = score[0] + self.pairs[O], []
        for s in score[1:]:
            all_ = best[:, None] + self.pairs
            back.append(all_.argmax(axis=0))
            best = all_.max(axis=0) + s
        tags = [int((best + self.pairs[:, O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def tag(self, data: np.ndarray, at: np.ndarray, keyed: list[bool]) -> list[list[tuple[int, int]]]:
        """Secret spans of each text, in bytes from its start."""
        out: list[list[tuple[int, int]]] = [[] for _ in keyed]
        start, end, row, codes = tokens(data, at)
        if not len(start):
            return out
        count = np.bincount(row, minlength=len(keyed))
        extra = np.array([self.weights[file_slots(data[at[k] : at[k + 1]], keyed[k], n)].sum(axis=0) for k, n in enumerate(count.tolist())])
        score = self.scores(codes, row, extra)
        open_ = np.flatnonzero(score[:, O] - score[:, 1:].max(axis=1) <= self.slack() + 1e-3)
        if not len(open_):
            return out
        first = np.flatnonzero(np.r_[True, (np.diff(open_) > 1) | (np.diff(row[open_]) > 0)])
        for a, b in zip(first, np.r_[first[1:], len(open_)], strict=True):
            i, j = open_[a], open_[b - 1] + 1
            r = int(row[i])
            span = None
            for k, t in enumerate([*self.viterbi(score[i:j]), O]):
                if t != I and span:
                    if end[span[1] - 1] - start[span[0]] >= LEAST_VALUE:
                        out[r].append((int(start[span[0]] - at[r]), int(end[span[1] - 1] - at[r])))
                    span = None
                if t != O:
                    span = (span[0] if span else i + k, i + k + 1)
        return out


def window(text: str, spans: list[tuple[int, int]], rng: random.Random) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training windows of 2 * REACH + 1 tokens, as (slots, tags): around values, at most 8 drawn from all, and two elsewhere. File features are the whole text's."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _, codes = tokens(data, np.array([0, len(data)]))
    n = len(start)
    if not n:
        return []
    tags = np.zeros(n, np.int64)
    at = np.arange(len(text) + 1) if text.isascii() else np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]  # byte of each character
    for s, e in spans:
        i, j = np.searchsorted(end, at[s], "right"), np.searchsorted(start, at[e], "left")
        tags[i:j] = I
        tags[i : min(i + 1, j)] = B
    extra = file_slots(data, maybe(text), n)
    values = np.flatnonzero(tags == B).tolist()
    out = []
    for mid in [*(rng.sample(values, 8) if len(values) > 8 else values), rng.randrange(n), rng.randrange(n)]:
        lo = max(0, min(mid - REACH, n - 2 * REACH - 1))
        hi = min(lo + 2 * REACH + 1, n)
        seen = np.full((hi - lo, PARTS * len(OFFSETS) + len(extra)), -1, np.int32)
        seen[:, -len(extra) :] = extra
        for k, offset in enumerate(OFFSETS):
            a, b = max(lo + offset, 0), min(hi + offset, n)
            if b > a:
                seen[a - offset - lo : b - offset - lo, PARTS * k : PARTS * (k + 1)] = slots_of(codes[a:b], offset)
        out.append((seen, tags[lo:hi]))
    return out


def synthetic(context: list[str], rng: random.Random) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated texts with one value each, in other forms than the base patterns know."""
    keys = ["passphrase", "pwd", "auth", "credential", "private_key", "client_key", "access_key", "bearer", "signature", "session_key", "webhook", "password", "token", "secret", "api_key"]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = context or ["the", "value", "of", "a", "line", "and", "text", "with", "some", "more"]
    out = []
    for _ in range(SYNTHETIC):
        left, right = (" ".join(rng.choices(words, k=rng.randrange(4, 14))) for _ in range(2))
        form = rng.randrange(6)
        value = "".join(rng.choices("0123456789abcdef" if form == 0 else letters, k=rng.randrange(16, 44)))
        if form == 1:
            value = rng.choice(["ghx_", "sk-", "xox-", "pk_"]) + value
        elif form == 2:
            value = value[: len(value) // 2] + rng.choice("+/") + value[len(value) // 2 :] + "=="
        if form == 4:  # ordinary assignments, numbers and addresses are no secrets
            text = f"{left} {rng.choice(['color', 'name', 'size', 'id', 'phone', 'ip'])}{rng.choice([' = ', ': ', '='])}{rng.choice(words)} {rng.randrange(10**6)} {rng.randrange(10**15, 10**16)} {right}"
            out.append((text, []))
            continue
        if form == 5:  # nor are long words, said again and again
            word = "".join(rng.choices(words, k=rng.randrange(2, 5)))
            out.append((f"{left} {' '.join([word] * rng.randrange(2, 20))} {right}", []))
            continue
        quote = rng.choice(["", '"', "'"])
        head = f"{left} {rng.choice(keys)}{rng.choice([' = ', ': ', '=', ':', ' '])}{quote}"
        out.append((f"{head}{value}{quote} {right}", [(len(head), len(head) + len(value))]))
    return out


BLOCK_WINDOWS = 1024


def train(examples: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, decay: float = 3e-4) -> Crf:
    """Maximum likelihood by forward-backward over all windows (Adam); each gradient is summed over blocks of BLOCK_WINDOWS, so that memory holds little more than the slots."""
    model = Crf()
    if not examples:
        return model
    n, width, many = len(examples), max(len(t) for _, t in examples), examples[0][0].shape[1]
    gold = np.zeros((n, width), np.int8)
    real = np.zeros((n, width), bool)
    slot = np.full((n, width, many), SLOTS, np.int32)  # the last row of the weights stands for no token
    for i, (own, tags) in enumerate(examples):
        gold[i, : len(tags)], real[i, : len(tags)] = tags, True
        slot[i, : len(tags)] = np.where(own >= 0, own, SLOTS)
    examples.clear()
    flat = np.zeros((SLOTS + 1, 3))
    pairs = np.zeros((3, 3))
    moments = [np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(pairs), np.zeros_like(pairs)]
    one = np.eye(3)
    seen = np.zeros((3, 3))
    before = np.concatenate([np.zeros((n, 1), np.int8), gold[:, :-1]], axis=1)
    np.add.at(seen, (before[real], gold[real]), 1)
    np.add.at(seen, (gold[np.arange(n), real.sum(axis=1) - 1], np.zeros(n, np.int8)), 1)

    def lse(x, axis):
        m = x.max(axis=axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))

    def gradient(slot, gold, real):
        n = len(slot)
        score = np.zeros((n, width, 3))
        for k in range(many):
            score += flat[slot[:, :, k]]
        ahead = np.zeros((n, width, 3))
        ahead[:, 0] = score[:, 0] + pairs[O]
        for k in range(1, width):
            ahead[:, k] = np.where(real[:, k, None], lse(ahead[:, k - 1, :, None] + pairs, 1) + score[:, k], ahead[:, k - 1])
        total = lse(ahead[:, -1] + pairs[:, O], 1)
        back = np.zeros((n, width, 3))
        back[:, -1] = pairs[:, O]
        for k in range(width - 2, -1, -1):
            back[:, k] = np.where(real[:, k + 1, None], lse(pairs + (score[:, k + 1] + back[:, k + 1])[:, None, :], 2), pairs[:, O])
        guess = np.exp(ahead + back - total[:, None, None]) * real[..., None]
        both = np.zeros((3, 3))
        for k in range(1, width):
            p = np.exp(ahead[:, k - 1, :, None] + pairs + (score[:, k] + back[:, k])[:, None, :] - total[:, None, None])
            both += (p * real[:, k, None, None]).sum(axis=0)
        both[O] += guess[:, 0].sum(axis=0)
        both[:, O] += guess[np.arange(n), real.sum(axis=1) - 1].sum(axis=0)
        diff = (guess - one[gold] * real[..., None]).reshape(-1, 3)
        own = slot.reshape(-1)
        return np.column_stack([np.bincount(own, np.repeat(diff[:, y], many), SLOTS + 1) for y in range(3)]), both

    for t in range(1, rounds + 1):
        g, both = np.zeros_like(flat), np.zeros((3, 3))
        for i in range(0, n, BLOCK_WINDOWS):
            some = slice(i, i + BLOCK_WINDOWS)
            more, pair = gradient(slot[some], gold[some], real[some])
            g += more
            both += pair
        g[SLOTS] = 0
        g, g_pairs = g / n + decay * flat, (both - seen) / n + decay * pairs
        for x, grad, m, v in ((flat, g, moments[0], moments[1]), (pairs, g_pairs, moments[2], moments[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model.weights[:] = flat[:SLOTS]
    model.pairs = pairs
    return model


def drawn_windows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, text, found, slots, tags): the windows of at most about MOST_TEXTS hash-drawn texts, cut from whole texts where they lie; ``text`` is some first words of one without spans."""
    share = min(1.0, MOST_TEXTS / max(docs.count(), 1))
    drawn = docs.filter(F.col(text).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(share * 1_000_000))).select(key, text)

    def run(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                found = base_spans(t)
                if found or zlib.crc32(str(i).encode()) % 8 == 0:
                    own = window(t, [(a, b) for _, _, _, a, b in found], random.Random(zlib.crc32(t.encode())))
                    rows.append((i, " ".join(t[:4000].split()[:40]), bool(found), [x.astype(np.int32).tobytes() for x, _ in own], [y.astype(np.int8).tobytes() for _, y in own]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [batch.column(key).type, pa.string(), pa.bool_(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "text", "found", "slots", "tags"])

    kind = docs.schema[key].dataType.simpleString()
    return drawn.mapInArrow(run, f"id {kind}, text string, found boolean, slots array<binary>, tags array<binary>")


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Crf:
    """Learn from base spans in hash-drawn texts: windows around values and two others per text, with or without values."""
    rows = drawn_windows(docs, text, key).orderBy(F.xxhash64("id"), "text", "slots").limit(MOST_WINDOWED).collect()
    rng = random.Random(4)
    context = [w for r in rows[:300] if not r["found"] for w in r["text"].split()]
    examples = [(np.frombuffer(x, np.int32).reshape(len(y), -1), np.frombuffer(y, np.int8)) for r in rows for x, y in zip(r["slots"], r["tags"], strict=True)]
    examples += [w for t, s in synthetic(context, rng) for w in window(t, s, rng)]
    return train(examples)


def scan(docs: DataFrame, model: Crf, text: str = "text", column: str = "secrets") -> DataFrame:
    """All columns of ``docs`` and ``column``, an array of (kind, start, end) in order of start, then kind."""
    from pyspark.sql import types as T

    docs = docs.drop(column)

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch, text):
                texts = [t or "" for t in part.column(text).to_pylist()]
                hexed = has_hex(data, at)
                keyed = [maybe(t) for t in texts]
                base = [base_spans(t) if h or m else [] for t, h, m in zip(texts, hexed, keyed, strict=True)]
                out = []
                for t, spans, more in zip(texts, base, model.tag(data, at, keyed), strict=True):
                    own = [(s, k, e) for s, k, e, _, _ in spans]
                    if more and not t.isascii():
                        raw = t.encode()
                        more = [(len(raw[:s].decode()), len(raw[:e].decode())) for s, e in more]
                    own += [(s, 3, e) for s, e in more if not any(s < y and x < e for x, _, y, _, _ in spans)]
                    out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(own)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], [*part.schema.names, column])

    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(item))]))


def redact(docs: DataFrame, model: Crf, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of every text replaced; overlapping spans become one mark."""

    def run(batches):
        for batch in batches:
            texts = []
            for t, spans in zip(batch.column(text).to_pylist(), batch.column("_secrets_found").to_pylist(), strict=True):
                if spans:
                    parts, at = [], 0
                    for s in spans:
                        if s["start"] >= at:
                            parts += [t[at : s["start"]], mark]
                        at = max(at, s["end"])
                    t = "".join([*parts, t[at:]])
                texts.append(t)
            names = [x for x in batch.schema.names if x != "_secrets_found"]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if x == text else batch.column(x) for x in names], names)

    return scan(docs, model, text, "_secrets_found").mapInArrow(run, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    some = docs.select("doc_id", "text")
    found = scan(some, fit(some))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
