"""Removal of repeated byte strings by a run-length Burrows-Wheeler index.

A byte goes if a LENGTH-byte string covers it that also starts earlier (in a
smaller doc_id, or in the same document further left).

1. Every LENGTH-byte window has a minimizer, the least hashed K-byte string in
   it. Neighbouring windows with one minimizer form a stretch; equal windows
   always have equal minimizers, so a window need only be compared with the
   stretches of its minimizer. Only hashes of stretches are shuffled.
2. Of equal stretches all but the first go at once: this much is settled by two
   64-bit hashes (of the minimizer and of the whole stretch), not by the index.
   A minimizer with a single kind of stretch is done. What is left are the first
   stretches of minimizers that stand in different surroundings: the ends of
   repeats.
3. Their bytes are fetched and indexed, bucket by bucket: a run-compressed
   Burrows-Wheeler transform that keeps, for each run, its symbol and the text
   positions at its two ends. From these samples alone every position gets, as
   the text is streamed, its matching statistics: the position of its neighbour
   in suffix order and the length that both have in common. Between two samples
   the position grows and the length shrinks by one a byte. Windows whose match
   has LENGTH bytes or more are chained to their neighbour, and all of a chain
   but its first position are marked.
4. A minimizer with more than HOT such stretches is too large for a bucket; its
   windows are compared by two 64-bit hashes in a distributed sort instead.

A document is looked at in slices that overlap by LENGTH - 1 bytes, so length is
no limit. Null and empty texts have no bytes and no spans; texts shorter than
LENGTH lose nothing; an empty table gives no rows. Of equal strings at one id the
one further left is the first. Rows come
in the order of their ids, null last; rows of one id, or without one, in the
order of a hash of the text, each a document of its own. Rows that repeat both id
and text are one document and lose the same bytes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, materialise, mix, slices, sweep

LENGTH = 100
K = 32
SPAN = LENGTH - K + 1
BUCKET = 1 << 19
HOT = 5000
LAST = 2**63 - 1
PIECE = 1 << 20
MEMO = 1 << 17
"""Repeated stretches whose first place a task remembers, so that a line of all documents is put out about once a task."""


def window_minima(h: np.ndarray, span: int) -> np.ndarray:
    """Least of every ``span`` neighbours, from running minima of blocks."""
    n = len(h) - span + 1
    if n <= 0:
        return h[:0]
    m = -(-len(h) // span) * span
    blocks = np.full(m, np.iinfo(h.dtype).max, h.dtype)
    blocks[: len(h)] = h
    ahead = np.minimum.accumulate(blocks.reshape(-1, span), axis=1).ravel()
    back = np.minimum.accumulate(blocks.reshape(-1, span)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[span - 1 : span - 1 + n])


def stretches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(minimizer hash, content hash, row, start in the row, windows) of every stretch."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(data) < LENGTH:
        return none
    hashed = RangeHash(data)
    place = np.arange(len(data) - K + 1)
    grams = hashed(place, place + K)
    # the place below the hash tells equal grams apart, leftmost first
    low = np.uint64(max(1, int(len(data)).bit_length()))
    least = window_minima((grams >> low << low) | place.astype(np.uint64), SPAN)
    where = (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    fit = np.diff(at) >= LENGTH
    np.add.at(inside, at[:-1][fit], 1)
    np.add.at(inside, at[1:][fit] - LENGTH + 1, -1)
    valid = np.cumsum(inside[: len(where)]) > 0
    if not valid.any():
        return none
    row = np.searchsorted(at, np.arange(len(where)), "right") - 1
    new = valid.copy()
    new[1:] &= (where[1:] != where[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new)
    count = np.add.reduceat(valid.astype(np.int64), start)
    content = mix(hashed(start, start + count + LENGTH - 1) + count.astype(np.uint64))
    return grams[where[start]], content, row[start], start - at[row[start]], count


def pieces(batch: pa.RecordBatch, text: str):
    """Slices of a batch; documents over PIECE bytes come in overlapping parts, with the part's offset."""
    for part, data, at in slices(batch, text):
        if len(data) <= 2 * PIECE or part.num_rows > 1:
            yield part, data, at, 0
        else:
            for lo in range(0, len(data) - LENGTH + 1, PIECE):
                own = data[lo : lo + PIECE + LENGTH - 1]
                yield part, own, np.array([0, len(own)]), lo


STRETCH = "key long, content long, doc long, row long, start int, windows int, gone boolean"


def _batch(key, content, doc, row, start, windows, gone) -> pa.RecordBatch:
    arrays = [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc), pa.array(row), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(gone)]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in STRETCH.split(", ")])


def _later(key, content, doc, row, start) -> np.ndarray:
    """Rows that have an equal (key, content) at an earlier (doc, row, start)."""
    order = np.lexsort((start, row, doc, content, key))
    k, c, d, r, s = key[order], content[order], doc[order], row[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.zeros(len(order), bool)
    out[order] = (d != d[first]) | (r != r[first]) | (s != s[first])
    return out


class _Memo:
    """First places of stretches that occurred twice in a slice, as a sorted table."""

    def __init__(self):
        self.table = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def later(self, name, doc, row, start) -> np.ndarray:
        """Which of the stretches have an earlier place in the table."""
        known, d, r, s = self.table
        if not len(known):
            return np.zeros(len(name), bool)
        at = np.minimum(np.searchsorted(known, name), len(known) - 1)
        after = (doc > d[at]) | (doc == d[at]) & ((row > r[at]) | (row == r[at]) & (start > s[at]))
        return (known[at] == name) & after

    def add(self, name, doc, row, start):
        own = [name, doc, row, start]
        if len(self.table[0]) > MEMO:
            self.table = own
        both = [np.concatenate(x) for x in zip(self.table, own, strict=True)]
        order = np.lexsort(both[::-1])
        both = [x[order] for x in both]
        fresh = np.ones(len(order), bool)
        fresh[1:] = both[0][1:] != both[0][:-1]
        self.table = [x[fresh] for x in both]


def _number(key: str) -> Column:
    """The id as a number; what is none, null too, comes after all numbers, and there rows are in the order of their hash."""
    return F.coalesce(F.col(key).try_cast("long"), F.lit(LAST))


def _row(text: str, key: str) -> Column:
    """A hash of the text, and of an id that is no number."""
    return F.xxhash64(F.col(text), F.when(F.col(key).try_cast("long").isNull(), F.col(key).cast("string")))


def _named(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc (the id as a number), row (a hash of the text) and the text."""
    return docs.select(_number(key).alias("doc"), _row(text, key).alias("row"), F.col(text).alias("text"))


def stretch_table(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Stretches of all documents; repeats that a task sees are marked gone and spread by place."""

    def run(batches):
        memo = _Memo()
        for batch in batches:
            for part, data, at, lo in pieces(batch, "text"):
                gram, content, own, start, windows = stretches(data, at)
                doc, row, start = np.asarray(part.column("doc"))[own], np.asarray(part.column("row"))[own], start + lo
                name = mix(gram ^ content * np.uint64(0x9E3779B97F4A7C15))
                twice = _later(gram, content, doc, row, start)
                gone = twice | memo.later(name, doc, row, start)
                if twice.any():
                    hot = np.isin(name, name[twice]) & ~twice
                    memo.add(name[hot], doc[hot], row[hot], start[hot])
                spread = mix(doc.astype(np.uint64) * np.uint64(2654435761) + start.astype(np.uint64))
                yield _batch(np.where(gone, spread, gram), content, doc, row, start, windows, gone)

    return _named(docs, text, key).mapInArrow(run, STRETCH)


def settle(rows: DataFrame) -> DataFrame:
    """One streaming pass over sorted partitions: ``gone`` for all but the first of equal stretches, and the first
    stretches of keys with several contents, not gone. Holds one row between batches."""

    def run(batches):
        held, held_many, held_said = None, False, True
        for batch in batches:
            gone = np.asarray(batch.column("gone").to_numpy(zero_copy_only=False))
            key, content, doc, row, start, windows = (np.asarray(batch.column(k)) for k in ("key", "content", "doc", "row", "start", "windows"))
            yield _batch(key[gone], content[gone], doc[gone], row[gone], start[gone], windows[gone], gone[gone])
            key, content, doc, row, start, windows = (x[~gone] for x in (key, content, doc, row, start, windows))
            if not len(key):
                continue
            ghost = held is not None
            if ghost:
                key, content, doc, row, start, windows = (np.r_[h, x] for h, x in zip(held, (key, content, doc, row, start, windows), strict=True))
            n = len(key)
            new_key = np.r_[True, key[1:] != key[:-1]]
            new = new_key.copy()
            new[1:] |= content[1:] != content[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            later = (doc != doc[first]) | (row != row[first]) | (start != start[first])
            group = np.cumsum(new_key) - 1
            many = np.bincount(group, new) > 1
            many[0] |= ghost and held_many
            ambiguous = new & many[group]
            if ghost and held_said:
                ambiguous[0] = False
            out = later | ambiguous
            yield _batch(key[out], content[out], doc[out], row[out], start[out], windows[out], later[out])
            last = first[-1]
            held = [x[last : last + 1] for x in (key, content, doc, row, start, windows)]
            held_many = bool(many[-1])
            held_said = bool(many[-1])

    return rows.repartition("key").sortWithinPartitions("key", "content", "doc", "row", "start").mapInArrow(run, STRETCH)


def suffix_order(text: np.ndarray, left: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling. ``left`` is the distance to the end of the string, ``owner`` its
    number: ends count as different symbols in the order of their strings."""
    n, depth = len(text), 4
    code = np.zeros(n, np.int64)
    padded = np.r_[text, np.zeros(depth, np.int64)]
    for k in range(depth):
        code = code << 9 | np.where(left >= k, padded[k : k + n], 0)
    while True:
        order = np.argsort(code)
        sorted_ = code[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, sorted_[1:] != sorted_[:-1]])
        if rank[order[-1]] == n - 1:
            return order
        after = owner.copy()
        far = np.flatnonzero(left >= depth)
        after[far] = rank[far + depth]
        code = rank * n + after
        depth *= 2


COMPARED = 32


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols the text has in common from places ``a`` and ``b`` on, ``most`` at most."""
    length = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    padded = np.r_[text, np.zeros(COMPARED, text.dtype)]
    wide = np.lib.stride_tricks.sliding_window_view(padded, COMPARED)
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        differ = wide[x] != wide[y]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), COMPARED)
        length[live] = np.minimum(length[live] + same, most[live])
        live = live[(same == COMPARED) & (length[live] < most[live])]
    return length


class RunIndex:
    """Run-compressed transform of a set of strings: symbol of each run and the text positions at its first and last
    place, with the length that the first has in common with the place before it."""

    def __init__(self, strings: list[np.ndarray]):
        self.size = np.array([len(s) for s in strings])
        self.end = np.cumsum(self.size + 1) - 1
        text = np.zeros(self.end[-1] + 1, np.int64)
        body = np.ones(len(text), bool)
        body[self.end] = False
        text[body] = np.concatenate(strings).astype(np.int64) + 1
        self.owner = np.repeat(np.arange(len(strings)), self.size + 1)
        left = self.end[self.owner] - np.arange(len(text))
        order = suffix_order(text, left, self.owner)
        symbols = text[order - 1]
        # the ends of strings differ, so each is a run of its own
        first = np.flatnonzero(np.r_[True, (symbols[1:] != symbols[:-1]) | (symbols[1:] == 0)])
        self.run_symbol = symbols[first]
        self.run_start_sample = order[first]
        self.run_end_sample = order[np.r_[first[1:], len(order)] - 1]
        here, before = self.run_start_sample[1:], self.run_end_sample[:-1]
        self.run_common = np.r_[0, common(text.astype(np.uint16), here, before, np.minimum(left[here], left[before]))]

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every text position: the one before it in suffix order, and the length that both have in common."""
        n = len(self.owner)
        by = np.argsort(self.run_start_sample)
        sample, before, length = self.run_start_sample[by], np.r_[-1, self.run_end_sample[:-1]][by], self.run_common[by]
        run = np.repeat(np.arange(len(sample)), np.diff(np.r_[sample, n]))
        gone = np.arange(n) - sample[run]
        return before[run] + gone, np.maximum(length[run] - gone, 0)

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """(string, start) of every window that also starts earlier in the text."""
        before, length = self.statistics()
        long = np.flatnonzero(length >= LENGTH)
        head = np.arange(len(length))
        head[long] = before[long]
        while True:
            further = head[head]
            if (further == head).all():
                break
            head = further
        least = np.arange(len(length))
        np.minimum.at(least, head[long], long)
        chained = np.unique(np.r_[long, head[long]])
        hit = chained[least[head[chained]] < chained]
        string = self.owner[hit]
        return string, hit - (self.end[string] - self.size[string])


def fetch(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """(key, doc, row, start, body): the bytes of the ``wanted`` stretches."""
    lists = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("key", "start", "windows")).alias("list"))
    texts = _named(docs, text, key)

    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                keys, places, starts, bodies = [], [], [], []
                for k, own in enumerate(part.column("list")):
                    items = own.values
                    raw = data[at[k] : at[k + 1]].tobytes()
                    s, w = items.field("start").to_pylist(), items.field("windows").to_pylist()
                    fits = [i + j + LENGTH - 1 <= len(raw) for i, j in zip(s, w, strict=True)]
                    keys.append(np.asarray(items.field("key"))[fits])
                    places += [k] * sum(fits)
                    starts += [i for i, ok in zip(s, fits, strict=True) if ok]
                    bodies += [raw[i : i + j + LENGTH - 1] for i, j, ok in zip(s, w, fits, strict=True) if ok]
                places = pa.array(places, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), part.column("doc").take(places), part.column("row").take(places), pa.array(starts, pa.int32()), pa.array(bodies, pa.binary())], ["key", "doc", "row", "start", "body"])

    return texts.join(lists, ["doc", "row"]).mapInArrow(run, "key long, doc long, row long, start int, body binary")


SPANS = "doc long, row long, start int, windows int"


def index_marks(bodies: DataFrame) -> DataFrame:
    """Marked windows of stretches, bucket by bucket of whole keys."""

    def marked(key, doc, row, start, body):
        order = np.lexsort((start, row, doc))
        doc, row, start = doc[order], row[order], start[order]
        # rows that repeat an id and a text have equal stretches at equal places; the first stands for all
        own = np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1])]
        doc, row, start, order = doc[own], row[own], start[own], order[own]
        which, offset = RunIndex([np.frombuffer(body[k], np.uint8) for k in order]).marks()
        if not len(which):
            return None
        new = np.r_[True, (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)]
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(which)])
        at = which[first]
        return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(row[at]), pa.array((start[at] + offset[first]).astype(np.int32)), pa.array(count.astype(np.int32))], ["doc", "row", "start", "windows"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            key = np.asarray(batch.column("key"))
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            bytes_ = np.fromiter((len(x.as_buffer()) for x in batch.column("body")), np.int64, len(key))
            total = np.r_[0, np.cumsum(bytes_)]
            at = 0
            for e in edges:
                ended = not held or key[e] != held[-1][0][-1] if e == 0 else True
                if e > at:
                    held.append(cut(batch, at, e))
                    size += total[e] - total[at]
                    at = e
                if size > BUCKET and ended:
                    out = marked(*(join(held)))
                    held, size = [], 0
                    if out is not None:
                        yield out
            held.append(cut(batch, at, len(key)))
            size += total[-1] - total[at]
        if held:
            out = marked(*(join(held)))
            if out is not None:
                yield out

    def cut(batch, i, j):
        part = batch.slice(i, j - i)
        return np.asarray(part.column("key")), np.asarray(part.column("doc")), np.asarray(part.column("row")), np.asarray(part.column("start")), [x.as_buffer() for x in part.column("body")]

    def join(held):
        return (*(np.concatenate([x[k] for x in held]) for k in range(4)), [b for x in held for b in x[4]])

    return bodies.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPANS)


def window_rows(bodies: DataFrame) -> DataFrame:
    """Every window of the given stretches by two hashes, as rows that ``settle`` takes."""

    def run(batches):
        for batch in batches:
            at = np.r_[0, np.cumsum([len(x.as_buffer()) for x in batch.column("body")])]
            data = np.frombuffer(b"".join(batch.column("body").to_pylist()), np.uint8)
            size = np.diff(at) - LENGTH + 1
            row = np.repeat(np.arange(len(size)), size)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            place = at[row] + offset
            hashed = RangeHash(data)
            start = np.asarray(batch.column("start"))[row] + offset
            one, two = hashed(place, place + LENGTH), mix(hashed(place, place + K) + hashed(place + 50, place + LENGTH) * np.uint64(3))
            yield _batch(one, two, np.asarray(batch.column("doc"))[row], np.asarray(batch.column("row"))[row], start, np.ones(len(row)), np.zeros(len(row), bool))

    return bodies.mapInArrow(run, STRETCH)


def repeated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, row, start, windows): runs of windows that also start earlier, with the names that ``_named`` gives to texts."""
    settled = materialise(settle(stretch_table(docs, text, key)), "stretches")
    sweep(docs.sparkSession)
    open_ = settled.filter(~F.col("gone"))
    sizes = materialise(open_.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"), "hot-keys")
    bodies = materialise(fetch(docs, open_, text, key), "ends")
    sweep(docs.sparkSession)
    few = index_marks(bodies.join(sizes, "key", "left_anti"))
    many = settle(window_rows(bodies.join(sizes, "key", "left_semi"))).filter("gone")
    return settled.filter("gone").select("doc", "row", "start", "windows").unionByName(few).unionByName(many.select("doc", "row", "start", "windows"))


def strip(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, spans removed (start, end; maximal) and the kept bytes."""
    lists = repeated(docs, text, key).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "windows")).alias("list"))
    texts = docs.select(F.col(key), _number(key).alias("doc"), _row(text, key).alias("row"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                spans, kept = [], []
                for k, own in enumerate(part.column("list")):
                    raw = data[at[k] : at[k + 1]]
                    if own.is_valid and len(own.values):
                        start = np.minimum(np.asarray(own.values.field("start")).astype(np.int64), len(raw))
                        end = np.minimum(start + np.asarray(own.values.field("windows")) + LENGTH - 1, len(raw))
                        step = np.zeros(len(raw) + 1, np.int32)
                        np.add.at(step, start, 1)
                        np.add.at(step, end, -1)
                        inside = np.cumsum(step[:-1]) > 0
                        edge = np.diff(np.r_[False, inside, False].astype(np.int8))
                        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
                        raw = raw[~inside]
                    else:
                        spans.append([])
                    kept.append(raw.tobytes())
                item = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(np.diff(at)), pa.array(spans, item), pa.array(kept, pa.binary())], [key, "n_bytes", "spans", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return texts.join(lists, ["doc", "row"], "left").select(key, "text", "list").mapInArrow(run, f"{key} {kind}, n_bytes long, spans array<struct<start: int, end: int>>, kept binary")


def report(docs: DataFrame) -> DataFrame:
    found = strip(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The same report by a table of all windows, for tests."""
    import xxhash

    first: dict[bytes, tuple] = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    named = [((LAST if i is None else i, (xxhash.xxh64_intdigest(b, seed=42) + 2**63) % 2**64), b) for i, b in raw]
    for name, b in named:
        for k in range(len(b) - LENGTH + 1):
            w = b[k : k + LENGTH]
            if w not in first or (name, k) < first[w]:
                first[w] = (name, k)
    out = []
    for (i, _), (name, b) in zip(raw, named, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - LENGTH + 1):
            if first[b[k : k + LENGTH]] < (name, k):
                gone[k : k + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
