"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the documents into segments, as a search engine does, and
stores for each segment the postings (term, sorted word positions) of all its
terms; it knows nothing of the test set, so one index serves any. ``search``
reads the stored segments alone: for each window it starts from the rarest of
its terms in the segment, shifts its positions back by the term's offset, and
intersects with the shifted lists of the other terms in order of their lengths.
``slop`` turns exact phrases into proximity matches: each term may then stand up
to ``slop`` words after its exact place.

The test set is read row by row and searched in blocks of MOST_BROADCAST
windows; the driver and every task hold one block.

Rows are told apart by segment and place in it, never by id: repeated, clashing
and null ids stay rows of their own. Ids may be of any type. A very long text
makes a segment of its own.

Null or wordless texts have no words and are never hit; an item id that repeats
is reported once, whichever of its texts occurs; repeated documents are each
reported; an empty table gives no rows; terms are compared by 64-bit hashes, never
as words; items without words match nothing; what an item without an id
covers is hit, but no item is named for it. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, RangeHash, materialise, slices, words

WINDOW = 10
MOST_BROADCAST = 500_000
SEGMENT_BYTES = 4 << 20

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def terms(data: np.ndarray, at: np.ndarray):
    """Hash and row of every word."""
    low = LOWER[data]
    start, end, row = words(low, at, IS_WORD)
    return RangeHash(low)(start, end), row


def windows_of(text: str | None, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes (n, size; absent ones 0) and length of each distinct window of an item."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    hashes, _ = terms(raw, np.array([0, len(raw)]))
    n = max(1, len(hashes) - size + 1) if len(hashes) else 0
    out = np.zeros((n, size), np.uint64)
    for k in range(min(size, len(hashes))):
        out[:, k] = hashes[k : k + n]
    out = np.unique(out, axis=0)
    return out, np.full(len(out), min(size, len(hashes)))


def window_blocks(items) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, window terms, window lengths and places of the windows' ids, in blocks of MOST_BROADCAST windows; a long item may be cut between two of its windows."""
    names, held, n = [], [], 0
    for item, text in items:
        hashes, length = windows_of(text)
        at = 0
        while at < len(length):
            if not at or not n:
                names.append(item)
            some = slice(at, at + MOST_BROADCAST - n)
            held.append((hashes[some], length[some], np.full(len(length[some]), len(names) - 1)))
            at, n = at + len(held[-1][1]), n + len(held[-1][1])
            if n == MOST_BROADCAST:
                yield names, *(np.concatenate(x) for x in zip(*held, strict=True))
                names, held, n = [], [], 0
    if n:
        yield names, *(np.concatenate(x) for x in zip(*held, strict=True))


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per segment: ids and word counts of its documents, its terms in order and the positions of each.
    Positions count the words of the segment, with a gap of WINDOW between documents."""
    kind = docs.schema[key].dataType.simpleString()

    def segment(name, ids, counts, where, term):
        order = np.argsort(term, kind="stable")
        term, where = term[order], where[order]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        raw = [np.concatenate(counts).astype(np.int64), term[first], np.r_[first, len(term)].astype(np.int64), where.astype(np.int64 if len(where) and where.max() >= 2**31 else np.int32)]
        own = pa.concat_arrays(ids)
        whole = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), whole, *[pa.array([x.tobytes()], pa.binary()) for x in raw]], ["segment", "ids", "n_words", "terms", "lists", "positions"])

    def run(batches):
        def empty():
            return [], [], [], [], 0, 0

        name = TaskContext.get().partitionId() << 32
        ids, counts, where, term, base, size = empty()
        for batch in batches:
            for part, data, at in slices(batch, text):
                hashes, row = terms(data, at)
                ids.append(part.column(key))
                counts.append(np.bincount(row, minlength=part.num_rows))
                where.append(np.arange(len(hashes)) + row * WINDOW + base)
                term.append(hashes)
                base += len(hashes) + part.num_rows * WINDOW
                size += len(data)
                if size > SEGMENT_BYTES:
                    yield segment(name, ids, counts, np.concatenate(where), np.concatenate(term))
                    name += 1
                    ids, counts, where, term, base, size = empty()
        if ids:
            yield segment(name, ids, counts, np.concatenate(where), np.concatenate(term))

    return docs.select(key, text).mapInArrow(run, f"segment long, ids array<{kind}>, n_words binary, terms binary, lists binary, positions binary")


def _near(positions: np.ndarray, starts: np.ndarray, slop: int) -> np.ndarray:
    """Whether a position lies in [start, start + slop], for each start."""
    i = np.searchsorted(positions, starts)
    return (i < len(positions)) & (positions[np.minimum(i, len(positions) - 1)] <= starts + slop)


def _positions(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64 if len(raw) == 8 * n else np.int32)


def search_segment(seg: dict, vocabulary: np.ndarray, windows: np.ndarray, length: np.ndarray, slop: int = 0):
    """(window, start position) of every match in a segment; ``windows`` holds places in the sorted ``vocabulary``."""
    known, lists = np.frombuffer(seg["terms"], np.uint64), np.frombuffer(seg["lists"], np.int64)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(known) or not len(windows):
        return none
    positions = _positions(seg["positions"], int(lists[-1]))
    slot = np.minimum(np.searchsorted(known, vocabulary), len(known) - 1)
    many = np.where(known[slot] == vocabulary, lists[slot + 1] - lists[slot], 0)
    used = np.arange(windows.shape[1]) < length[:, None]
    size = np.where(used, many[windows], np.iinfo(np.int64).max)
    some = np.flatnonzero(size.min(axis=1) > 0)
    order = np.argsort(size[some], axis=1, kind="stable")
    which, start = [], []
    for w, by in zip(some, order, strict=True):
        at = None
        for offset in by[: length[w]]:
            k = slot[windows[w, offset]]
            own = positions[lists[k] : lists[k + 1]]
            if at is None:
                # with slop the rarest term may stand late, so its start is moved back as far
                at = np.unique((own.astype(np.int64) - offset)[:, None] - np.arange(slop + 1)) if slop else own.astype(np.int64) - offset
            else:
                at = at[_near(own, at + offset, slop)]
            if not len(at):
                break
        if len(at):
            which.append(np.full(len(at), w))
            start.append(at)
    return (np.concatenate(which), np.concatenate(start)) if which else none


def search(index: DataFrame, block: tuple[list, np.ndarray, np.ndarray, np.ndarray], kind, slop: int = 0) -> DataFrame:
    """(segment, place, spans, items): the rows of the index that a block of windows hits, the words covered (starts and
    ends) and the items that occur, whose ids have the type ``kind``."""
    names, hashes, length, owner = block
    vocabulary, windows = np.unique(hashes, return_inverse=True)
    windows = windows.reshape(hashes.shape).astype(np.int32)
    item = to_arrow_type(kind)
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches):
        for batch in batches:
            for seg in batch.to_pylist():
                counts = np.frombuffer(seg["n_words"], np.int64)
                base = np.zeros(len(counts) + 1, np.int64)
                np.cumsum(counts + WINDOW, out=base[1:])
                which, start = search_segment(seg, vocabulary, windows, length, slop)
                row = np.searchsorted(base, start, "right") - 1
                reach = length[which] + slop
                fits = (row >= 0) & (start >= base[row]) & (start + length[which] <= base[row] + counts[row]) if len(row) else np.zeros(0, bool)
                which, start, row, reach = which[fits], start[fits], row[fits], reach[fits]
                stop = np.minimum(start + reach, base[row] + counts[row])
                order = np.lexsort((start, row))
                spans: dict[int, list[dict]] = {}
                items: dict[int, set] = {}
                for r, w, a, b in zip(row[order].tolist(), which[order].tolist(), (start - base[row])[order].tolist(), (stop - base[row])[order].tolist(), strict=True):
                    own = spans.setdefault(r, [])
                    items.setdefault(r, set()).update(x for x in [names[owner[w]]] if x is not None)
                    if own and a <= own[-1]["stop"]:
                        own[-1]["stop"] = max(b, own[-1]["stop"])
                    else:
                        own.append({"start": a, "stop": b})
                if spans:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([seg["segment"]] * len(spans)), pa.array(list(spans)), pa.array(list(spans.values()), pa.list_(span)), pa.array([sorted(x, key=str) for x in items.values()], pa.list_(item))],
                        ["segment", "place", "spans", "items"],
                    )

    read = index.select("segment", "n_words", "terms", "lists", "positions")
    return read.mapInArrow(run, f"segment long, place long, spans array<struct<start: long, stop: long>>, items array<{kind.simpleString()}>")


def indexed(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(segment, place, id, n_words) of every row of the index."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                counts = np.frombuffer(batch.column("n_words")[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), batch.column("segment")[k].as_py())), pa.array(np.arange(len(counts))), batch.column("ids")[k].values, pa.array(counts)], ["segment", "place", key, "n_words"])

    return index.select("segment", "ids", "n_words").mapInArrow(run, f"segment long, place long, {key} {kind}, n_words long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, slop: int = 0, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents with the word spans that test windows cover and the items they come from."""
    index = materialise(build_index(docs, text, key), "postings")
    kind = benchmark.schema[item].dataType
    found = [materialise(search(index, block, kind, slop), "hits") for block in window_blocks((r[0], r[1]) for r in benchmark.select(item, item_text).toLocalIterator())]
    rows = indexed(index, key)
    if not found:
        return rows.select(key, "n_words", F.expr("array()").cast("array<struct<start: long, stop: long>>").alias("spans"), F.expr("array()").cast(f"array<{kind.simpleString()}>").alias("items"))
    hits = reduce(DataFrame.unionByName, found).groupBy("segment", "place").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = rows.join(hits, ["segment", "place"], "left")
    return joined.select(key, "n_words", *[F.coalesce(c, F.array()).alias(c) for c in ("spans", "items")])


def covered(spans: str = "spans"):
    """Number of words in the union of (start, stop) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["stop"]).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["n"])


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digest of what ``decontaminate`` returns."""
    named = F.array_sort(F.col("items").cast("array<string>"))
    return found.select(
        key,
        "n_words",
        covered().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], size: int = WINDOW) -> list[tuple]:
    """The same report by plain comparison of word lists, for tests."""
    import re

    def cut(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wanted: dict[tuple[str, ...], set[int]] = {}
    for item, text in items:
        w = cut(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wanted.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = cut(text), set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(w) - n + 1):
                if (got := wanted.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= got
        found.discard(None)
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out
