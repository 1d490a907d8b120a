"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import table  # noqa: F401
from ..sources.store import drop, shared_dir

SLICE_BYTES = 1 << 19
"""Text handled at once inside a batch; a longer document is its own slice."""


_written: list[list[str]] = [[]]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[-1].append(path)
    atexit.register(drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for tables that nothing reads any more."""
    for t in tables:
        drop(t.sparkSession, t._folder)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that are gone: it does so when the driver's JVM collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch():
    """Tables written inside are deleted at the end, but for those given to the function that this yields."""
    kept: list[str] = []
    _written.append([])
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        yield lambda *tables: kept.extend(t._folder for t in tables)
    finally:
        for path in _written.pop():
            if path in kept:
                _written[-1].append(path)
            else:
                drop(spark, path)
        sweep(spark)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` bytes of text, one row at least."""
    data, at = utf8(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


_rng = np.random.default_rng(0x5EED)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        out = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n > 4 * SLICE_BYTES:
            return out
        _powers[name] = out
    return _powers[name][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class RangeHash:
    """Hashes of any byte ranges of one flat text, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * _power(BASE, len(data), "up"), out=self.sums[1:])
        self.back = _power(BASE_INVERSE, len(data) + 1, "down")

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def words(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; runs stop at row ends."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(at, s, "right") - 1


def held_out(doc_id: str = "doc_id"):
    """Rows kept out of learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


BATCH_BYTES = 4 << 20
"""Bytes of an Arrow batch: rows may hold whole texts or sets, so a count of rows bounds nothing."""


WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(2 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


_sent: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Send this package to the Python workers, and let them get batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    # workers give large arrays back to the system as soon as they are freed, as idle ones are kept by the executor
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    context = spark.sparkContext.applicationId
    if context not in _sent:
        _sent.add(context)
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        # the driver serves the archive to every executor, so they need no folder of the driver's
        archive = os.path.join(tempfile.mkdtemp(prefix="chronolex-"), f"{os.path.basename(package)}-{uuid.uuid4().hex}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, files in os.walk(package):
                for x in files:
                    if x.endswith(".py"):
                        path = os.path.join(folder, x)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        spark.sparkContext.addPyFile(archive)


BLOOM_BITS = 26
BLOOM_CHUNK = 1 << 20


def _bloom_places(ids: np.ndarray) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64) ^ np.uint64(0xB10F))
    size = np.uint64(64 - BLOOM_BITS)
    return np.stack([h >> size, (h * BASE) >> size, (h * BYTE_CODE[7]) >> size]).astype(np.int64)


def bloom(ids: DataFrame) -> np.ndarray:
    """Bloom filter of a column of longs, 2**BLOOM_BITS bits at any size; built in tasks and merged chunk by chunk."""

    def rows(chunks: dict[int, np.ndarray]):
        return pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([x.tobytes() for x in chunks.values()], pa.binary())], ["chunk", "bits"])

    def local(batches):
        found = [np.unique(_bloom_places(np.asarray(b.column(0)))) for b in batches if b.num_rows]
        if found:
            place = np.unique(np.concatenate(found))
            chunks = {}
            for c in np.unique(place // BLOOM_CHUNK).tolist():
                bits = np.zeros(BLOOM_CHUNK, bool)
                bits[place[place // BLOOM_CHUNK == c] % BLOOM_CHUNK] = True
                chunks[c] = np.packbits(bits)
            yield rows(chunks)

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, raw in zip(b.column("chunk").to_pylist(), b.column("bits"), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.uint8)
                total[c] = total[c] | x if c in total else x
        yield rows(total)

    out = np.zeros((1 << BLOOM_BITS) // 8, np.uint8)
    parts = (1 << BLOOM_BITS) // BLOOM_CHUNK
    for r in ids.mapInArrow(local, "chunk int, bits binary").repartition(parts, "chunk").mapInArrow(merge, "chunk int, bits binary").toLocalIterator():
        out[r["chunk"] * BLOOM_CHUNK // 8 : (r["chunk"] + 1) * BLOOM_CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def maybe_in(filter_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = _bloom_places(ids)
    return ((filter_[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).all(axis=0)


def split_by(docs: DataFrame, name: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose ``name`` (a long) is surely not among ``ids``, and the others with it as ``_name``: a Bloom
    filter tells, so that rows which a join would keep anyway need not be shuffled."""
    seen = bloom(ids)
    named = docs.withColumn("_name", name)

    def sift(wanted: bool):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(maybe_in(seen, np.asarray(batch.column("_name"))) == wanted))

        return run

    return named.mapInArrow(sift(False), named.schema).drop("_name"), named.mapInArrow(sift(True), named.schema)
