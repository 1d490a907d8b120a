"""Quality scores: random Fourier features, ridge by summed normal equations, isotonic calibration.

Document statistics are standardised and mapped to cos(Wx + b), whose inner
products approximate a Gaussian kernel. Every partition sums its own normal
equations over labelled rows; the sums are added up and solved once. Rows whose
crc32 remainder is 3 are not in the fit and calibrate the raw ridge scores by
pooled adjacent violators; remainder 2 is never learned from.

Null text scores as empty text. Rows without a label, with a null label or a
null id take no part in learning. Repeated rows score alike and repeated
labels of a document are averaged. With labels of no kind every score is 0.5.
Very long texts are measured whole, slice by slice of a batch. An empty table
gives an empty result; other columns are kept, one named like the score is
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, RangeHash, held_out, slices, words

FOURIER = 192
"""Random features; the sums held by a partition have (FOURIER + 1)**2 numbers."""
PARTS = 16
"""Sums of normal equations that the driver adds up at any size."""
RIDGE = 1e-3
BINS = 4096
ACCEPT = 0.7

_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = _letter[128:] = True
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_kinds = np.zeros((256, 6), np.float32)
_kinds[_letter, 0] = 1
_kinds[65:91, 1] = 1
_kinds[48:58, 2] = 1
_kinds[[ord(c) for c in ".,;:?'\"-()"], 3] = 1
_kinds[10, 4] = 1
_kinds[:, 5] = ~(_letter | _blank | (_kinds[:, 2] + _kinds[:, 3] > 0))
_code = _kinds @ np.array([1, 2, 4, 8, 16, 32], np.float32)
_code = _code.astype(np.uint8)
_values = np.unique(_code)
STATISTICS = 15


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of STATISTICS numbers per document of a flat text."""
    n = len(at) - 1
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)
    share = np.bincount(row * 64 + _code[data], minlength=64 * n).reshape(n, 64)
    bits = (np.arange(64)[:, None] >> np.arange(6)) & 1
    share = share @ bits / np.maximum(size, 1)[:, None]
    start, end, owner = words(data, at, ~_blank)
    count = np.bincount(owner, minlength=n)
    length = end - start
    total = np.bincount(owner, length, n)
    square = np.bincount(owner, length.astype(float) ** 2, n)
    mean = total / np.maximum(count, 1)
    low = LOWER[data]
    h = RangeHash(low)(start, end) if len(start) else np.zeros(0, np.uint64)
    order = np.lexsort((h, owner))
    ho, oo = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])
    distinct = np.bincount(oo[fresh], minlength=n)
    runs = np.diff(np.r_[np.flatnonzero(fresh), len(h)])
    top = np.zeros(n)
    np.maximum.at(top, oo[fresh], runs)
    ends_odd = np.bincount(owner, (_code[data[end - 1]] & 32) > 0, n) if len(end) else np.zeros(n)
    lone = np.bincount(owner, length <= 1, n)
    some = np.maximum(count, 1)
    return np.column_stack([
        np.log1p(size), share, mean, np.sqrt(np.maximum(square / some - mean**2, 0)), distinct / some, top / some, ends_odd / some, lone / some, np.log1p(count), np.log1p(distinct),
    ])


def featurise(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch, text):
                x = statistics(data, at)
                flat = pa.array(x.ravel())
                yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * STATISTICS), flat)], [key, "x"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, x array<double>")


class Model:
    """Standardisation, random directions, ridge weights and the isotonic steps."""

    def __init__(self, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, FOURIER))
        self.phase = rng.uniform(0, 2 * np.pi, FOURIER)
        self.mean, self.scale = np.zeros(STATISTICS), np.ones(STATISTICS)
        self.weights = np.zeros(FOURIER + 1)
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions + self.phase) * np.sqrt(2 / FOURIER)
        return np.column_stack([z, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.steps is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([p[0] for p in pools], [p[2] for p in pools])


def _matrix(x: pa.Array) -> np.ndarray:
    return np.asarray(x.flatten(), float).reshape(-1, STATISTICS)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id") -> Model:
    """Learn from the labelled documents outside the held-out rows."""
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("y"))
    ids = docs.select(key, text).filter(~held_out(key))
    rows = featurise(ids, text, key).join(marked, key).select("x", "y", (F.crc32(F.col(key).cast("string")) % 4 == 3).alias("check"))
    rows = rows.persist()
    try:
        return _fit(rows)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame) -> Model:
    model = Model()
    learn = rows.filter(~F.col("check"))
    sums = learn.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not sums:
        return model
    for r in sums:
        model.mean[r["i"]], model.scale[r["i"]] = r["m"], r["s"] if r["s"] > 1e-9 else 1

    def normal(batches):
        a, b, n = np.zeros((FOURIER + 1, FOURIER + 1)), np.zeros(FOURIER + 1), 0
        for batch in batches:
            z, y = model.lift(_matrix(batch.column("x"))), np.asarray(batch.column("y"))
            a, b, n = a + z.T @ z, b + z.T @ y, n + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["a", "b", "n"])

    def merged(batches):
        total = None
        for batch in batches:
            for r in batch.to_pylist():
                own = np.frombuffer(r["a"]), np.frombuffer(r["b"]), r["n"]
                total = own if total is None else tuple(x + y for x, y in zip(total, own, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0].tobytes()], pa.binary()), pa.array([total[1].tobytes()], pa.binary()), pa.array([total[2]], pa.int64())], ["a", "b", "n"])

    # every partition sums its own rows where they lie; only sums travel
    sums_ = learn.mapInArrow(normal, "a binary, b binary, n long").filter("n > 0")
    parts = sums_.repartition(PARTS).mapInArrow(merged, "a binary, b binary, n long").collect()
    a = sum(np.frombuffer(p["a"]) for p in parts).reshape(FOURIER + 1, FOURIER + 1)
    b, n = sum(np.frombuffer(p["b"]) for p in parts), sum(p["n"] for p in parts)
    model.weights = np.linalg.solve(a + RIDGE * n * np.eye(FOURIER + 1) / FOURIER, b)

    def binned(batches):
        for batch in batches:
            raw = model.raw(_matrix(batch.column("x")))
            slot = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(slot), batch.column("y")], ["slot", "y"])

    seen = (rows.filter("check") if rows.filter("check").limit(1).count() else learn).mapInArrow(binned, "slot int, y double")
    bins = sorted(seen.groupBy("slot").agg(F.count("*").alias("n"), F.avg("y").alias("y")).collect())
    at = (np.array([r["slot"] for r in bins]) + 0.5) / BINS * 2 - 0.5
    model.steps = at, isotonic(np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins], float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the calibrated score of each whole text."""
    docs = docs.drop(column)

    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(statistics(data, at)))], [*part.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
