"""Toxicity grades by cumulative-link ordinal regression on sparse hashed words.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for all
ordered thresholds; x marks the hashed words and word
beginnings that occur in a text, each by 1 / sqrt(words / TYPICAL), so that a long
text is not severe for its length. Grade 0 is a text labelled not toxic; toxic
texts get grades 1 to 3 by how many features that mark toxic labels they hold,
taken by the same measure (thirds of the labelled toxic texts).
The output is the expected grade, the most likely grade and P(grade >= 1).

The model is fitted on a bounded sample: at most about MOST_LABELLED texts of
either label, drawn by a hash of the id, from rows that are not held out. How
often a feature occurs with either label is counted in tasks; the driver gets the
features that tell the labels apart, and of each text only those.
Null text scores as empty text; null or missing labels are not learned from;
repeated rows score alike, and the largest of a document's labels counts; without
labels every grade is 0. A very long text is scored whole. An empty table gives
an empty result; other columns are kept, those named like results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, RangeHash, held_out, materialise, scratch, slices, words

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
PREFIXES = (4, 5, 6)
"""Bytes of the word beginnings that count as features beside whole words: they carry stems to unseen endings."""
MOST_LABELLED = 10_000
GRADES = 4
LEAST_TEXTS = 3
TYPICAL = 100
ROUNDS = 300
SCREEN = 4.0

_is_word = np.zeros(256, bool)
_is_word[48:58] = _is_word[65:91] = _is_word[97:123] = _is_word[128:] = True


def slots(data: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, slot) of a flat text, only those with a wanted slot, and the weight of a feature in each row."""
    low = LOWER[data]
    start, end, row = words(low, at, _is_word)
    hashed = RangeHash(low)
    found = []
    for cut in (0, *PREFIXES):
        long = end - start > cut
        s, e, r = start[long], end[long] if not cut else start[long] + cut, row[long]
        slot = ((hashed(s, e) + np.uint64(cut)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        if wanted is not None:
            keep = wanted[slot]
            r, slot = r[keep], slot[keep]
        found.append(r * SLOTS + slot)
    both = np.unique(np.concatenate(found))
    scale = np.sqrt(TYPICAL / np.maximum(np.bincount(row, minlength=len(at) - 1), 1))
    return both // SLOTS, both % SLOTS, scale


class Model:
    def __init__(self):
        self.weights = np.zeros(SLOTS)
        self.thresholds = np.full(GRADES - 1, 30.0)

    def above(self, row: np.ndarray, slot: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1 of each row."""
        value = np.bincount(row, self.weights[slot], len(scale)) * scale
        return 1 / (1 + np.exp(np.clip(self.thresholds - value[:, None], -60, 60)))


def grades_of(toxic: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """0 where not toxic, else 1 to GRADES - 1 by how much of marker features there is."""
    if not toxic.any():
        return np.zeros(len(toxic), np.int64)
    cuts = np.quantile(markers[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    return np.where(toxic, 1 + (markers[:, None] > cuts).sum(axis=1), 0)


def telling(bad, good, n_bad: int, n_good: int):
    """Of feature counts in toxic and other texts: whether the shares differ by SCREEN standard errors, and whether the feature marks toxic texts."""
    n, m = max(n_bad, 1), max(n_good, 1)
    p = (bad + good + 1) / (n + m + 2)
    z = np.abs(bad / n - good / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m))
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    return (z > SCREEN) & (bad + good >= LEAST_TEXTS), (odds > 2) & (bad >= LEAST_TEXTS)


def train(grade: np.ndarray, row: np.ndarray, slot: np.ndarray, scale: np.ndarray, decay: float = 2e-5) -> Model:
    """Gradient descent (Adam) on the negative log-likelihood with an L2 penalty."""
    model = Model()
    n = len(grade)
    if not n or not grade.any():
        return model
    known = np.unique(slot)
    place = np.full(SLOTS, -1)
    place[known] = np.arange(len(known))
    keep = place[slot] >= 0
    row, col = row[keep], place[slot[keep]]
    by = scale[row]
    share = np.array([(grade >= k).mean() for k in range(1, GRADES)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    # thresholds are start of the first plus exponentials, so they stay ordered
    p = np.r_[np.zeros(len(known)), start[0], np.log(np.maximum(np.diff(start), 0.1))]
    m, v = np.zeros_like(p), np.zeros_like(p)
    index = np.arange(n)
    for t in range(1, ROUNDS + 1):
        gaps = np.exp(p[-(GRADES - 2) :])
        theta = p[len(known)] + np.r_[0, np.cumsum(gaps)]
        value = np.bincount(row, p[col] * by, n)
        below = 1 / (1 + np.exp(np.clip(value[:, None] - theta, -60, 60)))
        full = np.column_stack([np.zeros(n), below, np.ones(n)])
        slope = np.column_stack([np.zeros(n), below * (1 - below), np.zeros(n)])
        like = np.maximum(full[index, grade + 1] - full[index, grade], 1e-9)
        up, down = slope[index, grade + 1] / like, slope[index, grade] / like
        d_value = (up - down) / n
        d_theta = np.array([down[grade == k + 1].sum() - up[grade == k].sum() for k in range(GRADES - 1)]) / n
        tail = np.cumsum(d_theta[::-1])[::-1]
        grad = np.r_[np.bincount(col, d_value[row] * by, len(known)) + decay * p[: len(known)], tail[0], tail[1:] * gaps]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    model.weights[known] = np.where(np.abs(p[: len(known)]) > 1e-3, p[: len(known)], 0)
    model.thresholds = p[len(known)] + np.r_[0, np.cumsum(np.exp(p[-(GRADES - 2) :]))]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id") -> Model:
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1.0, MOST_LABELLED / n))) for y, n in counts.items()], F.lit(0.0))
    sample = marked.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select(key, text).join(F.broadcast(sample), key)  # about 2 * MOST_LABELLED rows at any size

    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch, text):
                row, slot, scale = slots(data, at)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(scale), pa.ListArray.from_arrays(pa.array(ends), pa.array(slot.astype(np.int32)))], ["y", "scale", "slots"])

    with scratch():
        found = materialise(texts.select("y", text).mapInArrow(run, "y int, scale double, slots array<int>"), "toxicity-sample")
        counts = {r["bad"]: r["n"] for r in found.groupBy((F.col("y") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
        return _fit(found, counts.get(True, 0), counts.get(False, 0))


def _fit(found: DataFrame, n_bad: int, n_good: int) -> Model:
    """The model of a table of labels and feature slots."""
    if not n_bad or not n_good:
        return Model()
    side = found.select((F.col("y") > 0).cast("long").alias("bad"), F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))

    def screen(batches):
        for batch in batches:
            known, marker = telling(*(np.asarray(batch.column(c)).astype(float) for c in ("bad", "good")), n_bad, n_good)
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(known), pa.array(marker)], ["slot", "known", "marker"]).filter(pa.array(known | marker))

    # at most SLOTS rows; in practice the few that tell the labels apart
    some = side.mapInArrow(screen, "slot int, known boolean, marker boolean").toArrow()
    slot_ = np.asarray(some["slot"])
    known, marker = np.zeros(SLOTS, bool), np.zeros(SLOTS, bool)
    known[slot_], marker[slot_] = (some[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("known", "marker"))

    def keep(batches):
        for batch in batches:
            own = batch.column("slots")
            size = np.asarray(own.value_lengths())
            row, slot = np.repeat(np.arange(len(own)), size), np.asarray(own.flatten())
            markers = np.bincount(row, marker[slot], len(own)) * np.asarray(batch.column("scale"))
            stay = known[slot]
            ends = np.r_[0, np.cumsum(np.bincount(row[stay], minlength=len(own)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("scale"), pa.array(markers), pa.ListArray.from_arrays(pa.array(ends), pa.array(slot[stay]))], ["y", "scale", "markers", "slots"])

    rows = found.mapInArrow(keep, "y int, scale double, markers double, slots array<int>").toArrow()
    own = rows["slots"].combine_chunks()
    row, slot = np.repeat(np.arange(rows.num_rows), np.asarray(own.value_lengths())), np.asarray(own.flatten()).astype(np.int64)
    return train(grades_of(np.asarray(rows["y"]) > 0, np.asarray(rows["markers"])), row, slot, np.asarray(rows["scale"]))


def grade(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, P(grade >= 1) as ``score``, ``expected_severity`` and the likeliest ``grade``."""

    docs = docs.drop("score", "expected_severity", "grade")

    def run(batches):
        wanted = model.weights != 0
        for batch in batches:
            for part, data, at in slices(batch, text):
                up = model.above(*slots(data, at, wanted))
                each = -np.diff(np.column_stack([np.ones(len(up)), up, np.zeros(len(up))]), axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(up[:, 0]), pa.array(up.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32))], [*part.schema.names, "score", "expected_severity", "grade"])

    extra = [T.StructField("score", T.DoubleType()), T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    graded = grade(docs.select("doc_id", "text"), fit(docs, labels))
    return graded.select("doc_id", held_out().alias("held_out"), "score", "expected_severity", "grade", (F.col("score") >= 0.5).cast("int").alias("predicted"))
