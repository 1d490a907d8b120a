"""Language identification by interpolated Kneser-Ney character models.

Four-grams of lower-cased letters (anything else is one blank) are counted per
language over all learning documents, where they lie; the counts that
Kneser-Ney needs of shorter grams are aggregated from them in Spark. Every
counted gram is kept: the model is a set of tables with one row per gram or
context and a column per language, on no machine as a whole.

One pass cuts the rows into chunks of CHUNK_BYTES of text, stored with the
distinct grams of each. These are joined with the tables, from single units
upwards, backing off where a gram is absent; each chunk then meets the values
of its own grams alone and its rows are scored. The language with the
lowest cross-entropy per character wins; its score is the calibrated
probability of being right, at most 1 / (languages + 1) for text unlike all of
them. ``rejected`` marks scores under the threshold that kept errors below
REJECT on the calibration rows.

Learning uses rows with crc32 remainder 0 and 1, calibration all labelled ones
of remainder 3, counted by steps of GRID where they lie. Null text or text without a letter is `und` with score 0, as is
everything when nothing could be learned. Ties go to the first language by
name. Null languages are not learned from; repeated rows count as often as they
occur. A very long text is one row of a chunk of its own size. An empty table
gives an empty result; other columns are kept, those named like results are
replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, materialise, scratch, slices, sweep

ORDER = 4
DISCOUNT = 0.75
GRID = 4096
"""Steps of a margin or cross-entropy x that calibration rows are counted by, in each unit of ln(1 + x): a quarter of a thousandth of the value, so counts of any number of rows are few."""
REJECT = 0.01
CHUNK_BYTES = 16 << 20
UNLIKE = 0.5
"""Nats per character above nearly all calibration texts at which a text counts as of no learned language."""
_MASK = [np.uint64(0), *[np.uint64((1 << 16 * n) - 1) for n in range(1, ORDER + 1)]]

_tables: dict[str, np.ndarray] = {}


def _fold() -> np.ndarray:
    """Code unit to itself for letters (surrogates too, of which only letters are left), to a blank otherwise."""
    if not _tables:
        letter = np.fromiter((0xD800 <= u < 0xE000 or chr(u).isalpha() for u in range(65536)), bool, 65536)
        _tables["fold"] = np.where(letter, np.arange(65536), 32).astype(np.uint16)
    return _tables["fold"]


_BEYOND = re.compile("[\U00010000-\U0010ffff]+")


def _letters(text: str) -> str:
    """``text`` with a blank for each character beyond the first plane that is no letter, as its code units don't tell."""
    return text if text.isascii() else _BEYOND.sub(lambda m: "".join(c if c.isalpha() else " " for c in m[0]), text)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed four-grams of all texts, the row of each, and how many letters a row has."""
    raw = [_letters(t.lower()).encode("utf-16-le", "surrogatepass") for t in texts]
    pad = np.full(ORDER - 1, 32, np.uint16).tobytes()
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
    unit = _fold()[np.frombuffer(pad + pad.join(raw) + pad, np.uint16)]
    begin = np.cumsum(size + ORDER - 1) - size
    inside = np.zeros(len(unit), bool)
    row = np.repeat(np.arange(len(raw)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + begin[row]
    inside[place] = True
    # of a run of blanks one stays, and padding always does
    keep = ~inside | (unit != 32)
    keep[1:] |= unit[:-1] != 32
    code = np.zeros(keep.sum(), np.uint64)
    u, mine = unit[keep].astype(np.uint64), inside[keep]
    for k in range(ORDER):
        code[ORDER - 1 :] |= u[ORDER - 1 - k : len(u) - k] << np.uint64(16 * k)
    owner = row[keep[place]]
    return code[mine], owner, np.bincount(row[unit[place] != 32], minlength=len(raw))


def _packed(table: pa.Table) -> bytes:
    """Arrow stream of one batch; chunks are stored and shuffled once each, so they are packed well."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


CHUNK_SCHEMA = "chunk long, rows binary, grams binary, counts array<struct<lang: string, grams: binary, n: binary>>"


def chunks(docs: DataFrame, text: str = "text", learn=None) -> DataFrame:
    """One row per chunk: its rows, their distinct grams, and the counts by language of rows whose ``learn`` is not null."""

    def row(part: int, k: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        found: dict[str | None, list] = {}
        for batch in held:
            tongue = batch.column("_learn").to_pylist()
            for name in set(tongue):
                own = batch.filter(pa.array([t == name for t in tongue])) if len(set(tongue)) > 1 else batch
                for some, _, _ in slices(own, text):
                    found.setdefault(name, []).append(np.unique(grams([t or "" for t in some.column(text).to_pylist()])[0], return_counts=True))
        counts, seen = [], []
        for name, parts in found.items():
            code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            seen.append(code)
            if name is not None:
                n = np.bincount(at, np.concatenate([n for _, n in parts]), len(code)).astype(np.int64)
                counts.append({"lang": name, "grams": code.tobytes(), "n": n.tobytes()})
        kind = pa.list_(pa.struct([("lang", pa.string()), ("grams", pa.binary()), ("n", pa.binary())]))
        values = [pa.array([part << 32 | k], pa.int64()), pa.array([_packed(table.drop_columns(["_learn"]))], pa.binary()), pa.array([np.unique(np.concatenate(seen)).tobytes()], pa.binary()), pa.array([counts], kind)]
        return pa.RecordBatch.from_arrays(values, ["chunk", "rows", "grams", "counts"])

    def run(batches):
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for some, data, _ in slices(batch, text):
                held.append(some)
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield row(part, k, held)
                    k, held, size = k + 1, [], 0
        if held:
            yield row(part, k, held)

    mark = F.lit(None).cast("string") if learn is None else learn
    # written once, as rows need not come in the same order twice
    return materialise(docs.withColumn("_learn", mark).mapInArrow(run, CHUNK_SCHEMA), "chunks")


def count(chunked: DataFrame) -> DataFrame:
    """(lang, gram, n): four-gram counts over all learning rows."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                code, n = np.frombuffer(r["grams"], np.int64), np.frombuffer(r["n"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "gram", "n"])

    return chunked.select(F.inline("counts")).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def asked(chunked: DataFrame) -> DataFrame:
    """(chunk, gram) of all distinct grams of every chunk."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                code = np.frombuffer(r["grams"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), r["chunk"])), pa.array(code)], ["chunk", "gram"])

    return chunked.select("chunk", "grams").mapInArrow(run, "chunk long, gram long")


class Model:
    """Per order a table of grams with counts and one of contexts with totals and kinds, a column per language of each.

    ``log_prob``, ``entropies`` and ``predict`` look a few texts up on the driver and load the tables for that; ``identify`` never does.
    """

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.levels: dict[int, tuple[DataFrame, DataFrame]] | None = {}
        self.floor = np.zeros(len(langs))
        self.slope, self.shift, self.threshold, self.ceiling = 1.0, 0.0, 0.0, np.inf
        self._loaded: tuple[dict, dict] | None = None

    def __getstate__(self):
        return {**self.__dict__, "levels": None, "_loaded": None}

    @property
    def grams(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return self._load()[0]

    @property
    def contexts(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return self._load()[1]

    def _load(self) -> tuple[dict, dict]:
        if self._loaded is None:
            self._loaded = {}, {}
            known, heads = self._loaded
            for order in sorted(self.levels):
                table, context = self.levels[order]
                own, head = table.orderBy("gram").toArrow(), context.orderBy("h").toArrow()
                code, h = (np.asarray(x.column(0).combine_chunks()).view(np.uint64) for x in (own, head))
                n, total, kinds = (np.column_stack([np.asarray(x[f"{c}{i}"].combine_chunks(), float) for i in range(len(self.langs))]) for x, c in ((own, "n"), (head, "t"), (head, "k")))
                by, to = np.argsort(code), np.argsort(h)
                code, n, h, total, kinds = code[by], n[by], h[to], total[to], kinds[to]
                weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                heads[order] = h, np.log(weight).astype(np.float32)
                lower = np.exp(self.log_prob(code & _MASK[order - 1], order - 1).astype(float))
                at = np.searchsorted(h, code >> np.uint64(16))
                seen = np.where(total[at] > 0, np.maximum(n - DISCOUNT, 0) / np.maximum(total[at], 1), 0)
                known[order] = code, np.log(np.maximum(seen + weight[at] * lower, 1e-12)).astype(np.float32)
        return self._loaded

    def values(self, wanted: DataFrame) -> DataFrame:
        """(gram, v0, v1, ...): ln P of the distinct four-grams in ``wanted`` under every language."""
        lower = None
        for order in range(1, ORDER + 1):
            some = wanted.select("gram") if order == ORDER else wanted.select(F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1)).alias("gram")).distinct()
            table, context = self.levels[order]
            some = some.join(table, "gram", "left").withColumn("h", F.shiftrightunsigned("gram", 16)).join(F.broadcast(context) if order == 1 else context, "h", "left")  # one row for order 1
            if order > 1:
                some = some.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))).join(lower, "low")
            out = []
            for i in range(len(self.langs)):
                below = F.col(f"p{i}") if order > 1 else F.lit(float(np.exp(self.floor[i])))
                n, t, k = (F.coalesce(F.col(f"{c}{i}"), F.lit(0)) for c in "ntk")
                seen = F.greatest(n - F.lit(DISCOUNT), F.lit(0.0)) / t
                p = F.when(t > 0, seen + F.lit(DISCOUNT) * k / t * below).otherwise(below)
                out.append(F.greatest(p, F.lit(1e-12)).alias(f"p{i}"))
            lower = some.select(F.col("gram").alias("low"), *out)
        return lower.select(F.col("low").alias("gram"), *[F.log(f"p{i}").cast("float").alias(f"v{i}") for i in range(len(self.langs))])

    def log_prob(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """ln P(last unit | the units before) of packed grams, under every language."""
        if not order:
            return np.tile(self.floor, (len(code), 1))
        known, value = self.grams[order]
        at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
        hit = known[at] == code if len(known) else np.zeros(len(code), bool)
        if len(known) and hit.all():
            return value[at]
        out = np.empty((len(code), len(self.langs)), np.float32)
        out[hit] = value[at[hit]]
        lost = code[~hit]
        out[~hit] = self.log_prob(lost & _MASK[order - 1], order - 1) + self.weight(lost >> np.uint64(16), order)
        return out

    def weight(self, context: np.ndarray, order: int) -> np.ndarray:
        known, value = self.contexts[order]
        at = np.minimum(np.searchsorted(known, context), max(len(known) - 1, 0))
        hit = known[at] == context if len(known) else np.zeros(len(context), bool)
        return np.where(hit[:, None], value[at] if len(known) else 0, 0).astype(np.float32)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character under each language, characters and letters of each text."""
        code, row, letters = grams(texts)
        size = np.bincount(row, minlength=len(texts))
        if not self.langs:
            return np.zeros((len(texts), 0)), size, letters
        return _cross(self.log_prob(code), row, size), size, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        return self.decide(*self.entropies([t or "" for t in texts]))

    def decide(self, cross: np.ndarray, size: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.langs:
            return ["und"] * len(size), np.zeros(len(size)), np.ones(len(size), bool)
        best = cross.argmin(axis=1)
        score = self.calibrated(margin(cross, size))
        score = np.where(cross.min(axis=1) > self.ceiling, np.minimum(score, 1 / (len(self.langs) + 1)), score)
        score = np.where(letters > 0, score, 0.0)
        return [self.langs[b] if n else "und" for b, n in zip(best, letters, strict=True)], score, score < self.threshold

    def calibrated(self, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -60, 60)))


def _cross(lp: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Cross-entropy per character of each row under every language."""
    total = np.column_stack([np.bincount(row, lp[:, k], len(size)) for k in range(lp.shape[1])])
    return -total / np.maximum(size, 1)[:, None]


def margin(cross: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How far the second language is behind, in nats per character times the root of the length."""
    if cross.shape[1] < 2:
        return np.sqrt(size)
    two = np.partition(cross, 1, axis=1)
    return (two[:, 1] - two[:, 0]) * np.sqrt(size)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    some = docs.select(key, text, F.col(lang).cast("string").alias(lang))
    model = learn(chunks(some.filter(fold_of(key) < 2), text, F.col(lang)))
    _calibrate(model, crosses(chunks(some.filter(calibrating(text, lang, key)), text), model, T.StructType([some.schema[lang]]), text), lang)
    return model


def fold_of(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4, F.lit(2))


def learn(chunked: DataFrame) -> Model:
    """The tables of all grams that were counted in ``chunked``; not yet calibrated."""
    counts = materialise(count(chunked), "grams")
    sweep(chunked.sparkSession)
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    model = Model(langs)
    if not langs:
        return model
    level = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1))
        level[order] = materialise(level[order + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n")), "grams")
    vocabulary = level[1].select("gram").distinct().count()
    model.floor = np.full(len(langs), -np.log(vocabulary + 1))
    for order, rows in level.items():
        own = [F.when(F.col("lang") == name, F.col("n")) for name in langs]
        table = rows.groupBy("gram").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(f"n{i}") for i, n in enumerate(own)])
        context = rows.groupBy(F.shiftrightunsigned("gram", 16).alias("h")).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(f"t{i}") for i, n in enumerate(own)], *[F.count(n).alias(f"k{i}") for i, n in enumerate(own)])
        model.levels[order] = table, context
    return model


def crosses(chunked: DataFrame, model: Model, keep: T.StructType, text: str = "text") -> DataFrame:
    """The columns ``keep`` of all rows with cross, an array by language, n_units and n_letters."""
    names, width = keep.fieldNames(), len(model.langs)
    schema = T.StructType([*keep.fields, T.StructField("_cross", T.ArrayType(T.DoubleType())), T.StructField("_n_units", T.LongType()), T.StructField("_n_letters", T.LongType())])

    def scored(raw: bytes, known: np.ndarray, value: np.ndarray) -> pa.Table:
        out = []
        for batch in pa.ipc.open_stream(raw):
            for part, _, _ in slices(batch, text):
                code, row, letters = grams([t or "" for t in part.column(text).to_pylist()])
                size = np.bincount(row, minlength=part.num_rows)
                at = np.searchsorted(known, code)
                cross = _cross(value[at], row, size) if width else np.zeros((part.num_rows, 0))
                ends = pa.array(np.arange(part.num_rows + 1) * width, pa.int32())
                more = [pa.ListArray.from_arrays(ends, pa.array(cross.ravel())), pa.array(size.astype(np.int64)), pa.array(letters.astype(np.int64))]
                out.append(pa.RecordBatch.from_arrays([*[part.column(x) for x in names], *more], [*names, "_cross", "_n_units", "_n_letters"]))
        return pa.Table.from_batches(out)

    if not width:

        def run(batches):
            for batch in batches:
                for raw in batch.column("rows").to_pylist():
                    yield from scored(raw, np.zeros(0, np.uint64), np.zeros((0, 0))).to_batches()

        return chunked.select("rows").mapInArrow(run, schema)

    def meet(rows: pa.Table, found: pa.Table) -> pa.Table:
        code = np.asarray(found["gram"].combine_chunks()).view(np.uint64)
        order = np.argsort(code)
        value = np.column_stack([np.asarray(found[f"v{i}"].combine_chunks())[order] for i in range(width)]) if len(code) else np.zeros((0, width), np.float32)
        return scored(rows["rows"][0].as_py(), code[order], value)

    wanted = asked(chunked)
    values = model.values(materialise(wanted.select("gram").distinct(), "wanted"))
    sweep(chunked.sparkSession)
    found = wanted.join(values, "gram")
    return chunked.select("chunk", "rows").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(meet, schema)


def calibrating(text: str, lang: str, key: str) -> Column:
    """Which rows calibrate: all labelled ones of their fold."""
    return (fold_of(key) == 3) & F.col(lang).isNotNull() & F.col(text).isNotNull()


def _counted(model: Model, seen: DataFrame, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Calibration rows by steps of GRID: (margin: mean, least, greatest, right rows, wrong rows) and (least cross-entropy: mean, rows), rising.

    Rows are counted in tasks and summed by step, so the driver gets one row per step.
    """
    langs, grid = model.langs, GRID

    def run(batches):
        for batch in batches:
            cross, size, letters = _arrays(batch, len(langs))
            right = np.array([langs[b] == t for b, t in zip(cross.argmin(axis=1), batch.column(lang).to_pylist(), strict=True)], bool) & (letters > 0)
            for kind, x in enumerate((margin(cross, size), cross.min(axis=1))):
                step, at, n = np.unique(np.floor(np.log1p(x) * grid).astype(np.int64), return_inverse=True, return_counts=True)
                low, high = np.full(len(step), np.inf), np.full(len(step), -np.inf)
                np.minimum.at(low, at, x)
                np.maximum.at(high, at, x)
                ok = np.bincount(at, weights=right, minlength=len(step)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(step), kind, np.int32)), pa.array(step), pa.array(n), pa.array(ok), pa.array(np.bincount(at, weights=x, minlength=len(step))), pa.array(low), pa.array(high)], ["kind", "step", "n", "ok", "x", "low", "high"])

    parts = seen.select(lang, "_cross", "_n_units", "_n_letters").mapInArrow(run, "kind int, step long, n long, ok long, x double, low double, high double")
    rows = parts.groupBy("kind", "step").agg(*[F.sum(c).alias(c) for c in ("n", "ok", "x")], F.min("low").alias("low"), F.max("high").alias("high")).orderBy("kind", "step").toArrow()
    kind, n, ok, x, low, high = (np.asarray(rows[c].combine_chunks()) for c in ("kind", "n", "ok", "x", "low", "high"))
    mean, m, c = np.clip(x / np.maximum(n, 1), low, high), kind == 0, kind == 1
    return np.stack([mean[m], low[m], high[m], ok[m], (n - ok)[m]]), np.stack([mean[c], n[c]])


def _quantile(x: np.ndarray, n: np.ndarray, share: float) -> float:
    """As ``np.quantile`` of each ``x``, rising, ``n`` times."""
    at = share * (n.sum() - 1)
    low, high = (x[np.searchsorted(np.cumsum(n), end, side="right")] for end in (np.floor(at), np.ceil(at)))
    return float(low + (high - low) * (at - np.floor(at)))


def _calibrate(model: Model, seen: DataFrame, lang: str) -> None:
    """Platt scaling of the margin, and the least score whose errors stay below REJECT."""
    if not model.langs:
        return
    (m, least, most, good, bad), (cross, n) = _counted(model, seen, lang)
    if not len(m):
        return
    model.ceiling = _quantile(cross, n, 0.999) + UNLIKE
    # two languages with no margin between them are even; a hundredth of the rows says so
    x, mass = np.r_[m, m, 0.0], np.r_[good, bad, max(10.0, n.sum() / 100)]
    target = np.r_[np.full(len(m), (good.sum() + 1) / (good.sum() + 2)), np.full(len(m), 1 / (bad.sum() + 2)), 0.5]
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        d, w = mass * (p - target), mass * (p * (1 - p) + 1e-9)
        g = np.array([(d * x).sum() + 1e-3 * a, d.sum()])
        step = np.linalg.solve(np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]]), g)
        size = min(1.0, 2 / max(np.abs(step).max(), 1e-9))
        a, b = a - size * step[0], b - size * step[1]
    model.slope, model.shift = float(a), float(b)
    # rows of one step are accepted together
    score = np.minimum(model.calibrated(least), model.calibrated(most))
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(bad[order]) / np.cumsum((good + bad)[order])
    fine = np.flatnonzero(wrong <= REJECT)
    model.threshold = float(score[order[fine[-1]]]) if len(fine) else 1.0


def _arrays(rows: pa.Table | pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cross, size, letters = (pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in (rows.column(x) for x in ("_cross", "_n_units", "_n_letters")))
    flat = np.asarray(cross.combine_chunks().flatten(), float).reshape(rows.num_rows, width)
    return flat, np.asarray(size.combine_chunks()), np.asarray(letters.combine_chunks())


def _named(found: DataFrame, model: Model) -> DataFrame:
    """``found`` as ``crosses`` returns it, with ``lang_pred``, ``score`` and ``rejected`` for what was measured."""
    names = [x for x in found.columns if x not in ("_cross", "_n_units", "_n_letters")]

    def run(batches):
        for batch in batches:
            lang, score, rejected = model.decide(*_arrays(batch, len(model.langs)))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return found.mapInArrow(run, T.StructType([*[found.schema[x] for x in names], *extra]))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and ``rejected``."""
    docs = docs.drop("lang_pred", "score", "rejected")
    return _named(crosses(chunks(docs, text), model, docs.schema, text), model)


def report(docs: DataFrame) -> DataFrame:
    some = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    some = some.withColumn("calibrates", F.coalesce(calibrating("text", "lang", "doc_id"), F.lit(False)))
    with scratch() as keep:
        chunked = chunks(some, learn=F.when(fold_of("doc_id") < 2, F.col("lang")))
        model = learn(chunked)
        found = materialise(crosses(chunked, model, some.select("doc_id", "lang", "calibrates").schema), "crosses")
        keep(found)
    _calibrate(model, found.filter("calibrates"), "lang")
    return _named(found.drop("lang", "calibrates"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
