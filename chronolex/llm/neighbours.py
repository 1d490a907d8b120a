"""Nearest vectors by cross-polytope hashing.

Vectors are brought to unit length with one more coordinate that makes up for
their norm (so that the greatest inner product is the nearest direction),
turned by fast pseudo-rotations (random signs and Hadamard transforms, three
times) and assigned to the nearest signed axis, once per table. A query looks
into the cells of its nearest axes in every table. Vectors and the queries that
look for them meet by cell; a cell keeps the best few of each query, and the
best of all cells are ranked by the inner products of the original vectors.

An axis is one of 2 * (padded dimension), so a cell holds that share of all
rows. ``depth`` axes in a row, each of a rotation of its own, make finer cells
for larger collections.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch

NEAREST = 20
TABLES = 16
PROBES = 16
ROUNDS = 3
BLOCK_ROWS = 512
"""Vectors that are turned together."""

PART_ROWS = 4096
HOT_SHARE = 1 << 16
"""A cell with over 1 / HOT_SHARE of all entries, and over PART_ROWS, is dealt to parts. There are at most HOT_SHARE such cells, whose list is broadcast."""

REMEMBERED = 250_000
"""Queries whose bound a task remembers."""


def usable(rows: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): one row per id with a vector that is not null, empty or zero and has no null, NaN or infinite component. Of several vectors of one id the greatest stays."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return rows.filter(F.col(id).isNotNull() & F.coalesce(fine, F.lit(False))).groupBy(F.col(id).cast("long").alias("id")).agg(F.max(vector).alias("v"))


def _norm() -> Column:
    return F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


@dataclass(frozen=True)
class Hashing:
    """Tables of rotations. ``groups``: (dimension, band) to (number, greatest norm), for vectors of one dimension and of about one norm."""

    groups: dict[tuple[int, int], tuple[int, float]]
    tables: int = TABLES
    probes: int = PROBES
    depth: int = 1

    def _turned(self, x: np.ndarray, table: int, turn: int) -> np.ndarray:
        """Columns of ``x`` turned; a transform adds and subtracts whole rows of a block that fits the cache."""
        n, m = x.shape
        signs = np.random.default_rng([0xC405, n, table, turn]).choice([-1.0, 1.0], (ROUNDS, n))
        a, b = x.copy(), np.empty_like(x)
        for s in signs:
            a *= s[:, None]
            h = 1
            while h < n:
                y, z = a.reshape(n // (2 * h), 2, h, m), b.reshape(n // (2 * h), 2, h, m)
                np.add(y[:, 0], y[:, 1], out=z[:, 0])
                np.subtract(y[:, 0], y[:, 1], out=z[:, 1])
                a, b, h = b, a, 2 * h
        return a

    def _padded(self, x: np.ndarray, last: np.ndarray | float) -> np.ndarray:
        """Rows as columns, with one more coordinate, filled up to a power of two."""
        out = np.zeros((1 << int(x.shape[1]).bit_length(), len(x)))
        out[: x.shape[1]] = x.T
        out[x.shape[1]] = last
        return out

    def _cell(self, group: int, table: int, codes: list[np.ndarray], n: int) -> np.ndarray:
        code = np.zeros_like(codes[0])
        for c in codes:
            code = code * (2 * n) + c
        return (np.int64(group * self.tables + table) << np.int64(32)) + code if (2 * n) ** self.depth <= 1 << 32 else _refuse()

    def cells(self, x: np.ndarray, band: int) -> np.ndarray:
        """(rows, tables): where vectors of one dimension and band lie."""
        group, most = self.groups[x.shape[1], band]
        out = np.zeros((len(x), self.tables), np.int64)
        for at in range(0, len(x), BLOCK_ROWS):
            unit = x[at : at + BLOCK_ROWS] / most
            padded = self._padded(unit, np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1))))
            n = len(padded)
            for t in range(self.tables):
                codes = []
                for d in range(self.depth):
                    turned = self._turned(padded, t, d)
                    axis = np.abs(turned).argmax(axis=0)
                    codes.append(2 * axis + (turned[axis, np.arange(len(unit))] < 0))
                out[at : at + BLOCK_ROWS, t] = self._cell(group, t, codes, n)
        return out

    def looked_up(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables * probes * bands): cells that queries of one dimension look into, nearest axes first in each table."""
        return np.concatenate([self._near(x[at : at + BLOCK_ROWS]) for at in range(0, len(x), BLOCK_ROWS)])

    def _near(self, x: np.ndarray) -> np.ndarray:
        padded = self._padded(x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None], 0.0)
        n, out = len(padded), []
        most = min(self.probes, 2 * n)
        combined = np.array(list(product(range(most), repeat=self.depth)))
        for t in range(self.tables):
            near, far = [], []
            for d in range(self.depth):
                turned = self._turned(padded, t, d).T
                signed = np.stack([turned, -turned], axis=2).reshape(len(x), 2 * n)
                near.append(np.argsort(-signed, axis=1, kind="stable")[:, :most])
                far.append(np.take_along_axis(signed, near[-1], axis=1))
            closeness = sum(far[d][:, combined[:, d]] for d in range(self.depth))
            best = np.argsort(-closeness, axis=1, kind="stable")[:, : self.probes]
            codes = [np.take_along_axis(near[d], combined[:, d][best], axis=1) for d in range(self.depth)]
            out += [self._cell(group, t, codes, n) for (dim, _), (group, _) in self.groups.items() if dim == x.shape[1]]
        return np.concatenate(out, axis=1)


def _refuse() -> np.ndarray:
    raise ValueError("so many axes in a row don't fit a cell's number")


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each dimension in a list column."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), dtype=np.float64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        yield own, flat[at[own][:, None] + np.arange(d)]


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else [], kind))


def _with_cells(rows: DataFrame, cells, *carry: str) -> DataFrame:
    """``rows`` with the column ``cells``; ``cells(matrix, batch, rows of the batch)`` computes them for one dimension."""
    kinds = dict(rows.dtypes)
    schema = f"{', '.join(f'{c} {kinds[c]}' for c in carry)}, v {kinds['v']}, cells array<long>"

    def run(batches):
        for batch in batches:
            out: list = [None] * batch.num_rows
            for own, x in _matrices(batch.column("v")):
                for i, row in zip(own.tolist(), cells(x, batch, own), strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], batch.column("v"), _lists(out, pa.int64())], [*carry, "v", "cells"])

    return rows.mapInArrow(run, schema)


def _inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed from the first component to the last, so that equal pairs have equal products anywhere."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * c[:, j]
    return out


def _best(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and products of its ``k`` best candidates, ties to the smaller id."""
    rough = q @ c.T
    # products of a matrix depend on its shape in their last bits; what is near the bound is computed anew
    bound = np.partition(rough, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(q), -np.inf)
    slack = 1e-9 * (np.sqrt((q * q).sum(axis=1)) * np.sqrt((c * c).sum(axis=1).max()))
    i, j = np.nonzero(rough >= (bound - slack)[:, None])
    exact = _inner(q[i], c[j])
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    start = np.searchsorted(i, np.arange(len(q) + 1))
    for a, b in zip(start[:-1], start[1:], strict=True):
        yield ids[j[a : min(b, a + k)]], exact[a : min(b, a + k)]


QUERY_ROWS = 256
FOUND = "class long, id long, score double"


def _meet(k: int):
    """Of rows sorted by (cell, part, kind), candidates (kind 0) before queries (kind 1): the best ``k`` of every query in every part."""

    def run(batches):
        key, held_ids, held, known = None, [], [], {}
        for batch in batches:
            cell, part, kind = (np.asarray(batch.column(x)) for x in ("cell", "part", "kind"))
            name = np.asarray(batch.column("id"))
            cut = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])) if len(cell) else np.zeros(0, np.int64)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(cell)], strict=True):
                if (cell[a], part[a]) != key:
                    key, held_ids, held = (cell[a], part[a]), [], []
                x = np.concatenate([m for _, m in _matrices(batch.column("v").slice(a, b - a))])
                if kind[a] == 0:
                    held_ids.append(name[a:b])
                    held.append(x)
                elif held:
                    if len(held) > 1:
                        held_ids, held = [np.concatenate(held_ids)], [np.concatenate(held)]
                    found: list[list[np.ndarray]] = [[], [], []]
                    for s in range(0, len(x), QUERY_ROWS):
                        for q, (ids, scores) in zip(name[a + s : b].tolist(), _best(x[s : s + QUERY_ROWS], held[0], held_ids[0], k), strict=False):
                            # k candidates of one part are k different ones, so the least of them bounds the k best of all
                            least = known.get(q, -np.inf)
                            if len(scores) == k and scores[-1] > least:
                                if len(known) >= REMEMBERED:
                                    known.clear()
                                least = known[q] = scores[-1]
                            n = int(np.searchsorted(-scores, -least, "right"))
                            found[0].append(np.full(n, q))
                            found[1].append(ids[:n])
                            found[2].append(scores[:n])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found[0]), pa.int64()), pa.array(np.concatenate(found[1]), pa.int64()), pa.array(np.concatenate(found[2]), pa.float64())], ["class", "id", "score"])

    return run


def _matched(candidates: DataFrame, queries: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(class, id, score): the ``k`` best candidates of each query over all cells that both are in. Both have (id, v, cell)."""
    few = F.broadcast(parts)
    # a cell of many parts has each candidate once, and each query in every part
    left = candidates.join(few, "cell", "left").select("cell", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "v")
    right = queries.join(few, "cell", "left").select("cell", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)).cast("int") - 1)).alias("part"), F.lit(1).alias("kind"), "id", "v")
    met = left.unionByName(right).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    pairs = met.mapInArrow(_meet(k), FOUND).groupBy("class", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))


def _split(counts: DataFrame, total: int) -> DataFrame:
    """(cell, parts) of cells that are dealt to several parts; at most HOT_SHARE rows."""
    most = max(PART_ROWS, -(-total // HOT_SHARE))
    return counts.filter(F.col("n") > most).select("cell", F.ceil(F.col("n") / most).cast("int").alias("parts"))


def nearest(rows: DataFrame, is_query: Column, k: int = NEAREST, id: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int = PROBES, depth: int = 1) -> DataFrame:
    """(query, rank, id, score): for each id that fulfils ``is_query`` (over the column ``id``) its ``k`` nearest others found.

    * Of equal vectors only the k + 1 smallest ids are candidates, as no more can be among the k nearest, and equal query
      vectors are searched once; so groups of copies cost nothing.
    * Queries for which the tables give fewer than k + 1 candidates, their own included, are compared with all rows, in parts.
    * Vectors of another length than the query's are never its candidates. See ``usable`` for what takes part; ties go to
      the smaller id; an empty table gives no rows; further columns are not read.
    """
    spark = rows.sparkSession
    with scratch() as keep:
        band = F.floor(F.log2("norm") + 0.5).cast("int")
        whole = materialise(usable(rows, id, vector).withColumn("norm", _norm()).withColumn("band", band), "vectors")
        same = F.row_number().over(Window.partitionBy("v").orderBy("id"))
        candidates = whole.withColumn("_n", same).filter(F.col("_n") <= k + 1).drop("_n")
        # one row per length and power of two of the norm, whatever the number of vectors
        seen = candidates.groupBy(F.size("v").alias("d"), "band").agg(F.max("norm").alias("most"), F.count("*").alias("n")).collect()
        seen.sort(key=lambda r: (r["d"], r["band"]))
        hashing = Hashing({(r["d"], r["band"]): (g, r["most"]) for g, r in enumerate(seen)}, tables, probes, depth)

        def own_cells(x, batch, own):
            bands = np.asarray(batch.column("band"))[own]
            out = np.zeros((len(x), tables), np.int64)
            for b in np.unique(bands).tolist():
                out[bands == b] = hashing.cells(x[bands == b], b)
            return out

        index = materialise(_with_cells(candidates, own_cells, "id"), "cells")
        asked = whole.filter(is_query).select("id", "v")
        classes = asked.groupBy("v").agg(F.min("id").alias("class"))
        members = asked.join(classes, "v").select("id", "class")
        searched = materialise(_with_cells(classes.select(F.col("class").alias("id"), "v"), lambda x, batch, own: hashing.looked_up(x), "id"), "queries")
        total = sum(r["n"] for r in seen)
        of_cell = index.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
        split = _split(of_cell, total * tables)
        by_cell = lambda t: t.select("id", "v", F.explode("cells").alias("cell"))
        found = materialise(_matched(by_cell(index), by_cell(searched), split, k + 1), "near")

        # those with too few candidates are compared with all vectors of their length
        sizes = {d: sum(r["n"] for r in seen if r["d"] == d) for d in {r["d"] for r in seen}}
        of_length = F.lit(0)
        for d, n in sizes.items():
            of_length = F.when(F.size("v") == d, min(n, k + 1)).otherwise(of_length)
        lacking = materialise(searched.join(found, F.col("id") == F.col("class"), "left").filter(F.coalesce(F.size("near"), F.lit(0)) < of_length).select("id", "v"), "lacking")
        if lacking.limit(1).count():
            lengths = spark.createDataFrame([(d, n) for d, n in sizes.items()], "cell long, n long")
            by_length = lambda t: t.select("id", "v", F.size("v").cast("long").alias("cell"))
            rest = _matched(by_length(index), by_length(lacking), _split(lengths, total), k + 1)
            found = found.join(lacking, F.col("class") == F.col("id"), "left_anti").unionByName(rest)
        others = members.join(found, "class").select(F.col("id").alias("query"), F.filter("near", lambda x: x["id"] != F.col("id")).alias("near"))
        out = others.select("query", F.posexplode(F.slice("near", 1, k)).alias("at", "x"))
        result = materialise(out.select("query", (F.col("at") + 1).cast("int").alias("rank"), "x.id", "x.score"), "nearest")
        keep(result)
    return result


def report(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: queries are ids divisible by 20."""
    found = nearest(embeddings, F.col("id") % 20 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
