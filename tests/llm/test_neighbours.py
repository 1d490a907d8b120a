"""Nearest vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, cell long, v int, id string, part int"


def search(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(neighbours.nearest(df, F.col("id") % 20 == 0, **more).collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query"]])
    return out


def inner(a, b):
    total = 0.0
    for p, q in zip(a, b, strict=True):
        total += p * q
    return total


def brute(rows, k=20):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[i] = max(fine.get(i, v), v)
    x = {i: np.float32(v).astype(float) for i, v in fine.items()}
    out = {}
    for i in x:
        if i % 20 == 0:
            near = sorted((-inner(x[i].tolist(), y.tolist()), j) for j, y in x.items() if j != i and len(y) == len(x[i]))[:k]
            if near:
                out[i] = [(j, -s) for s, j in near]
    return out


def recall(got, want):
    return sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in near}) for i, near in want.items()) / sum(map(len, want.values()))


def vectors(n, d=24, seed=1, norms=None):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return (x * norms[:, None] if norms is not None else x).astype(np.float32).tolist()


def test_tables_of_the_driver(spark, smoke_dir):
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{smoke_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute(rows), neighbours.report(spark.read.parquet(f"{smoke_dir}/embeddings.parquet"))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert all(len(x) == 20 for x in found.values()) and recall(found, want) >= 0.9
    exact = {(i, j): s for i, near in brute(rows, len(rows)).items() for j, s in near}
    assert all(s == exact[i, j] for i, near in found.items() for j, s in near)


def test_few_and_broken_vectors(spark):
    assert search(spark, []) == {}
    assert search(spark, [(0, [1.0, 0.0])]) == {}
    rows = [(0, [1.0, 2.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [5.0, 5.0]), (8, []), (9, [1.0]), (20, [-1.0, -1.0]), (40, [3.0]), (1, [1.0, 0.0]), (0, [1.0, 2.0])]
    got = search(spark, rows)
    assert got == brute(rows)
    assert got[0] == [(1, 2.0), (2, 2.0), (20, -3.0)]  # a tie goes to the smaller id


def test_copies_and_ties(spark):
    hot, rest = vectors(1, seed=3)[0], vectors(300, seed=4)
    rows = [(i, hot if i % 3 == 0 else rest[i % 300]) for i in range(900)]
    got, want = search(spark, rows), brute(rows)
    assert recall(got, want) >= 0.9
    assert got[60] == want[60] and got[0] == want[0]  # queries that are copies themselves: the smallest ids of the others


@pytest.mark.parametrize("more", [{}, {"depth": 2, "probes": 600}])
def test_norms_differ(spark, more):
    rng = np.random.default_rng(5)
    rows = list(enumerate(vectors(1500, norms=np.exp(rng.normal(size=1500)))))
    assert recall(search(spark, rows, **more), brute(rows)) >= 0.9


def test_queries_with_too_few_candidates_are_compared_with_all(spark):
    rows = list(enumerate(vectors(200)))
    assert search(spark, rows, k=199, tables=1, probes=1) == brute(rows, 199)


def test_hot_cells_are_dealt_to_parts(spark, monkeypatch):
    hot = np.float32(vectors(1, seed=6)[0])
    rows = [(i, (hot + np.float32(1e-3 * np.random.default_rng(i).normal(size=24))).tolist()) for i in range(700)]
    once = search(spark, rows)
    monkeypatch.setattr(neighbours, "PART_ROWS", 16)
    assert search(spark, rows) == once
    assert recall(once, brute(rows)) >= 0.99
