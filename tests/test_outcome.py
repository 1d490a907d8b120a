"""The outcome baseline against plain numpy, and streams with state."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.operators import outcome
from chronolex.sources.store import Scratch
from chronolex.streaming import ingest

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = [(f"r{k}", " ".join(rng.choices(WORDS[: 3 + 3 * (k % 2)], k=rng.randint(1, 12))), k % 2 if rng.random() < 0.8 else 1 - k % 2) for k in range(80)] + [("none", "", 1), ("null", None, 0)]
    return spark.createDataFrame(made, "id string, text string, label int")


def dense(rows):
    """Vectors of the same rows in plain code: terms in order, rows of unit length, a constant at the end."""
    held = []
    for r in rows.orderBy("id").collect():
        w = (r["text"] or "").split()
        held.append((r["label"], w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]))
    names = sorted({t for _, ts in held for t in ts})
    df = {t: sum(t in ts for _, ts in held) for t in names}
    names = [t for t in names if df[t] >= 2]
    x = np.array([[(1 + np.log(ts.count(t))) * (np.log((1 + len(held)) / (1 + df[t])) + 1) if t in ts else 0.0 for t in names] for _, ts in held])
    x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]
    return names, np.c_[x, np.ones(len(x))], np.array([y for y, _ in held])


def test_solver_finds_the_least(spark, rows, monkeypatch):
    monkeypatch.setattr(outcome, "PART", 7)  # so that a gradient has several parts
    names, x, y = dense(rows)
    with Scratch(spark) as scratch:
        m = outcome.train(rows, scratch)
        table = {r["term"]: r for r in m.table.collect()}
        assert sorted(table) == names and max(m.norms) < 1e-6
        for s, c in enumerate(m.strengths):
            w = np.array([*[table[t][f"w{s}"] for t in names], m.constants[s]])
            p = 1 / (1 + np.exp(-x @ w))
            assert np.abs(x.T @ (p - y) / len(y) + w / (c * len(y))).max() < 1e-6
        margins = {r["id"]: r["m1"] for r in m.margins(rows, "id").collect()}
        w = np.array([*[table[t]["w1"] for t in names], m.constants[1]])
        assert [margins[r["id"]] for r in rows.orderBy("id").collect()] == pytest.approx((x @ w).tolist(), abs=1e-9)


def test_selection_and_kept_models(spark, rows, tmp_path):
    with Scratch(spark) as scratch:
        best, guessed = outcome.select(rows.filter("id < 'r5'"), rows.filter("id >= 'r5' and id < 'r7'"), rows.filter("id >= 'r7'"), scratch)
        assert best in outcome.STRENGTHS and guessed.count() == rows.filter("id >= 'r7'").count()
        m = outcome.train(rows, scratch, strengths=(0.5, 2.0), only=("alpha", "unseen"))
        m.save(str(tmp_path / "m"))
        again = outcome.Model.load(spark, str(tmp_path / "m"))
        assert again.strengths == (0.5, 2.0) and again.margins(rows, "id").exceptAll(m.margins(rows, "id")).count() == 0
        assert [r["term"] for r in again.table.collect()] == ["alpha"]


def test_latest_runs_in_any_order(spark, tmp_path):
    rng = random.Random(6)
    runs = [(rng.choice("abc"), rng.randint(0, 9), k) for k in range(60)]
    want = {k: max((at, i) for key, at, i in runs if key == k) for k in "abc"}
    for name, order in (("up", runs), ("down", runs[::-1]), ("mixed", rng.sample(runs, 60))):
        for part in range(3):
            spark.createDataFrame(order[part::3], ingest.RUN).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        # the second start goes on from the checkpoint and gets a late row and a repeated one
        for more in ([], [("a", -1, 0), runs[0]]):
            if more:
                spark.createDataFrame(more, ingest.RUN).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            ingest.append_to(ingest.latest_runs(ingest.read_runs(spark, str(tmp_path / name / "in"))), str(tmp_path / name / "out"), str(tmp_path / name / "state"), "update").awaitTermination()
        log = spark.read.schema(ingest.RUN).option("recursiveFileLookup", "true").parquet(str(tmp_path / name / "out"))
        assert {r["key"]: (r["at"], r["id"]) for r in ingest.newest(log).collect()} == want
        assert log.filter(F.col("at") == -1).count() == 0


def test_latest_runs_are_reduced_without_a_call_for_each_key(spark, tmp_path):
    """Keys grow with the table, and so would Python's calls; rows without a time come before all others."""
    rows = [("a", None, 1), ("a", 5, 2), ("b", None, 3), (None, 1, 4)]
    spark.createDataFrame(rows, ingest.RUN).coalesce(1).write.parquet(str(tmp_path / "in"))
    latest = ingest.latest_runs(ingest.read_runs(spark, str(tmp_path / "in")))
    assert "Pandas" not in latest._jdf.queryExecution().logical().toString()
    ingest.append_to(latest, str(tmp_path / "out"), str(tmp_path / "state"), "update").awaitTermination()
    log = spark.read.schema(ingest.RUN).option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert {tuple(r) for r in ingest.newest(log).collect()} == {("a", 5, 2), ("b", None, 3), (None, 1, 4)}


def test_a_kept_model_is_compared_with_the_fit_that_was_saved(spark, smoke_dir, monkeypatch):
    from chronolex import plans, registry  # noqa: F401
    from chronolex.operators import outcome as O

    fit, fits = O.train, []
    monkeypatch.setattr(O, "train", lambda *a, **k: fits.append(fit(*a, **k)) or fits[-1])
    assert registry.QUERIES["s25_model_kept"](spark, smoke_dir).first()["equal"] and len(fits) == 1


@pytest.mark.parametrize("most", [2_000_000, 5, 1])
def test_terms_are_counted_in_their_row(spark, monkeypatch, most):
    monkeypatch.setattr(outcome, "PAIRS", most)
    made = [(1, "aa bb aa bb c"), (2, None), (3, ""), (4, "bb aa"), (None, "Été ete x été")]
    rows = spark.createDataFrame(made, "id long, text string")
    found = outcome.frequencies(rows, "id")
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {(1, "aa", 2), (1, "bb", 2), (1, "aa bb", 2), (1, "bb aa", 1), (4, "aa", 1), (4, "bb", 1), (4, "bb aa", 1), (None, "ete", 3), (None, "ete ete", 2)}
    assert {tuple(r) for r in found.collect()} == want
    assert {tuple(r) for r in outcome.frequencies(rows, "id", only=("bb aa", "ete", "gone")).collect()} == {(1, "bb aa", 1), (4, "bb aa", 1), (None, "ete", 3)}
    known = {(t, sum(x[1] == t for x in want), sum(x[2] for x in want if x[1] == t)) for t in {x[1] for x in want}}
    assert {tuple(r) for r in outcome.known_terms(rows).collect()} == known


@pytest.mark.parametrize("direct", [0, 64 << 20])
def test_vectors_are_made_in_their_row(spark, rows, monkeypatch, direct):
    """No term of a row is a row, neither for the fit nor for predictions; a strength that is done is not passed over again."""
    monkeypatch.setattr(outcome, "DIRECT", direct)
    passes, one = [], outcome._pass
    monkeypatch.setattr(outcome, "_pass", lambda spark, vectors, w: passes.append(len(w)) or one(spark, vectors, w))
    names, x, _ = dense(rows)
    with Scratch(spark) as scratch:
        m = outcome.train(rows, scratch)
        assert max(m.norms) < 1e-6 and passes[0] == 3 and passes[-1] < 3
        known = m.table.select("term", "at", "idf").toArrow()
        made = outcome.vectors(rows, known, "id")
        got = {r["id"]: (r["at"], r["x"]) for r in made.collect()}
        for r, v in zip(rows.orderBy("id").collect(), x[:, :-1], strict=True):
            assert got[r["id"]][0] == np.flatnonzero(v).tolist() and got[r["id"]][1] == pytest.approx(v[v > 0].tolist(), abs=1e-12)
        for plan in (made, m.margins(rows, "id")):
            shown = plan._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in shown and "Aggregate" not in shown
