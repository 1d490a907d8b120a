"""Snapshots, transactions, the growing index and the bounded search."""

import random

import pytest
from pyspark.sql import functions as F

from chronolex.operators import bounded
from chronolex.operators import retrieval as R
from chronolex.sources.adapters import passages, queries
from chronolex.sources.formats import run_log
from chronolex.sources.index import BLOCK, FAN_IN, Index
from chronolex.sources.snapshots import Conflict, Snapshots, Store
from chronolex.sources.store import Scratch

WORDS = [f"w{k}" for k in range(60)]


def chunks(spark, ids, seed=0):
    rng = random.Random(seed)
    rows = [(f"c{k:04d}", k // 3, rng.choice([None, 1990, 2000, 2010]), " ".join(rng.choice(WORDS[: rng.randint(1, 60)]) for _ in range(rng.randint(0, 40)))) for k in range(600)]
    return spark.createDataFrame([r for r in rows if int(r[0][1:]) in ids], "chunk_id string, doc_id long, decision_year int, text string")


def asked(spark):
    rng = random.Random(9)
    return spark.createDataFrame([(k, rng.choice([1995, 2005, 2015]), " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))) for k in range(25)] + [(99, 2005, "unknown words"), (98, 1900, "w1 w2")], "query_id long, query_year int, query_text string")


def facts(index):
    n, avgdl = index.size()
    return n, round(avgdl, 9), sorted(tuple(r) for r in index.terms().collect()), sorted(tuple(r) for r in index.postings().select("term", "chunk_id", "doc_id", "decision_year", "dl", "tf").collect())


def every_score(spark, some, q, k, before):
    p = R.index_postings(some)
    scored = R.bm25(p, R.index_terms(p), R.index_size(some), R.query_terms(q, "legacy"), q, before)
    return sorted(tuple(r) for r in R.top_k(scored, k, before).select("query_id", "rank", "chunk_id", "score", "doc_id", "status").collect())


def searched(spark, index, q, k, before):
    with Scratch(spark) as scratch:
        return sorted(tuple(r) for r in bounded.top_k(index, R.query_terms(q, "legacy"), q, k, before, scratch).select("query_id", "rank", "chunk_id", "score", "doc_id", "status").collect())


def test_a_state_is_seen_whole_or_not_at_all(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    assert s.state().version == 0 and s.versions() == []
    lost = s.write(spark.range(3), "a")
    assert s.state().version == 0
    first = s.write(spark.range(5), "a")
    s.commit(lambda x: x.but(a=[{"folder": first}]))
    assert s.read(s.state().entries("a"), "id long").count() == 5
    # two writers that start from one state: the second one sees the first one's change and adds to it
    seen = []

    def slow(x):
        seen.append(x.version)
        if len(seen) == 1:
            s.commit(lambda y: y.but(b=[{"folder": "other"}]))
        return x.but(c=[{"folder": "mine"}])

    assert s.commit(slow).version == 3 and seen == [1, 2]
    assert set(s.state().tables) == {"a", "b", "c"} and set(s.state(1).tables) == {"a"}
    assert not s._make(s.state(1).but())  # its number is taken
    assert s.vacuum(older_than_s=-60) == 1 and lost not in [e["folder"] for e in s.state().entries("a")]
    assert s.versions() == [3] and s.read(s.state().entries("a"), "id long").count() == 5


def test_runs_are_logged_once_and_whole(spark, tmp_path):
    log = run_log(spark, str(tmp_path / "log"))
    runs = spark.createDataFrame([("a", 1), ("a", 2)], "run string, query_id long")
    results = spark.createDataFrame([("a", 1, 1, "c", 2.0, "eligible")], "run string, query_id long, rank long, chunk_id string, score double, status string")
    assert log.read("runs").count() == 0
    with pytest.raises(Exception, match="(?i)broken"):
        log.log("a", runs, results.withColumn("score", F.raise_error(F.lit("broken")).cast("double")))
    assert (log.read("runs").count(), log.read("results").count()) == (0, 0)
    assert log.log("a", runs, results) and not log.log("a", runs, results)
    assert log.log("b", runs.withColumn("run", F.lit("b")), results.withColumn("run", F.lit("b")))
    log.compact()
    assert (log.read("runs").count(), log.read("results").count()) == (4, 2)
    assert not run_log(spark.newSession(), str(tmp_path / "log")).log("b", runs, results)


def test_a_load_replaces_a_store_as_a_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), "id long, x string")
    rows = spark.range(5).withColumn("x", F.lit("old"))
    assert store.load(rows, "id") == 1
    opened = store.read()
    with pytest.raises(Exception, match="(?i)broken"):
        store.load(rows.withColumn("x", F.raise_error(F.lit("broken")).cast("string")), "id")
    assert store.read().count() == 5
    assert store.load(spark.range(2).withColumn("x", F.lit("new")), "id") == 2
    assert opened.filter("x = 'old'").count() == 5 and store.read().filter("x = 'new'").count() == 2 and store.read(1).count() == 5


def test_grown_index_equals_one_build(spark, tmp_path):
    whole, grown = Index(spark, str(tmp_path / "one")), Index(spark, str(tmp_path / "many"))
    for part in range(FAN_IN + 1):
        grown.add(R.chunk_vectors(chunks(spark, range(part * 100, (part + 1) * 100))))
    stale = Index(spark, str(tmp_path / "many"))
    grown.add(R.chunk_vectors(chunks(spark, range(450, 600), seed=0)))  # fifty of these replace what is there
    grown.delete(spark.createDataFrame([(f"c{k:04d}",) for k in (*range(0, 600, 60), 9999)], "chunk_id string"))
    left = chunks(spark, set(range(600)) - set(range(0, 600, 60)))
    whole.add(R.chunk_vectors(left))
    assert facts(grown) == facts(whole)
    with pytest.raises(Conflict):
        stale.delete(spark.createDataFrame([("c0001",)], "chunk_id string"))
    q = asked(spark)
    want = every_score(spark, left, q, 20, True)
    assert searched(spark, grown, q, 20, True) == want
    n = len(grown.segments)
    assert grown.merge() and len(grown.segments) == n - FAN_IN + 1
    again = Index(spark.newSession(), str(tmp_path / "many"))
    assert facts(again) == facts(whole)
    assert searched(spark, grown, q, 20, True) == want
    grown.delete(chunks(spark, range(600)))
    assert facts(grown) == (0, 0.0, [], []) and searched(spark, grown, q, 20, True) == []


@pytest.mark.parametrize(("k", "before"), [(1, True), (7, False), (1000, True)])
def test_bounded_search_equals_scoring_everything(spark, tmp_path, k, before, monkeypatch):
    monkeypatch.setattr(bounded, "FIRST", 0.1)
    some, q = chunks(spark, range(600)), asked(spark)
    index = Index(spark, str(tmp_path / "i"))
    index.add(R.chunk_vectors(some))
    assert max(r["n"] for r in index.blocks().collect()) <= BLOCK
    assert searched(spark, index, q, k, before) == every_score(spark, some, q, k, before)


def test_an_empty_index_finds_nothing(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    assert index.size() == (0, 0.0) and index.terms().count() == 0
    assert searched(spark, index, asked(spark), 5, True) == []
    index.add(R.chunk_vectors(chunks(spark, [])))
    assert searched(spark, index, asked(spark), 5, True) == []


def test_bounded_search_reads_a_part_of_the_postings(spark, tmp_path):
    """Of the larger tables: postings that both rounds open and terms of completed chunks, against all that the query terms have."""
    folder = "/root/testdata/sf0.1"
    index, q = Index(spark, str(tmp_path / "i")), queries(spark, folder)
    index.add(R.chunk_vectors(passages(spark, folder)))
    terms = R.query_terms(q, "legacy")
    every = terms.join(index.terms(), "term").agg(F.sum("df")).first()[0]
    with Scratch(spark) as scratch:
        s = bounded.search(index, terms, q, 100, True, scratch)
        opened = s.first.agg(F.sum("n")).first()[0] + s.essential.agg(F.sum("n")).first()[0]
        completed = s.candidates.join(terms.groupBy("query_id").agg(F.count("*").alias("n")), "query_id").agg(F.sum("n")).first()[0]
    assert opened < every / 3 and opened + completed < every / 2


def test_few_terms_open_few_folders(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.add(R.chunk_vectors(chunks(spark, range(600))))
    few = spark.createDataFrame([("w1",)], "term string").select(bounded.bucket(F.col("term"), index.buckets).alias("bucket"))
    found = bounded.pruned(index.blocks(), few)
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert any("PartitionFilters" in line and "Subquery" in line for line in plan.splitlines())
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    assert len(files(found)) <= 2 < len(files(index.blocks()))


@pytest.mark.parametrize("bits", [64, 1 << 22])
def test_rows_among_wanted_keys(spark, bits):
    """No wanted row is lost, few others stay, and the rows are not shuffled for it; without a wanted key none stays."""
    from chronolex.sources.keyed import among

    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    wanted = spark.range(0, 40_000, 1000).select(F.concat(F.lit("k"), "id").alias("k"))
    got = {r["id"] for r in among(rows, "k", wanted, bits).collect()}
    assert got >= set(range(0, 20_000, 1000)) and (bits == 64 or len(got) < 40)
    assert among(rows, "k", wanted.limit(0), bits).count() == 0


def test_evidence_does_not_move_the_corpus(spark, smoke_dir):
    """Passages are left to those that are cited before they meet anything."""
    from chronolex.plans import evaluation
    from chronolex.sources.adapters import passages

    cited = passages(spark, smoke_dir).filter("doc_id = 3").select("chunk_id")
    held = evaluation._corpus(spark, smoke_dir, cited)
    assert {r["doc_id"] for r in held.select("doc_id").collect()} >= {3} and held.count() < passages(spark, smoke_dir).count() / 10


def test_a_part_is_chosen_before_its_terms_are_counted(spark, smoke_dir, monkeypatch):
    """Segments of a part of the chunks cut these only; filters stop at functions in Python."""
    from chronolex import plans, registry  # noqa: F401
    from chronolex.operators import retrieval as R

    parts, make = [], R.chunk_vectors
    monkeypatch.setattr(R, "chunk_vectors", lambda chunks: parts.append(chunks.count()) or make(chunks))
    registry.QUERIES["s24_index_grown"](spark, smoke_dir)
    from chronolex.sources.adapters import passages

    n = passages(spark, smoke_dir).count()
    assert len(parts) == 4 and max(parts) < 0.7 * n and sum(parts) < 1.3 * n
