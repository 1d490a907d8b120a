"""Operators on literal inputs: the cases that the fixture tables lack."""

import random

import pytest
from pyspark.sql import functions as F

from chronolex.functions import temporal
from chronolex.functions import text as T
from chronolex.operators import alignment as A
from chronolex.operators import answers as V
from chronolex.operators import cleaning as C
from chronolex.operators import facts as X
from chronolex.operators import metrics as M
from chronolex.operators import outcome, sampling, validation
from chronolex.operators import retrieval as R
from chronolex.sources import adapters, formats, keyed, store
from chronolex.sources.store import Scratch
from chronolex.streaming import ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [("A\n1043\nThe regula-\ntion applies.\n\nB\n1043\n", "The regulation applies."), ("Supreme Court Reports [1]\r\nOne  line�here", "One  line here"), ("", "")])
def test_clean(spark, raw, want):
    assert one(spark, raw, lambda v: C.clean(v, F.array().cast("array<string>"))) == want


def test_furniture(spark):
    raw = [f"A\nREPORT HEADER\nPage text {k} here.\nCASE TITLE\n{k}" for k in range(3)]
    pages = spark.createDataFrame([(1, k, t) for k, t in enumerate(raw)] + [(2, 0, "REPORT HEADER")], "doc_id long, page int, raw_text string")
    assert [tuple(r) for r in C.furniture(pages).collect()] == [(1, ["case title", "report header"])]
    assert sorted(r["text"] for r in C.cleaned(pages).filter("doc_id = 1").collect()) == [f"Page text {k} here." for k in range(3)]


def test_chunks_tile_the_page(spark):
    text = " ".join(f"Sentence number {k} has some words." for k in range(9)) + " " + "Long " * 300 + "end."
    pages = spark.createDataFrame([(1, 1, text), (1, 2, ""), (1, 3, "no end")], "doc_id long, page int, text string")
    rows = sorted((r["page"], r["chunk"], r["start"], r["end"], r["text"]) for r in C.chunks(pages, 20, 2).collect())
    first = [r for r in rows if r[0] == 1]
    assert [r[1] for r in first] == list(range(1, len(first) + 1)) and rows[-1][4] == "no end"
    assert all(text[s:e] == t for _, _, s, e, t in first) and " ".join(r[4] for r in first) == text
    assert max(len(r[4].split()) for r in first[:-1]) <= 20 and len(first[-1][4].split()) == 301


@pytest.mark.parametrize(("text", "want"), [("There are", True), ("Appeal dismissed.", False), ("A. Kumar, B. Rao, C. Singh, D. Das, Adv.", True), ("The court held that, in law, on facts, and in equity, the claim was without any merit.", False)])
def test_not_evidence(spark, text, want):
    assert one(spark, text, C.not_evidence) is want


@pytest.mark.parametrize(("value", "want"), [("2010_123.txt", 2010), ("31-12-2009", 2009), ("1/2/1999", 1999), ("20101", 2010), ("no date", None), (None, None)])
def test_year_of_text(spark, value, want):
    assert one(spark, value, temporal.year_of_text) == want


@pytest.mark.parametrize(("query", "source", "want"), [(2010, 2009, 0), (2010, 2010, 1), (2010, 2011, 2), (None, 2000, 3), (2000, None, 3)])
def test_status(spark, query, source, want):
    row = spark.createDataFrame([(query, source)], "a int, b int").select(temporal.status(F.col("a"), F.col("b")).alias("s")).first()
    assert row["s"] == temporal.STATUSES[want]


def facts(spark, text):
    return X.extract(spark.createDataFrame([(text,)], "text string")).withColumn("ok", X.eligible()).first()


def test_facts_boundaries(spark):
    body = "The parties met and the matter was heard at length. " * 10
    cue = facts(spark, body + "The appeal is dismissed. " + "More words follow here. " * 40)
    assert cue["boundary_reason"] == "dispositive_cue" and cue["facts"] == body.rstrip() and cue["boundary_char"] == len(body)
    header = facts(spark, body + "\nORDER\n" + "More words follow here. " * 40)
    assert header["boundary_reason"] == "section_header" and header["facts"] == body.rstrip()
    cap = facts(spark, body)
    assert cap["boundary_reason"] == "positional_cap" and cap["boundary_char"] <= round(len(body) * 0.6) and cap["facts"].endswith(".")
    late = facts(spark, body + "The appeal is dismissed.")
    assert late["boundary_reason"] == "positional_cap"
    empty = facts(spark, None)
    assert (empty["boundary_reason"], empty["boundary_char"], empty["facts"], empty["ok"]) == ("empty_text", None, "", False)
    assert facts(spark, "😀é " * 50 + "The petition is allowed. " + "x " * 400)["boundary_char"] == 150


def test_cues(spark):
    assert one(spark, "We therefore allow the appeal. The appeal is dismissed. the appeal is dismissed", X.cues) == ["The appeal is dismissed", "the appeal is dismissed", "We therefore allow the appeal"]


@pytest.mark.parametrize(("value", "want"), [("2008_012", "2008_12"), ("1999 INSC 7", "1999_7"), (" 1999 insc 07 ", "1999_7"), ("1999", None), (None, None)])
def test_canonical_case_id(spark, value, want):
    assert one(spark, value, T.canonical_case_id) == want


def test_titles_and_tokens(spark):
    assert one(spark, "State of U.P. versus Ram Lal and ors", T.title) == "state uttar pradesh v ram lal"
    assert one(spark, "Straße STRASSE ab a", T.phrase_tokens) == ["strasse", "strasse"]
    assert one(spark, "Élan vitaĺ x_1", T.index_tokens)[:2] == ["elan", "vital"]
    assert one(spark, "a b", lambda v: T.windows(T.words(v), 6)) == []
    assert one(spark, "https://h/x/S_1_EN.pdf?q", T.source_id_of_url) == "S_1"


def test_self_match_needs_both_signals(spark):
    quoted = "the learned judge observed that every citizen has the right to be heard before any order is made against them in law"
    q = spark.createDataFrame([(1, quoted + " and much else besides")], "query_id long, query_text string")
    s = spark.createDataFrame([(7, quoted), (8, quoted + " " + " ".join(f"other{chr(97 + k)} words" for k in range(26)) * 3), (9, "")], "doc_id long, text string")
    p = A.shared_phrases(q, s)
    assert {r["doc_id"] for r in p.collect()} == {7, 8}
    assert {r["doc_id"] for r in A.self_matches(p, phrases=5).collect()} == {7}
    assert A.self_matches(p).count() == 0
    with Scratch(spark) as scratch:
        assert {r["doc_id"] for r in A.contained(q, s, scratch, phrases=5).found.collect()} == {7}


def test_containment_join_equals_all_pairs(spark):
    rng = random.Random(3)
    words = [a + b + c for a in "xyz" for b in "abc" for c in "efg"]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(20)]
    texts = base + [b + " " + " ".join(rng.choices(words, k=rng.randint(0, 20))) for b in base for _ in range(2)] + base[:5] * 2 + [None, ""]
    s = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame([(k, t) for k, t in enumerate(texts) if k % 3 == 0], "query_id long, query_text string")
    every = A.shared_phrases(q, s)
    for phrases, coverage in ((1, 0.8), (10, 0.8), (5, 0.35), (1, 1.0), (30, 0.75)):
        want = {tuple(r) for r in A.self_matches(every, phrases, coverage).select("query_id", "doc_id", "shared", "distinct_shared", "total").collect()}
        with Scratch(spark) as scratch:
            assert {tuple(r) for r in A.contained(q, s, scratch, phrases, coverage).found.select("query_id", "doc_id", "shared", "distinct_shared", "total").collect()} == want
        assert want


def test_containment_join_verifies_few_pairs(spark):
    folder = "/root/testdata/sf0.01"
    q, s = adapters.queries(spark, folder), adapters.sources(spark, folder)
    with Scratch(spark) as scratch:
        assert 10 * A.contained(q, s, scratch).candidates.count() < A.shared_phrases(q, s).count()


def test_facts_are_cut_once(spark, smoke_dir):
    """The medians read counts of words, not the texts again for every pass."""
    from chronolex import plans, registry  # noqa: F401

    plan = registry.QUERIES["a10_facts_medians"](spark, smoke_dir)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert not any(x in plan for x in ("rlike", "regexp", "split("))


def test_pages_are_folded_once(spark, smoke_dir):
    """No filter repeats the cleaning or the fold of a page; a page without text has no passage."""
    from chronolex.operators import cleaning

    some = spark.createDataFrame([(1, 1, ""), (1, 2, None), (1, 3, "One. Two.")], "doc_id long, page int, text string")
    assert [tuple(r) for r in cleaning.chunks(some).collect()] == [(1, 3, 1, 0, 9, "One. Two.")]
    plan = cleaning.chunks(cleaning.cleaned(adapters.pages(spark, smoke_dir)))._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line.split("(")[0] and "aggregate(" in line for line in plan.split("\n"))


def test_exact_percentiles(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([None, rng.gauss(0, 1), float(rng.randint(0, 3))])) for g in (None, "a", "b") for _ in range(3000)] + [("one", 5.0), ("none", None)] + [("same", 1.0)] * 500
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, "g string, v double")
    want = {r["g"]: r for r in df.groupBy("g").agg(F.count("v").alias("n"), *[F.percentile("v", p).alias(n) for n, p in shares.items()]).collect()}
    got = {r["g"]: r for r in M.percentiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(want) and all(got[g][c] == pytest.approx(want[g][c], abs=1e-12) if want[g][c] is not None else got[g][c] is None for g in want for c in ("n", *shares))
    whole = M.percentiles(spark.range(100_001), [], "id", {"m": 0.5, "q": 0.123456}).first()
    assert (whole["m"], whole["q"], whole["n"]) == (50_000, pytest.approx(12345.6), 100_001)


def test_keyed_lookups_leave_the_store_where_it_lies(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    store = keyed.Keyed.write(rows, str(tmp_path / "store"), "k", 8)
    wanted = spark.range(0, 6000, 100).select(F.concat(F.lit("k"), "id").alias("k"))
    found = store.lookup(wanted.unionByName(wanted))
    assert sorted(r["id"] for r in found.collect()) == list(range(0, 5000, 100))
    assert sorted(r["k"] for r in store.missing(wanted).collect()) == sorted(f"k{k}" for k in range(5000, 6000, 100))
    plan = store.lookup(wanted)._jdf.queryExecution().executedPlan().toString()
    kept, asked = plan.split("FileScan parquet")
    assert "Exchange" not in kept and asked.count("Exchange") == 1
    assert [r["id"] for r in store.get("k17", "zz").collect()] == [17] and "PushedFilters: [In(k, [k17,zz])]" in store.get("k17", "zz")._jdf.queryExecution().executedPlan().toString()
    store.drop()


def test_pages_rejoin_to_the_ordered_scan(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("key"), F.col("id").alias("x")).repartition(7)
    kept = keyed.Ordered.write(rows, str(tmp_path / "ordered"), "key")
    want = [(r["key"], r["x"]) for r in rows.orderBy("key").collect()]
    for size in (1, 64, 333, 1000, 5000):
        got, token = [], None
        for page, token in kept.pages(size):
            assert len(page) <= size
            got += page
            if size == 1 and len(got) == 5 or size == 64 and len(got) == 640:
                break
        for page, token in keyed.Ordered(spark.newSession(), str(tmp_path / "ordered"), "key").pages(size if size > 1 else 500, token):
            got += page
        assert [(r["key"], r["x"]) for r in got] == want
    placed = sorted((r["place"], r["key"], r["page"]) for r in kept.numbered(64).collect())
    assert placed == [(k, k, k // 64) for k in range(1000)]
    assert list(keyed.Ordered.write(rows.limit(0), str(tmp_path / "none"), "key").pages()) == []


def test_salient_terms(spark):
    q = spark.createDataFrame([(1, "Anticipatory bail under Section 438 was refused. Anticipatory bail is discretionary."), (2, "the of and in court"), (3, "")], "query_id long, query_text string")
    got = {}
    for r in R.salient_terms(q).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["term"])
    assert set(got) == {1} and {"section", "438"} == set(got[1][:2]) and "anticipatory" in got[1]


def test_bm25_repeats_terms_and_keeps_statistics_global(spark):
    rows = [(f"c{k}", k, 2000 + k, t) for k, t in enumerate(["alpha beta", "alpha alpha gamma", "delta", "beta delta", "epsilon zeta eta"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, decision_year int, text string")
    q = spark.createDataFrame([(1, 2001, "alpha alpha"), (2, 2001, "alpha")], "query_id long, query_year int, query_text string")
    postings = R.index_postings(chunks)
    assert {(r["term"], r["chunk_id"]): (r["tf"], r["dl"]) for r in postings.collect()}["alpha", "c1"] == (2, 3)
    index = postings, R.index_terms(postings), R.index_size(chunks)
    scored = R.bm25(*index, R.query_terms(q, "legacy"), q)
    by = {(r["query_id"], r["chunk_id"]): r["score"] for r in scored.collect()}
    assert by[1, "c0"] == pytest.approx(2 * by[2, "c0"], abs=2e-6) and set(by) == {(k, c) for k in (1, 2) for c in ("c0", "c1")}
    assert {r["chunk_id"] for r in R.top_k(scored).collect()} == {"c0"}
    assert R.top_k(scored, before=False).count() == 4
    early = R.bm25(*index, R.query_terms(q, "legacy"), q, eligible=True)
    assert R.top_k(early).collect() == R.top_k(scored).collect()


def test_own_judgment_is_excluded_before_selection(spark):
    c = spark.createDataFrame([(1, 5, 1, 3.0), (1, 6, 2, 2.0), (1, 7, 3, 1.0)], "query_id long, doc_id long, rank long, score double")
    left = R.without(c, spark.createDataFrame([(1, 5), (2, 6)], "query_id long, doc_id long"))
    assert [(r["position"], r["doc_id"], r["rank"]) for r in R.diverse(left, 2).orderBy("position").collect()] == [(1, 6, 2), (2, 7, 3)]


def test_matches_by_any_name(spark):
    shape = "query_id long, source_id string, citation string, title string, decided string"
    wanted = spark.createDataFrame([(1, "S_1", None, None, None, 10), (1, None, "c2", None, None, 11), (1, "", "", "t", "2001-01-01", 12), (1, None, None, "t", "1999-01-01", 13), (1, "S_1", "c1", "x", None, 14)], shape + ", entry_id long")
    offered = spark.createDataFrame([(1, "S_1", "c1", "x", None, "a", 1, 1), (1, "S_2", "c2", "", "", "b", 2, 2), (1, "S_3", "", "t", "2001-01-01", "c", 3, 3), (2, "S_1", "c1", "x", None, "d", 1, 1)], shape + ", chunk_id string, doc_id long, rank long")
    got = {(r["entry_id"], r["chunk_id"], r["by"]) for r in validation.matches(offered, wanted).collect()}
    assert got == {(10, "a", "source"), (11, "b", "citation"), (12, "c", "title"), (14, "a", "citation+source")}


def test_rules_report_every_fault(spark):
    e = spark.createDataFrame([(1, "", None, False), (2, "x", 3, True), (3, None, 9, None)], "id long, name string, n int, ok boolean")
    rules = {**validation.blank(["name", "n"]), "not_ok": "NOT ok", "large": "n > 5"}
    assert sorted(tuple(r) for r in validation.broken(e, "id", rules).collect()) == [(1, "missing:n"), (1, "missing:name"), (1, "not_ok"), (3, "large"), (3, "missing:name")]
    assert {r["rule"]: r["n"] for r in validation.counted(e, rules).collect()} == {"missing:name": 2, "missing:n": 1, "not_ok": 1, "large": 1}
    assert {r["n"] for r in validation.counted(e.limit(0), rules).collect()} == {0}


def test_stored_tables_follow_their_input(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(len(made))
    (tmp_path / "in").mkdir()
    assert [store.stored(spark, str(tmp_path / "in"), "t", build).count() for _ in range(2)] == [1, 1]
    (tmp_path / "in" / "new").write_text("x")
    assert store.stored(spark, str(tmp_path / "in"), "t", build).count() == 2


def test_diverse(spark):
    c = spark.createDataFrame([(1, 5, 1, 3.0), (1, 5, 2, 2.0), (1, 6, 3, 2.0), (1, 7, 4, 2.0)], "query_id long, doc_id long, rank long, score double")
    assert [(r["position"], r["doc_id"]) for r in R.diverse(c, 2).orderBy("position").collect()] == [(1, 5), (2, 6)]


EV = "query_id long, position long, chunk_id string, text string, doc_id long, case_id string, court string, decision_year int, page int, status string"


def test_render_and_guards(spark):
    q = spark.createDataFrame([(1, "law?"), (2, "none"), (3, " ")], "query_id long, query_text string")
    e = spark.createDataFrame([(1, 1, "a", "t", 5, "x", "c", 1999, 1, "eligible"), (3, 1, "b", "t", 5, "x", "c", 1999, 1, "ineligible"), (3, 2, "b", "t", 5, "x", "c", 1999, 1, "eligible")], EV)
    a = {r["query_id"]: r for r in V.render(q, e.drop("status")).collect()}
    assert [a[k]["evidence_sufficiency"] for k in (1, 2, 3)] == ["limited", "insufficient", "multiple_selected_passages"]
    assert a[2]["uncertainty"].endswith(V.NO_EVIDENCE) and a[1]["evidence"][0]["evidence_id"] == "E1"
    assert '"evidence_ids":["E1"]' in V.as_json(V.render(q, e.drop("status"))).filter("query_id = 1").first()["answer"]
    assert sorted(tuple(r) for r in V.guards(q, e).collect()) == [(3, "blank_query"), (3, "ineligible_evidence"), (3, "repeated_chunk")]


def test_audit_and_verify_failures(spark):
    e = spark.createDataFrame([(1, k, f"c{k}", f"t{k}", k, f"x{k}", "court", 1990 + k, k, "eligible") for k in range(1, 4)], EV).drop("status")
    shown = e.withColumn("text", F.when(F.col("position") == 1, "changed").otherwise(F.col("text"))).withColumn("chunk_id", F.when(F.col("position") == 2, "zz").otherwise(F.col("chunk_id")))
    assert sorted((r["chunk_id"], r["reason"]) for r in V.audit(shown, e).collect()) == [("c1", "altered_passage"), ("zz", "unknown_chunk")]
    assert [r["reason"] for r in V.audit(e.filter("position < 3"), e).collect()] == ["evidence_count"]
    c = e.withColumn("evidence_id", F.concat(F.lit("E"), "position")).withColumn("query_year", F.lit(1992))
    for name in V.AUTHORITY:
        c = c.withColumn(f"law_{name}", F.col(name))
    c = c.unionByName(c.limit(1).withColumn("chunk_id", F.lit(None).cast("string")))
    retrieved = e.select("query_id", "chunk_id").filter("chunk_id <> 'c3'")
    duplicates = spark.createDataFrame([(1, 1)], "query_id long, doc_id long")
    got = {r["chunk_id"]: (r["failures"], r["passed"]) for r in V.verify(c, e.drop("query_id", "position"), retrieved, duplicates).collect()}
    assert got["c1"] == (["query_duplicate_source"], False) and got["c2"] == (["temporal_same_year_unresolved"], False)
    assert got["c3"] == (["temporal_ineligible", "not_retrieved_for_query"], False) and got[None] == (["authority_without_linked_evidence"], False)


@pytest.mark.parametrize(("n", "want"), [(1200, [0, 460, 690]), (300, [0]), (510, [0]), (970, [0, 460])])
def test_window_starts(spark, n, want):
    assert one(spark, n, lambda v: M.window_starts(v, 510, 50), "int") == want


def test_pooling_ties(spark):
    l = spark.createDataFrame([(1, 0, 1.0, 2.0, 1), (1, 1, 2.0, 1.0, 1)], "document long, window long, l0 double, l1 double, label int")
    assert M.mean_pool(l).first()["guess"] == 0 and M.vote_pool(l).first()["guess"] == 0
    c = M.confusion(M.mean_pool(l), "label", "guess").first()
    assert (c["n10"], c["accuracy"], c["macro_f1"]) == (1, 0.0, 0.0)


def test_formats(spark, tmp_path):
    good = '{"source_id":"s","chunk_id":"c1","court":"x","title":"t","decision_date":"31-12-2009","pdf_file":"f","page_number":1,"passage_start_char":0,"passage_end_char":4,"text":"word","cleaning_version":"v"}'
    (tmp_path / "c.jsonl").write_text("\n".join([good, "", "{broken", good.replace('"text":"word"', '"text":""').replace("c1", "c2"), good]))
    rows, bad = formats.read_chunks(spark, str(tmp_path / "c.jsonl"))
    assert rows.count() == 3 and bad.count() == 1
    assert {r["rule"]: r["n"] for r in formats.violations(rows).collect()}["missing:text"] == 1
    formats.load_store(rows, str(tmp_path / "store"))
    stored = formats.store_table(spark, str(tmp_path / "store"))
    assert stored.count() == 2 and str(stored.first()["decision_date"]) == "2009-12-31"
    formats.write_csv(rows.select("chunk_id"), str(tmp_path / "csv"))
    assert formats.read_crosswalk(spark, str(tmp_path / "csv")).count() == 3
    (tmp_path / "d.json").write_text('{"entries":[{"a":1},{"a":2}]}')
    assert formats.read_document(spark, str(tmp_path / "d.json")).count() == 2
    formats.write_json(rows, str(tmp_path / "json"))
    assert formats.markdown(rows.select("chunk_id").limit(1)).startswith("| chunk_id |\n| --- |")
    formats.write_windows(spark.createDataFrame([(1, 0, 0, 510), (1, 1, 460, 700)], formats.WINDOWS), str(tmp_path / "windows"))
    assert [r["stop"] for r in formats.read_windows(spark, str(tmp_path / "windows")).orderBy("start").collect()] == [510, 700]


def test_streaming_drops_repeats(spark, tmp_path):
    rows = [("c1", "s", 1999, "2024-01-01 00:00:00", "a"), ("c1", "s", 1999, "2024-01-01 00:05:00", "a"), ("c2", "s", 2000, "2024-01-01 00:01:00", "b")]
    df = spark.createDataFrame(rows, "chunk_id string, source_id string, decision_year int, arrived string, text string").withColumn("arrived", F.col("arrived").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    ingest.append_to(ingest.distinct_chunks(ingest.read_chunks(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.option("recursiveFileLookup", "true").schema(ingest.CHUNKS).parquet(str(tmp_path / "out")).count() == 2
    seen = ingest.arrivals(ingest.read_chunks(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("arrived").outputMode("complete").start()
    seen.processAllAvailable()
    seen.stop()
    assert sorted((r["decision_year"], r["n"]) for r in spark.table("arrived").collect()) == [(1999, 2), (2000, 1)]


def test_outcome_terms(spark):
    row = outcome.terms(spark.createDataFrame([("Café on a Road",)], "text string")).first()
    assert row["terms"] == ["cafe", "on", "road", "cafe on", "on road"]


def test_sampling(spark):
    r = spark.range(100).withColumn("s", F.col("id") % 3)
    assert sampling.sample(r, "id", 7).count() == 7 and sampling.stratified(r, "id", ["s"], 4).count() == 12
    assert {x["id"] for x in sampling.sample(r, "id", 7).collect()} == {x["id"] for x in sampling.sample(r.repartition(5), "id", 7).collect()}
    assert sorted(x["id"] for x in sampling.latest(r, ["s"], [F.col("id")]).collect()) == [97, 98, 99]
