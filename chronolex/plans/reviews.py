"""Answer keys, probes, ratings, released answers and replays: validators over stored and tampered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import text as T
from ..operators import answers as V
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators import validation as C
from ..registry import register
from ..sources.adapters import cases, fold, having, logits, queries, sources, table
from ..sources.store import stored, written
from .evaluation import ALL, EVIDENCE, KEY, MEAN, VOTE, _corpus, _judged, _run, checked, own_sources, tampered
from .retrieval import candidates, expected

# --- answer key ----------------------------------------------------------------

HOST = "https://host.example"
KEY_COLUMNS = f"""d.doc_id AS entry_id, 'q' || d.doc_id AS query_case_id, CASE WHEN n % 10 < 6 THEN 'test' WHEN n % 10 < 8 THEN 'train' ELSE 'validation' END AS split, q.title AS query_case_title, CAST(q.decision_date AS {{text}}) AS query_decision_date,
 CASE WHEN n % 9 = 8 THEN 'http:' ELSE 'https:' END || '//host.example/' || d.doc_id || '_EN.pdf' AS query_source_url, a.title AS authority_title, CASE WHEN n % 6 = 5 THEN '' ELSE a.case_id END AS authority_citation, CAST(a.decision_date AS {{text}}) AS authority_decision_date,
 CASE WHEN n % 3 = 0 THEN a.source_id END AS authority_source_id, CASE WHEN n % 8 = 7 THEN 'mentions' WHEN n % 2 = 0 THEN 'cites' ELSE 'follows' END AS relationship, CASE WHEN n % 7 = 6 THEN '' ELSE 'p. ' || (1 + n % 5) END AS source_locator, '{HOST}/' || a.doc_id || '_EN.pdf' AS verification_source_url,
 CASE WHEN n % 11 = 10 THEN NULL ELSE '2024-01-15' END AS verified_on, n % 5 <> 4 AS independent_of_system_retrieval, CASE WHEN n % 13 = 12 THEN 'draft' WHEN n % 10 < 7 THEN 'evaluation' ELSE 'dev_example' END AS status, d.text AS query_text"""
KEY_VIEW = f"answer_key AS (SELECT {KEY_COLUMNS.format(text='VARCHAR')} FROM (SELECT doc_id, doc_id // 20 AS n, text FROM documents WHERE doc_id % 20 = 0) d JOIN sources q ON q.doc_id = d.doc_id JOIN sources a ON a.doc_id = d.doc_id + 1)"


def answer_key(spark, sf_dir):
    """Entries for every twentieth document, whose authority is the document after it; fields fail by arithmetic."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0").select("doc_id", F.expr("doc_id div 20").alias("n"), "text").alias("d")
    s = sources(spark, sf_dir).drop("text")
    a = s.withColumn("at", F.col("doc_id") - 1).alias("a")
    met = d.join(s.alias("q"), F.col("d.doc_id") == F.col("q.doc_id")).join(a, F.col("d.doc_id") == F.col("a.at"))
    return met.selectExpr(*_split(KEY_COLUMNS.format(text="STRING")))


def _split(columns: str) -> list[str]:
    """Expressions of a select list, at commas outside of brackets and quotes."""
    out, depth, quoted, begin = [], 0, False, 0
    for k, c in enumerate(columns):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(columns[begin:k])
            begin = k + 1
    return [x.strip() for x in [*out, columns[begin:]]]


REQUIRED = ["query_case_id", "query_case_title", "query_decision_date", "query_source_url", "authority_title", "authority_citation", "authority_decision_date", "relationship", "source_locator", "verification_source_url", "verified_on", "independent_of_system_retrieval", "status"]
KEY_RULES = {
    **C.blank(REQUIRED),
    "relationship": "relationship NOT IN ('cites', 'follows')",
    "status": "status NOT IN ('evaluation', 'dev_example')",
    "not_independent": "NOT independent_of_system_retrieval",
    "not_https": "query_source_url NOT LIKE 'https://%' OR verification_source_url NOT LIKE 'https://%'",
    "evaluation_outside_test": "status = 'evaluation' AND split <> 'test'",
}


def counted_sql(rules: dict[str, str], view: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS rule, coalesce(sum((coalesce({v.replace('STRING', 'VARCHAR')}, false))::INT), 0)::BIGINT AS n FROM {view}" for k, v in rules.items())


@register("v11_schema_violations", having("sources") + f", {KEY_VIEW} {counted_sql(KEY_RULES, 'answer_key')}")
def v11_schema_violations(spark, sf_dir):
    """Every required field and every rule of the answer key, with the entries that break it."""
    return C.counted(answer_key(spark, sf_dir), KEY_RULES)


@register("v11_broken_entries", having("sources") + f", {KEY_VIEW} SELECT entry_id, rule FROM (" + " UNION ALL ".join(f"SELECT entry_id, '{k}' AS rule FROM answer_key WHERE {v.replace('STRING', 'VARCHAR')}" for k, v in KEY_RULES.items()) + ")")
def v11_broken_entries(spark, sf_dir):
    return C.broken(answer_key(spark, sf_dir), "entry_id", KEY_RULES)


PROBE_COLUMNS = "entry_id, CASE WHEN entry_id % 180 = 0 THEN 'test' ELSE 'dev' END AS split, split AS source_split, CASE WHEN entry_id % 140 = 120 THEN 'q20' ELSE query_case_id END AS query_case_id, 'S_' || entry_id AS query_source_id, query_decision_date, 'S_' || (entry_id + 1) AS authority_source_id, authority_decision_date, CASE WHEN entry_id % 160 = 60 THEN '' ELSE 'judgment' END AS authority_source_type, source_locator AS authority_passage_locator, CASE WHEN entry_id % 60 = 0 THEN 'OCR-repaired' ELSE 'native-text' END AS authority_verification_method, independent_of_system_retrieval, entry_id % 220 <> 200 AS query_alignment_title_party_passed, CAST((entry_id * 7) % 900 AS {whole}) AS query_alignment_direct_six_token_phrases, authority_citation <> '' AS authority_citation_present_in_query_source"
PROBE_FIELDS = [x.split(" AS ")[-1].strip() for x in _split(PROBE_COLUMNS)][1:]
PROBE_RULES = {
    **C.blank(PROBE_FIELDS),
    "not_dev_only": "split <> 'dev' OR source_split NOT IN ('train', 'validation')",
    "title_party": "NOT query_alignment_title_party_passed",
    "few_phrases": "query_alignment_direct_six_token_phrases < 100",
    "citation_not_verified": "NOT authority_citation_present_in_query_source",
    "not_earlier": "authority_decision_date >= query_decision_date",
    "repeated_query": "copies > 1",
    "not_8_to_10": "entry_id = least_id AND (queries < 8 OR queries > 10)",
}
PROBE_VIEW = f"probe AS (SELECT *, count(*) OVER (PARTITION BY query_case_id) AS copies, min(entry_id) OVER () AS least_id, (SELECT count(DISTINCT query_case_id) FROM few) AS queries FROM few)"
FEW_VIEW = f"few AS (SELECT {PROBE_COLUMNS.format(whole='BIGINT')} FROM (SELECT * FROM answer_key WHERE split <> 'test') k)"


@register("v12_probe_violations", having("sources") + f", {KEY_VIEW}, {FEW_VIEW}, {PROBE_VIEW} {counted_sql(PROBE_RULES, 'probe')}")
def v12_probe_violations(spark, sf_dir):
    """The fourteen fields of a development probe, and that it is for development only, dated, aligned, distinct and of the right size."""
    few = answer_key(spark, sf_dir).filter("split <> 'test'").selectExpr(*_split(PROBE_COLUMNS.format(whole="BIGINT")))
    copies = few.groupBy("query_case_id").agg(F.count("*").alias("copies"))
    whole = few.agg(F.struct(F.countDistinct("query_case_id").alias("queries"), F.min("entry_id").alias("least_id"))).scalar()
    return C.counted(few.join(copies, "query_case_id", "left").withColumn("w", whole).select("*", "w.*"), PROBE_RULES)


GATE = "CASE WHEN c.id IS NULL THEN 'unknown_case' WHEN k.status = 'evaluation' AND c.split <> 'test' THEN 'not_in_test_split' WHEN k.status = 'dev_example' AND c.split = 'test' THEN 'in_test_split' WHEN k.query_decision_date IS NULL OR k.authority_decision_date IS NULL THEN 'undated' WHEN k.authority_decision_date >= k.query_decision_date THEN 'not_earlier' WHEN k.status = 'draft' THEN 'draft' ELSE 'admitted' END"


@register("v15_candidate_gate", having("sources", "cases") + f", {KEY_VIEW} SELECT k.entry_id, {GATE} AS gate FROM answer_key k LEFT JOIN cases c ON c.doc_id = k.entry_id + CASE WHEN k.entry_id % 260 = 240 THEN 100000000 ELSE 10 END")
def v15_candidate_gate(spark, sf_dir):
    """Why a candidate may or may not enter source verification, by membership in the fixed splits and by date."""
    k = answer_key(spark, sf_dir).withColumn("at", F.expr("entry_id + CASE WHEN entry_id % 260 = 240 THEN 100000000 ELSE 10 END")).alias("k")
    c = cases(spark, sf_dir).select("doc_id", "id", "split").alias("c")
    return k.join(c, F.col("c.doc_id") == F.col("k.at"), "left").selectExpr("k.entry_id", f"{GATE} AS gate")


# --- matching by source, citation, or title and date ------------------------------

TITLE_SQL = "array_to_string(list_filter(regexp_extract_all(regexp_replace(replace({0}, 'versus', ' v '), '\\bu\\.?\\s*p\\.?\\b', 'uttar pradesh', 'g'), '[a-z0-9]+'), lambda x: x NOT IN ('and', 'anr', 'another', 'ors', 'others', 'etc', 'of', 'the')), ' ')"
CITATION_SQL = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
WANTED = f"""wanted AS (SELECT e.query_id * 10 AS entry_id, e.query_id, CASE WHEN e.query_id // 100 % 3 = 0 THEN s.source_id END AS source_id, CASE WHEN e.query_id // 100 % 3 = 1 THEN {CITATION_SQL.format(fold("upper(s.case_id) || '  '"))} END AS citation, CASE WHEN e.query_id // 100 % 3 = 2 THEN {TITLE_SQL.format(fold("upper(s.title) || ' and Others'"))} END AS title, s.decision_date::VARCHAR AS decided FROM expected e JOIN sources s ON s.doc_id = e.doc_id),
 offered AS (SELECT k.query_id, k.chunk_id, k.doc_id, k.rank, s.source_id, {CITATION_SQL.format(fold('s.case_id'))} AS citation, {TITLE_SQL.format(fold('s.title'))} AS title, s.decision_date::VARCHAR AS decided FROM kept k JOIN sources s ON s.doc_id = k.doc_id),
 arms AS (SELECT w.entry_id, w.query_id, o.chunk_id, o.doc_id, o.rank, coalesce(w.citation <> '' AND w.citation = o.citation, false) AS c, coalesce(w.source_id <> '' AND w.source_id = o.source_id, false) AS s, coalesce(w.title <> '' AND w.title = o.title AND w.decided = o.decided, false) AS t FROM wanted w JOIN offered o ON o.query_id = w.query_id WHERE (w.source_id <> '' AND w.source_id = o.source_id) OR (w.citation <> '' AND w.citation = o.citation) OR (w.title <> '' AND w.title = o.title AND w.decided = o.decided)),
 matched AS (SELECT entry_id, query_id, chunk_id, doc_id, rank, array_to_string(list_filter([CASE WHEN c THEN 'citation' END, CASE WHEN s THEN 'source' END, CASE WHEN t THEN 'title' END], lambda x: x IS NOT NULL), '+') AS by_ FROM arms)"""


def _wanted(spark, sf_dir):
    """Expected authorities, named by source id, by citation or by title, in turn, in other spellings."""
    s = sources(spark, sf_dir).drop("text")
    n = F.expr("query_id div 100") % 3
    title = T.title(F.concat(F.upper("title"), F.lit(" and Others")))
    return expected(spark, sf_dir).join(s, "doc_id").select((F.col("query_id") * 10).alias("entry_id"), "query_id", F.when(n == 0, F.col("source_id")).alias("source_id"), F.when(n == 1, T.citation(F.upper("case_id"))).alias("citation"), F.when(n == 2, title).alias("title"), F.col("decision_date").cast("string").alias("decided"))


def _offered(spark, sf_dir):
    s = sources(spark, sf_dir).select("doc_id", "source_id", T.citation(F.col("case_id")).alias("citation"), T.title(F.col("title")).alias("title"), F.col("decision_date").cast("string").alias("decided"))
    return candidates(spark, sf_dir).select("query_id", "chunk_id", "doc_id", "rank").join(s, "doc_id")


@register("j12_disjunctive_match", f"{ALL}, {KEY}, {WANTED} SELECT entry_id, query_id, chunk_id, rank, by_ AS matched_by FROM matched")
def j12_disjunctive_match(spark, sf_dir):
    return C.matches(_offered(spark, sf_dir), _wanted(spark, sf_dir)).select("entry_id", "query_id", "chunk_id", "rank", F.col("by").alias("matched_by"))


@register("v05_answer_key", f"""{ALL}, {KEY}, {WANTED}, m AS (SELECT entry_id, min(matched.rank) AS rank, bool_or(p.chunk_id IS NOT NULL) AS shown FROM matched LEFT JOIN pick p ON p.query_id = matched.query_id AND p.chunk_id = matched.chunk_id GROUP BY entry_id)
 SELECT w.entry_id, w.query_id, m.rank, CASE WHEN shown THEN 'retrieved_and_selected' WHEN m.rank IS NOT NULL THEN 'retrieved_not_selected' ELSE 'absent' END AS bucket FROM wanted w LEFT JOIN m ON m.entry_id = w.entry_id""")
def v05_answer_key(spark, sf_dir):
    """What became of each expected authority, matched as an answer key names it."""
    wanted, shown = _wanted(spark, sf_dir), _run(spark, sf_dir)[1].select("query_id", "chunk_id", F.lit(True).alias("shown"))
    m = C.matches(_offered(spark, sf_dir), wanted).join(shown, ["query_id", "chunk_id"], "left").groupBy("entry_id").agg(F.min("rank").alias("rank"), F.max("shown").alias("shown"))
    bucket = F.when(F.col("shown"), "retrieved_and_selected").when(F.col("rank").isNotNull(), "retrieved_not_selected").otherwise("absent")
    return wanted.join(m, "entry_id", "left").select("entry_id", "query_id", "rank", bucket.alias("bucket"))


# --- released answers, rebuilds and replays ---------------------------------------

SOME = "query_id % 200 = 0"
"""Queries whose stored answers are tampered with; those of the others must pass."""


def gated(spark, sf_dir):
    pre, ev = _run(spark, sf_dir)
    c = tampered(ev, F.expr(SOME)).withColumn("evidence_id", F.concat(F.lit("E"), "position"))
    for name in V.AUTHORITY:
        c = c.withColumn(f"law_{name}", F.col(name))
    c = c.withColumn("law_case_id", F.when((F.col("position") == 5) & F.expr(SOME), F.concat("case_id", F.lit("x"))).otherwise(F.col("case_id")))
    return V.verify(c, _corpus(spark, sf_dir, c), pre, own_sources(spark, sf_dir))


GATED = f"{ALL}, {EVIDENCE}, {checked('s.' + SOME, SOME)}, gate AS (SELECT query_id, count(*) AS shown, sum((len(f) > 0)::INT)::BIGINT AS failed FROM chk GROUP BY query_id)"


@register("v07_pipeline_gate", f"{GATED} SELECT query_id, shown, failed, failed = 0 AS released FROM gate")
def v07_pipeline_gate(spark, sf_dir):
    """Answers are released only if no citation fails against the corpus, the run, the query's own judgment and the time rule."""
    return gated(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("shown"), F.sum((~F.col("passed")).cast("long")).alias("failed")).withColumn("released", F.col("failed") == 0)


FAULTS = {
    "ungrounded": "passage_mismatch|corpus_chunk_missing",
    "provenance_faults": "corpus_metadata_mismatch:.*|authority_metadata_mismatch:.*|authority_without_linked_evidence",
    "temporal_faults": "temporal_.*",
    "not_from_run": "not_retrieved_for_query|query_duplicate_source",
}


@register("a15_grounding_metrics", f"{GATED} SELECT count(*) AS shown, " + ", ".join(f"sum((len(list_filter(f, lambda x: regexp_full_match(x, '{v}'))) > 0)::INT)::BIGINT AS {k}" for k, v in FAULTS.items()) + ", sum((len(f) > 0)::INT)::BIGINT AS unsupported, " + ", ".join(f"CASE WHEN count(*) > 0 THEN round(1.0 - sum((len(list_filter(f, lambda x: regexp_full_match(x, '{FAULTS[k]}'))) > 0)::INT) / count(*), 6) END AS {n}" for k, n in (("ungrounded", "groundedness"), ("provenance_faults", "provenance_validity"))) + " FROM chk")
def a15_grounding_metrics(spark, sf_dir):
    """Shares of shown citations that are grounded and have valid provenance, and how many break the time rule or are unsupported."""
    g = gated(spark, sf_dir)
    has = lambda v: F.exists("failures", lambda x: x.rlike(f"^(?:{v})$"))
    n = g.agg(F.count("*").alias("shown"), *[F.coalesce(F.sum(has(v).cast("long")), F.lit(0)).alias(k) for k, v in FAULTS.items()], F.coalesce(F.sum((~F.col("passed")).cast("long")), F.lit(0)).alias("unsupported"))
    left = lambda k: M.ratio(F.col("shown") - F.col(k), F.col("shown"))
    return n.withColumn("groundedness", left("ungrounded")).withColumn("provenance_validity", left("provenance_faults"))


LOST = "query_id % 300 = 0 AND position = 2"


@register("v08_spot_check", f"{ALL}, {EVIDENCE}, a AS (SELECT query_id, list(chunk_id ORDER BY position) AS ids FROM ev GROUP BY query_id), b AS (SELECT query_id, list(chunk_id ORDER BY position) AS ids, count(*) AS n FROM ev WHERE NOT ({LOST}) GROUP BY query_id) SELECT a.query_id, a.ids = b.ids AS equal, n FROM a JOIN b ON a.query_id = b.query_id")
def v08_spot_check(spark, sf_dir):
    """Answers rendered anew against stored ones: the same chunks in the same order. Some stored answers lost a passage."""
    _, ev = _run(spark, sf_dir)
    shown = V.render(queries(spark, sf_dir), ev.drop("status", "query_year")).select("query_id", F.transform("evidence", lambda e: e["chunk_id"]).alias("a"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))), lambda x: x["chunk_id"])
    kept = stored(spark, sf_dir, "answers", lambda: ev.filter(f"NOT ({LOST})").groupBy("query_id").agg(ids.alias("b"), F.count("*").alias("n")))
    return shown.join(kept, "query_id").select("query_id", (F.col("a") == F.col("b")).alias("equal"), "n")


INSC = "\\d{4} INSC \\d+"


@register("v09_presentation_parity", f"""{ALL}, {EVIDENCE}, shown AS (SELECT query_id, string_agg('[' || evidence_id || '] ' || case_id || ', ' || court, chr(10) ORDER BY position) AS structured, string_agg(CASE WHEN {LOST} THEN 'omitted' ELSE case_id END, '; ' ORDER BY position) AS plain FROM ev GROUP BY query_id)
 SELECT query_id, structured, plain, regexp_extract_all(structured, '{INSC}') = regexp_extract_all(plain, '{INSC}') AS same_ids FROM shown""")
def v09_presentation_parity(spark, sf_dir):
    """Both presentations must cite the same cases in the same order; some plain ones leave one out."""
    _, ev = _run(spark, sf_dir)
    named = ev.withColumn("told", F.when(F.expr(LOST), "omitted").otherwise(F.col("case_id")))
    held = named.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "case_id", "court", "told"))).alias("e"))
    line = lambda e: F.concat(F.lit("[E"), e["position"], F.lit("] "), e["case_id"], F.lit(", "), e["court"])
    both = held.select("query_id", F.array_join(F.transform("e", line), "\n").alias("structured"), F.array_join(F.transform("e", lambda e: e["told"]), "; ").alias("plain"))
    ids = lambda c: F.regexp_extract_all(c, F.lit(INSC), F.lit(0))
    return both.withColumn("same_ids", ids("structured") == ids("plain"))


RUNS = f"{ALL}, {EVIDENCE}, first AS (SELECT query_id, position, sha256(chunk_id || '|' || doc_id || '|' || text) AS h FROM ev), again AS (SELECT 'replay' AS run, query_id, position, h FROM first UNION ALL SELECT 'tampered', query_id, position, CASE WHEN {LOST} THEN sha256(h) ELSE h END FROM first UNION ALL SELECT 'cut', query_id, position, h FROM first WHERE position < 5)"


@register("v13_replay_determinism", f"{RUNS}, names AS (SELECT DISTINCT run FROM again) SELECT names.run, count(*) AS n, sum((f.h IS DISTINCT FROM a.h)::INT)::BIGINT AS different, sum((f.h IS DISTINCT FROM a.h)::INT) = 0 AS equal FROM names CROSS JOIN first f LEFT JOIN again a ON a.run = names.run AND a.query_id = f.query_id AND a.position = f.position GROUP BY names.run")
def v13_replay_determinism(spark, sf_dir):
    """A run made anew from the tables against the stored one, beside one with altered passages and one cut short."""
    from ..operators import retrieval as R
    from .retrieval import _scored

    row = lambda ev: ev.select("query_id", "position", F.sha2(F.concat_ws("|", "chunk_id", "doc_id", "text"), 256).alias("h"))
    kept = row(_run(spark, sf_dir)[1])
    fresh = written(R.diverse(R.without(R.top_k(_scored(spark, sf_dir, "salient", True, CONFIG.top_k)), own_sources(spark, sf_dir))).select("query_id", "position", "chunk_id"), "fresh")
    replay = row(fresh.join(_corpus(spark, sf_dir, fresh), "chunk_id"))
    altered = kept.withColumn("h", F.when(F.expr(LOST), F.sha2("h", 256)).otherwise(F.col("h")))
    again = [("replay", replay), ("tampered", altered), ("cut", kept.filter("position < 5"))]
    out = None
    for name, other in again:
        part = kept.join(other.withColumnRenamed("h", "g"), ["query_id", "position"], "left").select(F.lit(name).alias("run"), (~F.col("h").eqNullSafe(F.col("g"))).cast("long").alias("d"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("run").agg(F.count("*").alias("n"), F.sum("d").alias("different")).withColumn("equal", F.col("different") == 0)


EXPERIMENTS = f"{MEAN}, {VOTE}, x AS (SELECT 'mean' AS name, 'facts-v1' AS rule, document, label FROM mean UNION ALL SELECT 'vote', 'facts-v1', document, label FROM vote UNION ALL SELECT 'part', 'facts-v1', document, label FROM vote WHERE document % 10 <> 3 UNION ALL SELECT 'other_rule', 'facts-v2', document, label FROM mean)"


@register("v14_comparable_experiments", having("logits") + f", {EXPERIMENTS}, e AS (SELECT name, any_value(rule) AS rule, sha256(string_agg(document || ':' || label, chr(10) ORDER BY document)) AS digest, count(*) AS n FROM x GROUP BY name) SELECT a.name AS first, b.name AS second, a.rule = b.rule AS same_rule, a.digest = b.digest AS same_ids, a.n = b.n AS same_n, a.rule = b.rule AND a.digest = b.digest AND a.n = b.n AS comparable FROM e a JOIN e b ON a.name < b.name")
def v14_comparable_experiments(spark, sf_dir):
    """Experiments may be compared if rule, digest of ids with labels, and counts are the same; each is pooled by itself."""
    l = logits(spark, sf_dir)
    mean, vote = M.mean_pool(l).select("document", "label"), M.vote_pool(l).select("document", "label")
    made = [("mean", "facts-v1", mean), ("vote", "facts-v1", vote), ("part", "facts-v1", vote.filter("document % 10 <> 3")), ("other_rule", "facts-v2", mean)]
    all_ = None
    for name, rule, rows in made:  # experiments; an evaluation set has one row a document
        part = S.digest(rows, F.concat("document", F.lit(":"), "label"), F.col("document")).select(F.lit(name).alias("name"), F.lit(rule).alias("rule"), "digest", "n")
        all_ = part if all_ is None else all_.unionByName(part)
    a, b = all_.alias("a"), all_.alias("b")
    same = [(F.col(f"a.{c}") == F.col(f"b.{c}")).alias(f"same_{d}") for c, d in (("rule", "rule"), ("digest", "ids"), ("n", "n"))]
    pairs = a.join(b, F.col("a.name") < F.col("b.name")).select(F.col("a.name").alias("first"), F.col("b.name").alias("second"), *same)  # a row per experiment
    return pairs.withColumn("comparable", F.col("same_rule") & F.col("same_ids") & F.col("same_n"))


ROLE = "CASE WHEN query_id % 300 = 0 THEN 'clean_success' WHEN bucket = 'retrieved_and_selected' THEN 'clean_success' WHEN bucket = 'retrieved_not_selected' THEN 'retrieved_late' ELSE 'absent_at_depth' END"
ROLES = {"clean_success": "retrieved_and_selected", "retrieved_late": "retrieved_not_selected", "absent_at_depth": "absent"}


@register("v16_inventory_checks", f"{GATED}, {KEY}, r AS (SELECT query_id, bucket, {ROLE} AS role FROM judged) SELECT r.query_id, role, bucket, m.wanted, shown - failed AS checks_passed, bucket = m.wanted AND coalesce(failed, 1) = 0 AND coalesce(shown, 0) = 5 AS passed FROM r LEFT JOIN (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)})' for k, v in ROLES.items())}) m(role, wanted) USING (role) LEFT JOIN gate ON gate.query_id = r.query_id")
def v16_inventory_checks(spark, sf_dir):
    """Whether each reviewed case lies in the bucket that its role promises and all its citations pass."""
    judged = _judged(spark, sf_dir)[0].select("query_id", "bucket", F.expr(ROLE).alias("role"))
    wanted = F.coalesce(*[F.when(F.col("role") == k, v) for k, v in ROLES.items()])
    gate = v07_pipeline_gate(spark, sf_dir)
    met = judged.withColumn("wanted", wanted).join(gate, "query_id", "left")
    passed = (F.col("bucket") == F.col("wanted")) & (F.coalesce("failed", F.lit(1)) == 0) & (F.coalesce("shown", F.lit(0)) == 5)
    return met.select("query_id", "role", "bucket", "wanted", (F.col("shown") - F.col("failed")).alias("checks_passed"), passed.alias("passed"))


@register("m04_exact_metrics", having("logits") + f", {MEAN}, kept AS (SELECT document, label, CASE WHEN document % 20 = 7 THEN 1 - guess ELSE guess END AS guess FROM mean), s AS (SELECT 'rebuilt' AS run, document, label, guess FROM mean UNION ALL SELECT 'altered', document, label, guess FROM kept), a AS (SELECT count(*) AS n, sum((label = guess)::INT) AS right FROM mean), b AS (SELECT run, count(*) AS n, sum((label = guess)::INT)::BIGINT AS right FROM s GROUP BY run) SELECT run, b.n, b.right AS correct, b.n = a.n AND b.right = a.right AS equal FROM b, a".replace(" AS right", " AS hits").replace("b.right", "b.hits").replace("a.right", "a.hits"))
def m04_exact_metrics(spark, sf_dir):
    """Scores of predictions rebuilt from logits against stored ones, beside stored ones that were altered."""
    l = logits(spark, sf_dir)
    fresh = M.mean_pool(l.repartition("document")).select("document", "label", "guess")
    kept = stored(spark, sf_dir, "predictions", lambda: M.mean_pool(l).select("document", "label", "guess"))
    score = [F.count("*").alias("n"), F.sum((F.col("label") == F.col("guess")).cast("long")).alias("correct")]
    altered = kept.withColumn("guess", F.when(F.col("document") % 20 == 7, 1 - F.col("guess")).otherwise(F.col("guess")))
    want = kept.agg(F.struct(*score)).scalar()
    both = fresh.agg(*score).withColumn("run", F.lit("rebuilt")).unionByName(altered.agg(*score).withColumn("run", F.lit("altered")))
    return both.withColumn("w", want).select("run", "n", "correct", ((F.col("n") == F.col("w.n")) & (F.col("correct") == F.col("w.correct"))).alias("equal"))


# --- ratings -----------------------------------------------------------------------

CRITERIA = ("clarity", "relevance", "support", "caution")
VALUE = "CASE WHEN (n + {k}) % 12 = 11 THEN 6 WHEN n % 14 = 13 AND {k} = 2 THEN NULL ELSE 1 + (doc_id * {m} + n * {k}) % 5 END"
DISPLAYS = [(f"{c}_{d}", VALUE.format(k=k + 1, m=2 * k + 3 + d)) for d in (1, 2) for k, c in enumerate(CRITERIA)]
RATING_COLUMNS = "doc_id AS case_id, CASE WHEN n % 2 = 0 THEN 'structured_first' ELSE 'plain_first' END AS wanted_order, CASE WHEN n % 9 = 8 THEN 'plain_first' WHEN n % 2 = 0 THEN 'structured_first' ELSE 'plain_first' END AS presentation_order, CASE WHEN n % 8 = 7 THEN ' ' ELSE 'display_1' END AS comparison_preference, n % 10 = 9 AS unrated, " + ", ".join(f"{v} AS {c}" for c, v in DISPLAYS)
RATINGS = f"ratings AS (SELECT {RATING_COLUMNS} FROM (SELECT doc_id, doc_id // 20 AS n FROM documents WHERE doc_id % 20 = 0))"
RATING_RULES = {
    "missing_case": "unrated",
    "order_changed": "NOT unrated AND presentation_order <> wanted_order",
    "no_preference": "NOT unrated AND trim(comparison_preference) = ''",
    **{f"not_1_to_5:{c}": f"NOT unrated AND ({c} IS NULL OR {c} < 1 OR {c} > 5)" for c, _ in DISPLAYS},
}
VALID = f"NOT ({' OR '.join(f'coalesce({v}, false)' for v in RATING_RULES.values())})"


def ratings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0").selectExpr("doc_id", "doc_id div 20 AS n")
    return d.selectExpr(*_split(RATING_COLUMNS))


@register("v10_response_validation", f"WITH {RATINGS} {counted_sql(RATING_RULES, 'ratings')}")
def v10_response_validation(spark, sf_dir):
    """All cases rated once, in the fixed order, on a scale of whole numbers from 1 to 5, with a preference."""
    return C.counted(ratings(spark, sf_dir), RATING_RULES)


@register("a21_rating_means", f"WITH {RATINGS} SELECT presentation, criterion, round(avg(v), 6) AS mean, count(v) AS n FROM (" + " UNION ALL ".join(f"SELECT CASE WHEN (presentation_order = 'structured_first') = {'true' if d == 1 else 'false'} THEN 'structured' ELSE 'plain' END AS presentation, '{c}' AS criterion, {c}_{d} AS v FROM ratings WHERE {VALID}" for d in (1, 2) for c in CRITERIA) + ") GROUP BY presentation, criterion")
def a21_rating_means(spark, sf_dir):
    """Mean ratings of either presentation, over valid responses."""
    r = ratings(spark, sf_dir).filter(VALID)
    first = F.col("presentation_order") == "structured_first"
    long = None
    for d in (1, 2):
        shown = F.when(first == F.lit(d == 1), "structured").otherwise("plain").alias("presentation")
        part = r.select(shown, *[F.col(f"{c}_{d}").alias(c) for c in CRITERIA]).unpivot(["presentation"], list(CRITERIA), "criterion", "v")
        long = part if long is None else long.unionByName(part)
    return long.groupBy("presentation", "criterion").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("n"))
