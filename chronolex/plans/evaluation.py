"""Answers, their verification, and evaluation of retrieval and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CONFIG
from ..operators import answers as V
from ..operators import metrics as M
from ..operators import retrieval as R
from ..registry import register
from ..sources.adapters import having, logits, passages, queries, sources, table
from ..sources.keyed import among
from ..sources.store import stored, written
from .retrieval import EXPECTED, SELECTED, candidates, expected, own_sources

ALL = SELECTED
EVIDENCE = """ev AS (SELECT pick.query_id, pick.query_year, position, 'E' || position AS evidence_id, pick.chunk_id, p.text, pick.doc_id, s.case_id, s.court, s.decision_year, p.page FROM pick JOIN passages p ON p.chunk_id = pick.chunk_id JOIN sources s ON s.doc_id = pick.doc_id)"""


def _corpus(spark, sf_dir, cited):
    """Passages with their source's metadata, where their chunk_id may be one of ``cited``: texts that nothing cites are not moved."""
    s = sources(spark, sf_dir).select("doc_id", "case_id", "court", F.col("decision_year").alias("year"))
    p = among(passages(spark, sf_dir).select("doc_id", "chunk_id", "page", "text"), "chunk_id", cited)
    return p.join(s, "doc_id").withColumnRenamed("year", "decision_year")


def _run(spark, sf_dir):
    """(candidates, evidence with passages and metadata): the stored run of salient terms without the query's own judgment, and what is selected of it."""
    pre = candidates(spark, sf_dir)
    pick = R.diverse(pre).select("query_id", "query_year", "position", "chunk_id", "status")

    def build():
        kept = written(pick, "picked")
        return kept.join(_corpus(spark, sf_dir, kept), "chunk_id")

    return pre, stored(spark, sf_dir, "evidence", build)


LEVEL = "CASE WHEN count(ev.query_id) = 0 THEN 'insufficient' WHEN count(ev.query_id) = 1 THEN 'limited' ELSE 'multiple_selected_passages' END"


@register("v01_grounded_answers", ALL + f", {EVIDENCE} SELECT q.query_id, {LEVEL} AS evidence_sufficiency, coalesce(string_agg(evidence_id || '=' || chunk_id, ',' ORDER BY position), '') AS ids, sha256(coalesce(string_agg(ev.text, chr(1) ORDER BY position), '')) AS passages, CASE {LEVEL} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in V.CONCLUSIONS.items())} END AS conclusion FROM queries q LEFT JOIN ev ON ev.query_id = q.query_id GROUP BY q.query_id")
def v01_grounded_answers(spark, sf_dir):
    _, ev = _run(spark, sf_dir)
    a = V.render(queries(spark, sf_dir), ev.drop("status", "query_year"))
    each = lambda f: F.transform("evidence", f)
    ids = F.array_join(each(lambda e: F.concat(e["evidence_id"], F.lit("="), e["chunk_id"])), ",")
    return a.select("query_id", "evidence_sufficiency", ids.alias("ids"), F.sha2(F.array_join(each(lambda e: e["text"]), "\x01"), 256).alias("passages"), "conclusion")


TEXTS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CONCLUSIONS.items())
DOUBT = f"'{V.UNCERTAINTY}' || CASE {LEVEL} WHEN 'insufficient' THEN ' {V.NO_EVIDENCE}' WHEN 'limited' THEN ' {V.LIMITED_EVIDENCE}' ELSE '' END"
LAW = "{'evidence_id': evidence_id, 'case_id': case_id, 'decision_year': decision_year, 'court': court}"
ITEM = "{'position': position, 'evidence_id': evidence_id, 'chunk_id': chunk_id, 'doc_id': ev.doc_id, 'page': page, 'text': ev.text, 'case_id': case_id, 'court': court, 'decision_year': decision_year}"
NESTED = f"""to_json({{'answer_version': '{V.ANSWER_VERSION}', 'explanation_order': {list(V.SECTIONS)}, 'legal_issue': {{'text': trim(any_value(query_text), ' '), 'source': 'user_query'}}, 'applicable_law_and_cases': coalesce(list({LAW} ORDER BY position) FILTER (WHERE position IS NOT NULL), []),
 'supporting_evidence': coalesce(list({ITEM} ORDER BY position) FILTER (WHERE position IS NOT NULL), []), 'conclusion': {{'text': CASE {LEVEL} {TEXTS} END, 'mode': '{V.MODE}', 'evidence_ids': coalesce(list(evidence_id ORDER BY position) FILTER (WHERE position IS NOT NULL), [])}}, 'evidence_sufficiency': {LEVEL}, 'uncertainty': {DOUBT}}})::VARCHAR"""


@register("v01_answer_json", ALL + f", {EVIDENCE} SELECT q.query_id, {NESTED} AS answer FROM queries q LEFT JOIN ev ON ev.query_id = q.query_id GROUP BY q.query_id")
def v01_answer_json(spark, sf_dir):
    _, ev = _run(spark, sf_dir)
    return V.as_json(V.render(queries(spark, sf_dir), ev.drop("status", "query_year")))


@register("v02_render_guards", having("queries") + " SELECT query_id, 'blank_query' AS violation FROM queries WHERE trim(query_text) = ''")
def v02_render_guards(spark, sf_dir):
    return V.guards(queries(spark, sf_dir), _run(spark, sf_dir)[1])


# Answers are tampered with by position, so that every failure path runs.
def _tamper(some: str) -> str:
    return f"shown AS (SELECT query_id, query_year, position, evidence_id, CASE WHEN position = 4 AND {some} THEN chunk_id || '-gone' ELSE chunk_id END AS chunk_id, CASE WHEN position = 2 AND {some} THEN text || ' altered' ELSE text END AS text, doc_id, case_id, CASE WHEN position = 3 AND {some} THEN 'other' ELSE court END AS court, decision_year, page FROM ev)"


TAMPER = _tamper("true")


def tampered(ev, some=None):
    at = F.when(F.lit(True) if some is None else some, F.col("position"))
    return ev.withColumn("chunk_id", F.when(at == 4, F.concat("chunk_id", F.lit("-gone"))).otherwise(F.col("chunk_id"))).withColumn("text", F.when(at == 2, F.concat("text", F.lit(" altered"))).otherwise(F.col("text"))).withColumn("court", F.when(at == 3, "other").otherwise(F.col("court")))


def checked(some_of_s: str, some: str) -> str:
    """Shown citations, tampered with where ``some``, and the failures of each."""
    return f"""{_tamper(some)},
 corpus AS (SELECT p.chunk_id, p.text, p.doc_id, s.case_id, s.court, s.decision_year, p.page FROM passages p JOIN sources s ON s.doc_id = p.doc_id),
 chk AS (SELECT s.query_id, s.evidence_id, s.chunk_id, list_filter(list_concat(CASE WHEN c.chunk_id IS NULL THEN ['corpus_chunk_missing'] ELSE [CASE WHEN s.court IS DISTINCT FROM c.court THEN 'corpus_metadata_mismatch:court' END, CASE WHEN s.text IS DISTINCT FROM c.text THEN 'passage_mismatch' END, CASE WHEN (s.case_id || CASE WHEN position = 5 AND {some_of_s} THEN 'x' ELSE '' END) IS DISTINCT FROM c.case_id THEN 'authority_metadata_mismatch:case_id' END, CASE WHEN s.court IS DISTINCT FROM c.court THEN 'authority_metadata_mismatch:court' END, CASE WHEN dup.doc_id IS NOT NULL THEN 'query_duplicate_source' END, CASE WHEN c.decision_year = s.query_year THEN 'temporal_same_year_unresolved' WHEN c.decision_year > s.query_year THEN 'temporal_ineligible' END] END, [CASE WHEN kept.chunk_id IS NULL THEN 'not_retrieved_for_query' END]), lambda x: x IS NOT NULL) AS f
  FROM shown s LEFT JOIN corpus c ON c.chunk_id = s.chunk_id LEFT JOIN dup ON dup.query_id = s.query_id AND dup.doc_id = c.doc_id LEFT JOIN kept ON kept.query_id = s.query_id AND kept.chunk_id = s.chunk_id)"""


@register("v03_grounding_audit", ALL + f", {EVIDENCE}, {TAMPER}, j AS (SELECT s.query_id, s.chunk_id, e.chunk_id IS NULL AS unknown, s.text IS DISTINCT FROM e.text AS t, s.court IS DISTINCT FROM e.court AS c FROM shown s LEFT JOIN ev e ON e.query_id = s.query_id AND e.chunk_id = s.chunk_id) SELECT query_id, chunk_id, 'unknown_chunk' AS reason FROM j WHERE unknown UNION ALL SELECT query_id, chunk_id, 'altered_passage' FROM j WHERE NOT unknown AND t UNION ALL SELECT query_id, chunk_id, 'altered_court' FROM j WHERE NOT unknown AND c")
def v03_grounding_audit(spark, sf_dir):
    ev = _run(spark, sf_dir)[1]
    return V.audit(tampered(ev), ev)


@register("v04_citation_checks", ALL + f", {EVIDENCE}, {checked('true', 'true')} SELECT query_id, evidence_id, chunk_id, array_to_string(f, ',') AS failures, len(f) = 0 AS passed FROM chk")
def v04_citation_checks(spark, sf_dir):
    pre, ev = _run(spark, sf_dir)
    c = tampered(ev).withColumn("evidence_id", F.concat(F.lit("E"), "position"))
    for name in V.AUTHORITY:
        c = c.withColumn(f"law_{name}", F.col(name))
    c = c.withColumn("law_case_id", F.when(F.col("position") == 5, F.concat("case_id", F.lit("x"))).otherwise(F.col("case_id")))
    done = V.verify(c, _corpus(spark, sf_dir, c), pre, own_sources(spark, sf_dir))
    return done.select("query_id", "evidence_id", "chunk_id", F.array_join("failures", ",").alias("failures"), "passed")


KEY = f"""{EXPECTED},
 judged AS (SELECT e.query_id, e.doc_id, rank, CASE WHEN pk.doc_id IS NOT NULL THEN 'retrieved_and_selected' WHEN rank IS NOT NULL THEN 'retrieved_not_selected' ELSE 'absent' END AS bucket FROM expected e LEFT JOIN (SELECT query_id, doc_id, min(rank) AS rank FROM kept GROUP BY ALL) r ON r.query_id = e.query_id AND r.doc_id = e.doc_id LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM pick) pk ON pk.query_id = e.query_id AND pk.doc_id = e.doc_id)"""


def _judged(spark, sf_dir):
    pre, ev = _run(spark, sf_dir)
    return V.judge(expected(spark, sf_dir), pre, ev), ev


@register("a15_retrieval_metrics", ALL + f""", {KEY}, n AS (SELECT count(*) AS cases, sum((rank <= 5)::INT) AS at5, sum((rank IS NOT NULL)::INT) AS atk, sum((bucket = 'retrieved_and_selected')::INT) AS hit FROM judged), m AS (SELECT count(*) AS shown FROM pick WHERE query_id IN (SELECT query_id FROM judged))
 SELECT cases, CASE WHEN cases > 0 THEN round(coalesce(at5, 0) / cases, 6) END AS recall_5, CASE WHEN cases > 0 THEN round(coalesce(atk, 0) / cases, 6) END AS recall_k, CASE WHEN shown > 0 THEN round(coalesce(hit, 0) / shown, 6) END AS precision, CASE WHEN cases > 0 THEN round(coalesce(hit, 0) / cases, 6) END AS recall FROM n, m""")
def a15_retrieval_metrics(spark, sf_dir):
    judged, ev = _judged(spark, sf_dir)
    some = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    n = judged.agg(F.count("*").alias("cases"), some(F.col("rank") <= 5).alias("at5"), some(F.col("rank").isNotNull()).alias("atk"), some(F.col("bucket") == "retrieved_and_selected").alias("hit"))
    m = ev.join(judged.select("query_id"), "query_id", "left_semi").agg(F.count("*").alias("shown"))
    both = n.withColumn("shown", m.scalar())
    c = F.col
    return both.select("cases", M.ratio(c("at5"), c("cases")).alias("recall_5"), M.ratio(c("atk"), c("cases")).alias("recall_k"), M.ratio(c("hit"), c("shown")).alias("precision"), M.ratio(c("hit"), c("cases")).alias("recall"))


@register("a19_error_buckets", ALL + f", {KEY} SELECT bucket, count(*) AS n, min(rank) AS best FROM judged GROUP BY bucket")
def a19_error_buckets(spark, sf_dir):
    return _judged(spark, sf_dir)[0].groupBy("bucket").agg(F.count("*").alias("n"), F.min("rank").alias("best"))


@register("r12_without_self_matches", ALL + f" SELECT query_id, doc_id, rank, chunk_id, position FROM pick")
def r12_without_self_matches(spark, sf_dir):
    """Diverse selection of CONFIG.selected sources from the run without the query's own judgment."""
    return R.diverse(candidates(spark, sf_dir)).select("query_id", "doc_id", "rank", "chunk_id", "position")


# --- predictions -------------------------------------------------------------

MEAN = "mean AS (SELECT document, label, round(avg(l0), 6) AS m0, round(avg(l1), 6) AS m1, (round(avg(l1), 6) > round(avg(l0), 6))::INT AS guess FROM logits GROUP BY document, label)"
VOTE = "vote AS (SELECT document, label, votes, g AS guess FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY votes DESC, g) AS k FROM (SELECT document, label, (l1 > l0)::INT AS g, count(*) AS votes FROM logits GROUP BY ALL)) WHERE k = 1)"
CONFUSION = "SELECT n00, n01, n10, n11, n, round((n00 + n11) / n, 6) AS accuracy, round((CASE WHEN 2 * n00 + n01 + n10 > 0 THEN 2 * n00 / (2 * n00 + n01 + n10) ELSE 0 END + CASE WHEN 2 * n11 + n01 + n10 > 0 THEN 2 * n11 / (2 * n11 + n01 + n10) ELSE 0 END) / 2, 6) AS macro_f1 FROM (SELECT {}, count(*) AS n FROM {{}})".format(", ".join(f"sum((label = {t} AND guess = {g})::INT)::BIGINT AS n{t}{g}" for t in (0, 1) for g in (0, 1)))


@register("a13_mean_logit_pool", having("logits") + f", {MEAN} SELECT * FROM mean")
def a13_mean_logit_pool(spark, sf_dir):
    return M.mean_pool(logits(spark, sf_dir))


@register("a14_vote_pool", having("logits") + f", {VOTE} SELECT * FROM vote")
def a14_vote_pool(spark, sf_dir):
    return M.vote_pool(logits(spark, sf_dir))


@register("a11_confusion_mean", having("logits") + f", {MEAN} {CONFUSION.format('mean')}")
def a11_confusion_mean(spark, sf_dir):
    return M.confusion(M.mean_pool(logits(spark, sf_dir)), "label", "guess")


@register("a11_confusion_vote", having("logits") + f", {VOTE} {CONFUSION.format('vote')}")
def a11_confusion_vote(spark, sf_dir):
    return M.confusion(M.vote_pool(logits(spark, sf_dir)), "label", "guess")


@register("a18_agreement", having("logits") + f", {MEAN}, {VOTE} SELECT CASE WHEN a AND b THEN 'both_correct' WHEN a THEN 'first_correct' WHEN b THEN 'second_correct' ELSE 'both_wrong' END AS bucket, count(*) AS n, min(document) AS example FROM (SELECT mean.document, mean.guess = mean.label AS a, vote.guess = vote.label AS b FROM mean JOIN vote ON mean.document = vote.document) GROUP BY bucket")
def a18_agreement(spark, sf_dir):
    l = logits(spark, sf_dir)
    both = M.mean_pool(l).select("document", (F.col("guess") == F.col("label")).alias("a")).join(M.vote_pool(l).select("document", (F.col("guess") == F.col("label")).alias("b")), "document")
    bucket = F.when(F.col("a") & F.col("b"), "both_correct").when(F.col("a"), "first_correct").when(F.col("b"), "second_correct").otherwise("both_wrong")
    return both.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("document").alias("example"))


@register("j15_checked_predictions", having("logits") + f", {MEAN}, {VOTE} SELECT count(*) AS n, sum((mean.document IS NULL OR vote.document IS NULL)::INT)::BIGINT AS unmatched, sum((mean.label IS DISTINCT FROM vote.label)::INT)::BIGINT AS disagree FROM mean FULL JOIN vote ON mean.document = vote.document")
def j15_checked_predictions(spark, sf_dir):
    l = logits(spark, sf_dir)
    a, b = M.mean_pool(l).select("document", F.col("label").alias("x")), M.vote_pool(l).select("document", F.col("label").alias("y"))
    return a.join(b, "document", "full").agg(F.count("*").alias("n"), F.sum((F.col("x").isNull() | F.col("y").isNull()).cast("long")).alias("unmatched"), F.sum((~F.col("x").eqNullSafe(F.col("y"))).cast("long")).alias("disagree"))


@register("a12_majority_class", "SELECT quality AS label, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality) ORDER BY n DESC, label LIMIT 1")
def a12_majority_class(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("label")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6)).orderBy(F.desc("n"), "label").limit(1)


TOKENS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"


@register("w08_token_windows", f"SELECT doc_id, start::INT AS start, least(start + {CONFIG.window}, n)::INT AS stop FROM (SELECT doc_id, n, unnest(CASE WHEN n <= {CONFIG.window} THEN [0] ELSE list_distinct(list_append(range(0, n - {CONFIG.window} + 1, {CONFIG.window - CONFIG.overlap}), n - {CONFIG.window})) END) AS start FROM (SELECT doc_id, {TOKENS} AS n FROM documents))")
def w08_token_windows(spark, sf_dir):
    from ..functions import text as T

    n = table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).alias("n"))
    w = n.select("doc_id", "n", F.explode(M.window_starts(F.col("n"), CONFIG.window, CONFIG.overlap)).alias("start"))
    return w.select("doc_id", "start", F.least(F.col("start") + CONFIG.window, "n").alias("stop"))


@register("m09_token_lengths", f"SELECT lang, count(*) AS n, {', '.join(f'round(quantile_cont(k, {p / 100}), 6) AS p{p}' for p in (10, 50, 90, 99))}, round(avg((k > 512)::INT), 6) AS over_512 FROM (SELECT lang, {TOKENS} AS k FROM documents) GROUP BY lang")
def m09_token_lengths(spark, sf_dir):
    from ..functions import text as T

    k = F.size(T.words(F.col("text")))
    d = table(spark, sf_dir, "documents").select("lang", k.alias("k"))
    p = M.percentiles(d, ["lang"], "k", {f"p{p}": p / 100 for p in (10, 50, 90, 99)}).drop("n").withColumnRenamed("lang", "_lang")
    counts = d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("k") > 512).cast("int")), 6).alias("over_512"))
    return counts.join(p, F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", "n", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (10, 50, 90, 99)], "over_512")


@register("m10_history_audit", """WITH h AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, count(*) OVER (PARTITION BY user_id) AS n, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
 SELECT user_id, count(*) AS epochs, arg_min(epoch, (-value, epoch)) AS best_epoch, round(max(value), 6) AS best, round(max(CASE WHEN epoch = n THEN value END), 6) AS last, arg_min(epoch, (-value, epoch)) = max(n) AS best_is_last, sum((value < before)::INT)::BIGINT AS declines FROM h GROUP BY user_id""")
def m10_history_audit(spark, sf_dir):
    """Histories of a value by epoch: the first best epoch, the last value, and how often it declined."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    h = table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(w).cast("long").alias("epoch"), F.lag("value").over(w).alias("before"))
    best = F.min_by("epoch", F.struct(-F.col("value"), "epoch"))
    out = h.groupBy("user_id").agg(F.count("*").alias("epochs"), best.alias("best_epoch"), F.round(F.max("value"), 6).alias("best"), F.round(F.max_by("value", "epoch"), 6).alias("last"), F.sum((F.col("value") < F.col("before")).cast("long")).alias("declines"))
    return out.withColumn("best_is_last", F.col("best_epoch") == F.col("epochs"))


@register("m10_best_epoch", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS best, round(max(value), 6) AS top FROM events GROUP BY user_id")
def m10_best_epoch(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"), F.round(F.max("value"), 6).alias("top"))
