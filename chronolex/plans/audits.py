"""Admission gates, freezes, spot checks and the smaller inventory rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import temporal
from ..functions import text as T
from ..operators import alignment as A
from ..operators import answers as V
from ..registry import register
from ..sources.adapters import cases, fold, having, logits, passages, queries, sources, table
from .alignment import SHARED, STATUS, identity, shared_phrases
from .evaluation import ALL, EVIDENCE, KEY, _judged, _run, tampered
from .retrieval import BASE, POST, PRE, retrieved

LEGAL = r"\b(section|sections|article|articles)\s+(\d+[a-z]*)"


@register("p14_sentence_backup", f"SELECT doc_id, length(regexp_extract(substring(text, 1, cap), '(?s)^.*[.!?](?:[\"'')\\]”’]+)?\\s*', 0))::INT AS last_end FROM (SELECT doc_id, text, round(length(text) * {CONFIG.retained})::INT AS cap FROM documents)")
def p14_sentence_backup(spark, sf_dir):
    from ..operators.facts import SENTENCE_END

    cut = F.expr(f"substring(text, 1, int(round(char_length(text) * {CONFIG.retained})))")
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length(F.regexp_extract(cut, SENTENCE_END, 0)).alias("last_end"))


@register("p28_status_filter", having("cases") + " SELECT id, label FROM cases WHERE split = 'test' AND label = 1")
def p28_status_filter(spark, sf_dir):
    return cases(spark, sf_dir).filter("split = 'test' and label = 1").select("id", "label")


@register("p29_eligible_top5", BASE + f", {POST} SELECT query_id, rank, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM late WHERE status = 'eligible') WHERE k <= 5")
def p29_eligible_top5(spark, sf_dir):
    late = retrieved(spark, sf_dir, before=False).filter("status = 'eligible'")
    k = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return late.withColumn("k", k).filter("k <= 5").select("query_id", "rank", "chunk_id")


@register("p30_source_status", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'native-text' WHEN l.quality = 1 THEN 'OCR-repaired' ELSE 'excluded_low_quality' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def p30_source_status(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    kind = F.when(F.col("quality").isNull(), "native-text").when(F.col("quality") == 1, "OCR-repaired").otherwise("excluded_low_quality")
    return table(spark, sf_dir, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", kind.alias("status"))


@register("p32_stable_rows", "SELECT event_id, sha256(event_type || '|' || user_id || '|' || props) AS h FROM events")
def p32_stable_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat_ws("|", "event_type", "user_id", "props"), 256).alias("h"))


@register("a03_runs_by_status", BASE + f", {POST} SELECT status, count(*) AS n FROM late GROUP BY status")
def a03_runs_by_status(spark, sf_dir):
    return retrieved(spark, sf_dir, before=False).groupBy("status").agg(F.count("*").alias("n"))


@register("a26_rank_range", BASE + f", {PRE} SELECT query_id, min(rank) AS best, max(rank) AS worst, count(DISTINCT doc_id) AS sources FROM pre GROUP BY query_id")
def a26_rank_range(spark, sf_dir):
    return retrieved(spark, sf_dir).groupBy("query_id").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"), F.countDistinct("doc_id").alias("sources"))


@register("j04_hydrated_candidates", BASE + f", {PRE}, sources AS (SELECT doc_id, source AS court FROM documents) SELECT query_id, rank, chunk_id, court, page FROM pre JOIN passages USING (chunk_id) JOIN sources ON sources.doc_id = pre.doc_id")
def j04_hydrated_candidates(spark, sf_dir):
    pre = retrieved(spark, sf_dir).select("query_id", "rank", "chunk_id", "doc_id")
    p = passages(spark, sf_dir).select("chunk_id", F.col("page").cast("long").alias("page"))
    return pre.join(p, "chunk_id").join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("court")), "doc_id").select("query_id", "rank", "chunk_id", "court", "page")


@register("j07_first_dates", f"SELECT c.c_custkey, {STATUS.format('1995', 'year(o.d)')} AS status FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey")
def j07_first_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.year(F.min("o_orderdate")).alias("y"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", temporal.status(F.lit(1995), F.col("y")).alias("status"))


@register("j10_audited_exclusion", BASE + f", {PRE} SELECT query_id, rank, chunk_id FROM pre WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def j10_audited_exclusion(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    return retrieved(spark, sf_dir).join(bad, "doc_id", "left_anti").select("query_id", "rank", "chunk_id")


@register("u01_bag_union", "SELECT key, count(*) AS n FROM (SELECT o_custkey AS key FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY key")
def u01_bag_union(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return a.unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))).groupBy("key").agg(F.count("*").alias("n"))


@register("u05_token_sets", f"SELECT d.doc_id, len(list_intersect({identity('d.text')}, x.w)) AS shared, len({identity('d.text')}) - len(list_intersect({identity('d.text')}, x.w)) AS own FROM documents d, (SELECT list(DISTINCT t) AS w FROM (SELECT unnest({identity('text')}) AS t FROM benchmark)) x")
def u05_token_sets(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.explode(T.identity_tokens(F.col("text"))).alias("t")).distinct().withColumn("b", F.lit(1))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(T.identity_tokens(F.col("text"))).alias("t"))
    met = d.join(b, "t", "left").groupBy("doc_id").agg(F.count("b").alias("shared"), F.count("t").alias("all"))
    return met.select("doc_id", "shared", (F.col("all") - F.col("shared")).alias("own"))


@register("r04_legal_references", f"SELECT doc_id, len(regexp_extract_all({fold('text')}, '{LEGAL}', 2))::INT AS n FROM documents")
def r04_legal_references(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all(T.casefold(F.col("text")), F.lit(LEGAL), F.lit(2))).alias("n"))


@register("o02_multi_key_sort", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem ORDER BY place LIMIT 100")
def o02_multi_key_sort(spark, sf_dir):
    # the top 100 are found before they are numbered, so only they meet in one task
    top = table(spark, sf_dir, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)
    place = F.row_number().over(Window.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return top.select("l_orderkey", "l_linenumber", place.cast("long").alias("place"))


@register("d09_answer_key_audit", having("sources", "queries") + f", {SHARED} SELECT query_id, s.doc_id, shared >= {CONFIG.shared_phrases} AS accepted, len(list_intersect({identity('title')}, {identity('query_text')})) AS terms FROM shared JOIN sources s ON s.doc_id = shared.doc_id JOIN queries USING (query_id) WHERE s.doc_id <> query_id")
def d09_answer_key_audit(spark, sf_dir):
    p = shared_phrases(spark, sf_dir, titles=True).filter("doc_id <> query_id")
    return p.select("query_id", "doc_id", (F.col("shared") >= CONFIG.shared_phrases).alias("accepted"), F.col("shared_terms").alias("terms"))


@register("d10_freeze_sanity", having("cases") + " SELECT count(*) AS n, count(DISTINCT id) = count(*) AS distinct_ids, sum((split = 'test')::INT)::BIGINT AS in_test, sum((query_year BETWEEN 1958 AND 1993)::INT)::BIGINT AS in_span FROM cases")
def d10_freeze_sanity(spark, sf_dir):
    c = cases(spark, sf_dir)
    return c.agg(F.count("*").alias("n"), (F.countDistinct("id") == F.count("*")).alias("distinct_ids"), F.sum((F.col("split") == "test").cast("long")).alias("in_test"), F.sum(F.col("query_year").between(1958, 1993).cast("long")).alias("in_span"))


@register("v06_failed_counts", ALL + f", {EVIDENCE} SELECT query_id, count(*) AS shown, sum((position IN (2, 3, 4))::INT)::BIGINT AS altered FROM ev GROUP BY query_id")
def v06_failed_counts(spark, sf_dir):
    """A stored batch with altered answers: every altered item is found by the audit, and no other."""
    _, ev = _run(spark, sf_dir)
    found = V.audit(tampered(ev), ev).groupBy("query_id").agg(F.countDistinct("chunk_id").alias("altered"))
    return ev.groupBy("query_id").agg(F.count("*").alias("shown")).join(found, "query_id", "left").select("query_id", "shown", F.coalesce("altered", F.lit(0)).cast("long").alias("altered"))


@register("m05_windows_per_case", f"SELECT document, count(*) AS windows, round(min(l0), 6) AS low, round(max(l0), 6) AS high FROM ({having('logits')} SELECT * FROM logits) GROUP BY document")
def m05_windows_per_case(spark, sf_dir):
    return logits(spark, sf_dir).groupBy("document").agg(F.count("*").alias("windows"), F.round(F.min("l0"), 6).alias("low"), F.round(F.max("l0"), 6).alias("high"))


@register("a19_bucket_sources", ALL + f", {KEY} SELECT bucket, min(rank) AS best, count(*) AS n, count(DISTINCT doc_id) AS sources FROM judged GROUP BY bucket")
def a19_bucket_sources(spark, sf_dir):
    return _judged(spark, sf_dir)[0].groupBy("bucket").agg(F.min("rank").alias("best"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("sources"))
