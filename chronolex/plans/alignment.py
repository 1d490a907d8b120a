"""Time rule, alignment, deduplication and joins of the two corpora."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import CONFIG, IDENTITY_STOP_WORDS
from ..functions import temporal
from ..functions import text as T
from ..operators import alignment as A
from ..operators import crossing
from ..registry import register
from ..sources.adapters import cases, fold, having, queries, sources, table
from ..sources.store import stored

STOPS = ", ".join(f"'{w}'" for w in IDENTITY_STOP_WORDS)
PHRASE = "regexp_extract_all({0}, '[a-z]{{3,}}')"


def phrase_tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[a-z]{{3,}}')"


def identity(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all({fold(x)}, '[a-z][a-z0-9]{{2,}}')), lambda t: t NOT IN ({STOPS}))"


def shingle(tokens: str, n: int = CONFIG.shingle) -> str:
    return f"list_transform(range(1, greatest(len({tokens}) - {n - 2}, 1)), lambda i: array_to_string(list_slice({tokens}, i, i + {n - 1}), ' '))"


STATUS = "CASE WHEN {0} IS NULL OR {1} IS NULL THEN 'missing_temporal_metadata' WHEN {1} < {0} THEN 'eligible' WHEN {1} = {0} THEN 'same_year_unresolved' ELSE 'ineligible' END"
SHARED = f"""qp AS (SELECT DISTINCT query_id, unnest({shingle('t')}) AS phrase FROM (SELECT query_id, {phrase_tokens('query_text')} AS t FROM queries)),
 st AS (SELECT doc_id, {phrase_tokens('text')} AS t FROM sources),
 sp AS (SELECT doc_id, phrase, count(*) AS n, min(pos) AS first FROM (SELECT doc_id, unnest({shingle('t')}) AS phrase, unnest(range(0, len({shingle('t')}))) AS pos FROM st) GROUP BY doc_id, phrase),
 total AS (SELECT doc_id, count(*) AS total FROM sp GROUP BY doc_id),
 shared AS (SELECT query_id, sp.doc_id, sum(n)::BIGINT AS shared, count(*) AS distinct_shared, any_value(total) AS total, arg_min(sp.phrase, first) AS example FROM qp JOIN sp ON qp.phrase = sp.phrase JOIN total ON total.doc_id = sp.doc_id GROUP BY query_id, sp.doc_id)"""
BASE = having("sources", "queries") + f", {SHARED}"


def shared_phrases(spark, sf_dir, **more):
    """Pairs of a query and a source with the phrases that they share. They grow with the square of the corpus, so they are made where they are read and not stored."""
    return crossing.shared_phrases(queries(spark, sf_dir), sources(spark, sf_dir), **more)


def own_sources(spark, sf_dir):
    """The stored pairs (query_id, doc_id) of a query and a source that is the query's own judgment."""
    return stored(spark, sf_dir, "own-sources", lambda: crossing.contained(queries(spark, sf_dir), sources(spark, sf_dir), CONFIG.shared_phrases, CONFIG.phrase_coverage).select("query_id", "doc_id"))


GUARD = f"shared >= {CONFIG.shared_phrases} AND distinct_shared / total >= {CONFIG.phrase_coverage}"


@register("p19_temporal_eligibility", having("sources", "queries") + f" SELECT query_id, {STATUS.format('query_year', 'decision_year')} AS status, count(*) AS n FROM queries, sources GROUP BY ALL")
def p19_temporal_eligibility(spark, sf_dir):
    # the status depends on years alone: sources are counted by year, running sums tell what is earlier, queries join on their year
    s, q = sources(spark, sf_dir), queries(spark, sf_dir)
    dated = s.filter("decision_year is not null").groupBy(F.col("decision_year").alias("y")).agg(F.count("*").alias("n"))
    years = dated.unionByName(q.select(F.col("query_year").alias("y"), F.lit(0).cast("long").alias("n"))).groupBy("y").agg(F.sum("n").alias("n"))
    run = Window.orderBy("y")  # one row per year
    counted = years.select("y", F.coalesce(F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("eligible"), F.col("n").alias("same_year_unresolved"), F.coalesce(F.sum("n").over(run.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("ineligible"))
    missing = s.agg(F.sum(F.col("decision_year").isNull().cast("long"))).scalar()
    wide = q.join(counted, F.col("query_year") == F.col("y")).withColumn("missing_temporal_metadata", missing)
    return wide.unpivot(["query_id"], list(temporal.STATUSES), "status", "n").filter("n > 0")


@register("p27_years_of_text", "SELECT d, CASE WHEN regexp_matches(trim(d), '^\\d{4}') THEN substring(trim(d), 1, 4)::INT ELSE TRY_CAST(nullif(regexp_extract(trim(d), '^\\d{1,2}[-/]\\d{1,2}[-/](\\d{4})$', 1), '') AS INT) END AS y, count(*) AS n FROM (SELECT strftime(o_orderdate, '%d-%m-%Y') AS d FROM orders UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders) GROUP BY d")
def p27_years_of_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = o.select(F.date_format("o_orderdate", "dd-MM-yyyy").alias("d")).unionByName(o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")))
    return d.groupBy("d").agg(F.count("*").alias("n")).select("d", temporal.year_of_text(F.col("d")).alias("y"), "n")


@register("a04_status_counts", having("sources") + f" SELECT court, {', '.join(f'sum((status = {chr(39)}{s}{chr(39)})::INT)::BIGINT AS {s}' for s in temporal.STATUSES)} FROM (SELECT court, {STATUS.format('1990', 'decision_year')} AS status FROM sources) GROUP BY court")
def a04_status_counts(spark, sf_dir):
    s = sources(spark, sf_dir).select("court", temporal.status(F.lit(1990), F.col("decision_year")).alias("status"))
    return s.groupBy("court").agg(*[F.sum((F.col("status") == x).cast("long")).alias(x) for x in temporal.STATUSES])


@register("j01_strictly_earlier_orders", "SELECT a.o_orderkey, count(b.o_orderkey) AS earlier FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND year(b.o_orderdate) < year(a.o_orderdate) GROUP BY a.o_orderkey")
def j01_strictly_earlier_orders(spark, sf_dir):
    # the inequality join as a window over years: no pair is formed
    w = Window.partitionBy("o_custkey").orderBy("y").rangeBetween(Window.unboundedPreceding, -1)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    return o.select("o_orderkey", F.count("*").over(w).alias("earlier"))


@register("d01_identity_tokens", f"SELECT doc_id, array_to_string(list_sort({identity('text')}), ' ') AS tokens FROM documents")
def d01_identity_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.identity_tokens(F.col("text"))), " ").alias("tokens"))


@register("d02_shingles", f"SELECT doc_id, unnest(range(0, len({shingle('t')})))::INT AS pos, unnest({shingle('t')}) AS phrase FROM (SELECT doc_id, {phrase_tokens('text')} AS t FROM documents)")
def d02_shingles(spark, sf_dir):
    return A.shingles(table(spark, sf_dir, "documents"), "doc_id")


@register("d03_shared_phrases", BASE + " SELECT query_id, doc_id, shared, least(shared, 100)::BIGINT AS capped, example FROM shared")
def d03_shared_phrases(spark, sf_dir):
    p = shared_phrases(spark, sf_dir, example=True)
    return p.select("query_id", "doc_id", "shared", F.least("shared", F.lit(CONFIG.shared_phrases)).cast("long").alias("capped"), "example")


@register("j11_phrase_coverage", BASE + " SELECT query_id, doc_id, round(distinct_shared / total, 6) AS coverage FROM shared")
def j11_phrase_coverage(spark, sf_dir):
    return shared_phrases(spark, sf_dir).select("query_id", "doc_id", F.round(F.col("distinct_shared") / F.col("total"), 6).alias("coverage"))


@register("r09_self_matches", BASE + f" SELECT query_id, doc_id FROM shared WHERE {GUARD}")
def r09_self_matches(spark, sf_dir):
    return own_sources(spark, sf_dir)


@register("r10_excluded_counts", BASE + f" SELECT query_id, sum(({GUARD})::INT)::BIGINT AS excluded, count(*) AS n FROM shared GROUP BY query_id")
def r10_excluded_counts(spark, sf_dir):
    p = shared_phrases(spark, sf_dir)
    bad = (F.col("shared") >= CONFIG.shared_phrases) & (F.col("distinct_shared") / F.col("total") >= CONFIG.phrase_coverage)
    return p.groupBy("query_id").agg(F.sum(bad.cast("long")).alias("excluded"), F.count("*").alias("n"))


@register("d05_alignment_gate", BASE + f", gate AS (SELECT query_id, s.doc_id, shared, len(list_intersect({identity('title')}, {identity('query_text')})) AS terms, len({identity('title')}) AS own FROM shared JOIN sources s ON s.doc_id = shared.doc_id JOIN queries USING (query_id)) SELECT query_id, doc_id, shared >= {CONFIG.shared_phrases} AS content, terms >= {CONFIG.shared_terms} AND terms / own >= {CONFIG.identity_coverage} AS title, shared >= {CONFIG.shared_phrases} AND terms >= {CONFIG.shared_terms} AND terms / own >= {CONFIG.identity_coverage} AS passed FROM gate")
def d05_alignment_gate(spark, sf_dir):
    g = A.passed(shared_phrases(spark, sf_dir, titles=True))
    content = F.col("shared") >= CONFIG.shared_phrases
    return g.select("query_id", "doc_id", content.alias("content"), F.col("passed").alias("title"), (content & F.col("passed")).alias("passed"))


BLOCK = f"""own AS (SELECT DISTINCT doc_id, decision_year, unnest({identity('title')}) AS token FROM sources), rare AS (SELECT token FROM own GROUP BY token HAVING count(*) <= {CONFIG.rare_token}),
 txt AS (SELECT id, query_year, unnest({identity('text')}) AS token FROM cases),
 pair AS (SELECT DISTINCT txt.id, own.doc_id FROM txt JOIN own ON txt.query_year = own.decision_year AND txt.token = own.token WHERE own.token IN (SELECT token FROM rare)),
 found AS (SELECT pair.id, pair.doc_id, count(*) AS shared FROM pair JOIN own ON own.doc_id = pair.doc_id JOIN txt ON txt.id = pair.id AND txt.token = own.token GROUP BY ALL),
 near AS (SELECT id, found.doc_id, shared, round(shared / terms, 3) AS score FROM found JOIN (SELECT doc_id, count(*) AS terms FROM own WHERE decision_year IS NOT NULL GROUP BY doc_id) z ON z.doc_id = found.doc_id WHERE shared >= {CONFIG.shared_terms} AND shared / terms >= {CONFIG.identity_coverage})"""
SYNTACTIC = r"syn AS (SELECT c.id, s.doc_id FROM cases c JOIN sources s ON c.id = regexp_extract(s.case_id, '^(\d{4}) INSC (\d+)$', 1) || '_' || regexp_extract(s.case_id, '^(\d{4}) INSC (\d+)$', 2))"


def near_matches(spark, sf_dir):
    """The stored pairs of case and source whose titles agree."""
    return stored(spark, sf_dir, "near-matches", lambda: A.blocked_matches(cases(spark, sf_dir), sources(spark, sf_dir)))


@register("j06_blocked_title_match", having("sources", "cases") + f", {BLOCK} SELECT id, doc_id, shared, score FROM near")
def j06_blocked_title_match(spark, sf_dir):
    return near_matches(spark, sf_dir)


@register("j05_syntactic_ids", having("sources", "cases") + f", {SYNTACTIC} SELECT id, doc_id FROM syn")
def j05_syntactic_ids(spark, sf_dir):
    return _syntactic(spark, sf_dir)


def _syntactic(spark, sf_dir):
    s = sources(spark, sf_dir).select(T.canonical_case_id(F.col("case_id")).alias("id"), "doc_id")
    return cases(spark, sf_dir).select("id").join(s, "id")


MERGED = "merged AS (SELECT id, doc_id, string_agg(origin, '+' ORDER BY ord) AS origins FROM (SELECT id, doc_id, 0 AS ord, 'syntactic_id' AS origin FROM syn UNION ALL SELECT id, doc_id, 1, 'near_title_party' FROM near) GROUP BY id, doc_id)"


def _merged(spark, sf_dir):
    a = _syntactic(spark, sf_dir).select("id", "doc_id", F.lit(0).alias("ord"), F.lit("syntactic_id").alias("origin"))
    b = near_matches(spark, sf_dir).select("id", "doc_id", F.lit(1).alias("ord"), F.lit("near_title_party").alias("origin"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "origin"))), lambda x: x["origin"]), "+")
    return a.unionByName(b).groupBy("id", "doc_id").agg(joined.alias("origins"))


@register("u02_merged_candidates", having("sources", "cases") + f", {BLOCK}, {SYNTACTIC}, {MERGED} SELECT id, doc_id, origins FROM merged")
def u02_merged_candidates(spark, sf_dir):
    return _merged(spark, sf_dir)


@register("d08_temporal_overlap", having("sources", "cases") + f", {BLOCK}, {SYNTACTIC}, {MERGED} SELECT origins, {STATUS.format('query_year', 'decision_year')} AS status, count(*) AS n FROM merged JOIN cases USING (id) LEFT JOIN sources s ON s.doc_id = merged.doc_id GROUP BY ALL")
def d08_temporal_overlap(spark, sf_dir):
    m = _merged(spark, sf_dir).join(cases(spark, sf_dir).select("id", "query_year"), "id").join(sources(spark, sf_dir).select("doc_id", "decision_year"), "doc_id", "left")
    return m.groupBy("origins", temporal.status(F.col("query_year"), F.col("decision_year")).alias("status")).agg(F.count("*").alias("n"))


@register("d06_crosswalk", having("sources", "cases") + f""", {BLOCK}, {SYNTACTIC}, {MERGED},
 cp AS (SELECT DISTINCT id, unnest({shingle('t')}) AS phrase FROM (SELECT id, {phrase_tokens('text')} AS t FROM cases WHERE id IN (SELECT id FROM merged))), sp AS (SELECT doc_id, unnest({shingle('t')}) AS phrase FROM (SELECT doc_id, {phrase_tokens('text')} AS t FROM sources WHERE doc_id IN (SELECT doc_id FROM merged))),
 ph AS (SELECT m.id, m.doc_id, count(*) AS phrases FROM merged m JOIN cp ON cp.id = m.id JOIN sp ON sp.doc_id = m.doc_id AND sp.phrase = cp.phrase GROUP BY ALL),
 g AS (SELECT m.id, m.doc_id, origins, coalesce(phrases, 0) AS phrases, len(list_intersect({identity('s.title')}, {identity('c.text')})) AS terms, len({identity('s.title')}) AS own FROM merged m JOIN cases c ON c.id = m.id JOIN sources s ON s.doc_id = m.doc_id LEFT JOIN ph ON ph.id = m.id AND ph.doc_id = m.doc_id)
 SELECT id, doc_id, origins, phrases::BIGINT AS phrases, phrases >= {CONFIG.shared_phrases} AND terms >= {CONFIG.shared_terms} AND terms / own >= {CONFIG.identity_coverage} AS accepted FROM g""")
def d06_crosswalk(spark, sf_dir):
    m, c, s = _merged(spark, sf_dir), cases(spark, sf_dir), sources(spark, sf_dir)
    done = A.passed(A.agreement(m, c.select("id", "text"), s.select("doc_id", "title", "text")))
    return done.select("id", "doc_id", "origins", "phrases", (F.col("passed") & (F.col("phrases") >= CONFIG.shared_phrases)).alias("accepted"))


@register("d07_first_of_equal_texts", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def d07_first_of_equal_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@register("a07_first_order_of_customer", "SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1".replace("SELECT * FROM", "SELECT o_custkey, o_orderkey, d FROM"))
def a07_first_order_of_customer(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return A.first_of(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))


@register("a01_source_text", having("pages") + " SELECT doc_id, sha256(string_agg(raw_text, ' ' ORDER BY page)) AS h, count(*) AS pages FROM pgs GROUP BY doc_id")
def a01_source_text(spark, sf_dir):
    from ..sources.adapters import pages

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "raw_text"))), lambda x: x["raw_text"])
    return pages(spark, sf_dir).groupBy("doc_id").agg(F.sha2(F.array_join(ordered, " "), 256).alias("h"), F.count("*").alias("pages"))


@register("a02_group_metadata", having("sources") + " SELECT court, max(title) AS title, min(decision_date) AS first, max(decision_date) AS last, count(DISTINCT decision_year) AS years FROM sources GROUP BY court")
def a02_group_metadata(spark, sf_dir):
    return sources(spark, sf_dir).groupBy("court").agg(F.max("title").alias("title"), F.min("decision_date").alias("first"), F.max("decision_date").alias("last"), F.countDistinct("decision_year").alias("years"))


@register("a17_decades", having("sources") + " SELECT (decision_year // 10 * 10)::BIGINT AS decade, count(*) AS n FROM sources GROUP BY 1")
def a17_decades(spark, sf_dir):
    return sources(spark, sf_dir).groupBy((F.floor(F.col("decision_year") / 10) * 10).alias("decade")).agg(F.count("*").alias("n"))


@register("u06_subject_terms", f"""WITH c AS (SELECT item_id, unnest({phrase_tokens('text')}) AS t FROM benchmark), a AS (SELECT item_id, t, count(*) AS n FROM c WHERE length(t) >= 5 GROUP BY ALL),
 b AS (SELECT t, count(*) AS n FROM (SELECT unnest({phrase_tokens('text')}) AS t FROM documents) GROUP BY t), m AS (SELECT item_id, a.t, least(a.n, b.n) AS n FROM a JOIN b ON a.t = b.t)
 SELECT item_id, string_agg(t, ' ' ORDER BY k) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, t) AS k FROM m) WHERE k <= 12 GROUP BY item_id""")
def u06_subject_terms(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.phrase_tokens(F.col("text"))).alias("t")).filter(F.length("t") >= 5).groupBy("item_id", "t").agg(F.count("*").alias("n"))
    other = table(spark, sf_dir, "documents").select(F.explode(T.phrase_tokens(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("m"))
    both = own.join(other, "t").select("item_id", "t", F.least("n", "m").alias("n"))
    top = both.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "t"))).filter("k <= 12")
    named = F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"])
    return top.groupBy("item_id").agg(F.array_join(named, " ").alias("terms"))


@register("p31_split_predicates", having("cases") + " SELECT split, count(*) AS n, sum((label = 1)::INT)::BIGINT AS positive FROM cases WHERE id NOT IN (SELECT id FROM cases WHERE split = 'test') GROUP BY split")
def p31_split_predicates(spark, sf_dir):
    c = cases(spark, sf_dir)
    dev = c.join(c.filter("split = 'test'").select("id"), "id", "left_anti")
    return dev.groupBy("split").agg(F.count("*").alias("n"), F.sum((F.col("label") == 1).cast("long")).alias("positive"))


@register("j14_unique_title", having("sources") + f", n AS (SELECT doc_id, array_to_string(list_sort({identity('title')}), ' ') AS t, decision_date AS d FROM sources) SELECT t, d, min(doc_id) AS doc_id FROM n WHERE d IS NOT NULL GROUP BY t, d HAVING count(*) = 1")
def j14_unique_title(spark, sf_dir):
    n = sources(spark, sf_dir).filter("decision_date is not null").select("doc_id", F.array_join(F.array_sort(T.identity_tokens(F.col("title"))), " ").alias("t"), F.col("decision_date").alias("d"))
    return n.groupBy("t", "d").agg(F.count("*").alias("k"), F.min("doc_id").alias("doc_id")).filter("k = 1").select("t", "d", "doc_id")


@register("j17_reconciliation", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NULL AS missing, l.doc_id IS NULL AS unlabelled FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def j17_reconciliation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("d"))
    both = d.join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "full").filter("d is null or l is null")
    return both.select("doc_id", F.col("d").isNull().alias("missing"), F.col("l").isNull().alias("unlabelled"))
