"""Cleaning, chunking, text quality, facts and the scalar families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CONFIG, DISPOSITIVE, SECTION_HEADER
from ..functions import text as T
from ..operators import cleaning as C
from ..operators import facts as X
from ..operators import metrics as M
from ..registry import register
from ..sources.adapters import cases, fold, having, pages, sources, table
from ..sources.store import written


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


NORMAL = fold(r"regexp_replace(regexp_replace(trim({0}, ' '), '(?i)^(?:[A-H]\s+)?SUPREME COURT REPORTS\b', ''), '\s+', ' ', 'g')")


def normal(x: str) -> str:
    return f"trim({NORMAL.format(x)})"


LINES = "list_transform(string_split_regex(raw_text, '\\r\\n|\\r|\\n'), lambda x: trim(x))"
FURNITURE = f"""edges AS (SELECT doc_id, page, unnest(list_concat(list_slice(l, 1, {CONFIG.edge_lines}), list_slice(l, greatest(1, len(l) - {CONFIG.edge_lines - 1}), len(l)))) AS line FROM (SELECT doc_id, page, list_filter({LINES}, lambda x: x <> '') AS l FROM pgs)),
 furn AS (SELECT doc_id, list_sort(list(line)) AS lines FROM (SELECT doc_id, line FROM (SELECT DISTINCT doc_id, page, {normal('line')} AS line FROM edges WHERE NOT regexp_matches(line, '^[A-H]$') AND NOT regexp_matches(line, '^[0-9]{{1,6}}$')) WHERE line <> '' GROUP BY doc_id, line HAVING count(*) >= {CONFIG.furniture_pages}) GROUP BY doc_id)"""
KEPT = f"list_filter({LINES}, lambda x: x <> '' AND NOT regexp_matches(x, '^[A-H]$') AND NOT regexp_matches(x, '^[0-9]{{1,6}}$') AND NOT regexp_matches(x, '(?i)^(?:[A-H]\\s+)?SUPREME COURT REPORTS\\b') AND NOT list_contains(coalesce(lines, []), {normal('x')}))"
CLEAN = f"""clean AS (SELECT doc_id, page, trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform({KEPT}, lambda x: replace(x, chr(65533), ' ')), chr(10)), '([A-Za-z])-[ \\t]*\\n[ \\t]*([a-z])', '\\1\\2', 'g'), '[ \\t]*\\n[ \\t]*', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pgs LEFT JOIN furn USING (doc_id))"""
SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"
CHUNKS = f"""sents AS (SELECT doc_id, page, CASE WHEN len(s) > 0 THEN s ELSE [text] END AS s FROM (SELECT doc_id, page, text, {SENTENCES} AS s FROM clean WHERE text <> '')),
 sized AS (SELECT doc_id, page, s, list_transform(s, lambda x: {WORDS.format('x')}) AS w FROM sents),
 fold AS (SELECT doc_id, page, s, w, 1 AS i, 1 AS chunk, 1 AS held, w[1] AS words FROM sized
  UNION ALL SELECT doc_id, page, s, w, i + 1, CASE WHEN held >= {CONFIG.chunk_sentences} OR words + w[i + 1] > {CONFIG.chunk_words} THEN chunk + 1 ELSE chunk END,
   CASE WHEN held >= {CONFIG.chunk_sentences} OR words + w[i + 1] > {CONFIG.chunk_words} THEN 1 ELSE held + 1 END, CASE WHEN held >= {CONFIG.chunk_sentences} OR words + w[i + 1] > {CONFIG.chunk_words} THEN w[i + 1] ELSE words + w[i + 1] END FROM fold WHERE i < len(s)),
 joined AS (SELECT doc_id, page, chunk, string_agg(s[i], ' ' ORDER BY i) AS text FROM fold GROUP BY doc_id, page, chunk),
 chunks AS (SELECT doc_id, page, chunk, (sum(length(text) + 1) OVER (PARTITION BY doc_id, page ORDER BY chunk) - length(text) - 1)::INT AS start, text FROM joined)"""
NOT_EVIDENCE = f"CASE WHEN {WORDS.format('text')} <= 3 THEN NOT regexp_matches(text, '(?i)\\b(?:appeal|petition|application|case)\\s+(?:is\\s+)?(?:dismissed|allowed|granted|disposed)\\b') ELSE len(regexp_extract_all(text, ',')) >= 3 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= greatest(4, {WORDS.format('text')} // 3) AND (rtrim(text) LIKE '%Adv.' OR rtrim(text) LIKE '%Advs.' OR {WORDS.format('text')} <= 50) END"
PAGES = having("pages")


@register("p01_normal_lines", f"SELECT doc_id, pos, {normal('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10)))))::INT AS pos FROM documents)")
def p01_normal_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", C.normal_line(F.col("line")).alias("line"))


@register("p02_page_furniture", PAGES + f", {FURNITURE} SELECT doc_id, array_to_string(lines, '|') AS lines FROM furn")
def p02_page_furniture(spark, sf_dir):
    return C.furniture(pages(spark, sf_dir)).select("doc_id", F.array_join("lines", "|").alias("lines"))


@register("p03_clean_pages", PAGES + f", {FURNITURE}, {CLEAN} SELECT doc_id, page::INT AS page, text FROM clean")
def p03_clean_pages(spark, sf_dir):
    return C.cleaned(pages(spark, sf_dir))


@register("p04_sentences", f"SELECT doc_id, unnest(range(0, len(s)))::INT AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def p04_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@register("p05_chunks", PAGES + f", {FURNITURE}, {CLEAN}, {CHUNKS} SELECT printf('S_%d::p%04d::c%03d', doc_id, page, chunk) AS chunk_id, start, (start + length(text))::INT AS \"end\", text FROM chunks")
def p05_chunks(spark, sf_dir):
    return C.chunks(C.cleaned(pages(spark, sf_dir))).select(C.chunk_id().alias("chunk_id"), "start", "end", "text")


@register("p07_chunk_ids", PAGES + f", {FURNITURE}, {CLEAN}, {CHUNKS} SELECT doc_id, page::INT AS page, chunk::INT AS chunk, 'S_' || doc_id || '::p' || lpad(page::VARCHAR, 4, '0') || '::c' || lpad(chunk::VARCHAR, 3, '0') AS chunk_id FROM chunks")
def p07_chunk_ids(spark, sf_dir):
    return C.chunks(C.cleaned(pages(spark, sf_dir))).select("doc_id", "page", "chunk", C.chunk_id().alias("chunk_id"))


@register("p12_passage_bounds", PAGES + f", {FURNITURE}, {CLEAN}, {CHUNKS}, b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN -1 ELSE start END AS start, CASE WHEN doc_id % 13 = 0 THEN start ELSE start + length(text) END AS stop, text FROM chunks) SELECT sum((start < 0)::INT)::BIGINT AS negative, sum((stop <= start)::INT)::BIGINT AS empty, sum((start < 0 OR stop <= start)::INT)::BIGINT AS wrong, count(*) AS n FROM b")
def p12_passage_bounds(spark, sf_dir):
    """Passage bounds of chunks, some of them spoilt: a start below zero or an end that is not behind it."""
    c = C.chunks(C.cleaned(pages(spark, sf_dir)))
    b = c.select(F.when(F.col("doc_id") % 11 == 0, -1).otherwise(F.col("start")).alias("start"), F.when(F.col("doc_id") % 13 == 0, F.col("start")).otherwise(F.col("end")).alias("stop"))
    total = lambda c, n: F.sum(c.cast("long")).alias(n)
    low, empty = F.col("start") < 0, F.col("stop") <= F.col("start")
    return b.agg(total(low, "negative"), total(empty, "empty"), total(low | empty, "wrong"), F.count("*").alias("n"))


@register("p06_evidence_chunks", PAGES + f", {FURNITURE}, {CLEAN}, {CHUNKS} SELECT doc_id, count(*) AS chunks, sum(({NOT_EVIDENCE})::INT)::BIGINT AS dropped FROM chunks GROUP BY doc_id")
def p06_evidence_chunks(spark, sf_dir):
    made = C.chunks(C.cleaned(pages(spark, sf_dir)))
    return made.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(C.not_evidence(F.col("text")).cast("long")).alias("dropped"))


METRICS = f"""m AS (SELECT doc_id, source, length(regexp_replace(text, '\\s', '', 'g')) AS nonspace_characters, len(regexp_extract_all(text, '[!-~]')) AS vis, len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]')) AS control_characters, len(regexp_extract_all(text, chr(65533))) AS replacement_characters,
 len(regexp_extract_all(text, '[\\x{{80}}-\\x{{9f}}\\x{{fffd}}]|(?:Ã|Â|â)[^\\s]')) AS mojibake_markers, {WORDS.format('text')} AS tokens, len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) AS ascii_words FROM documents),
 m2 AS (SELECT *, CASE WHEN nonspace_characters > 0 THEN round(vis / nonspace_characters, 6) ELSE 0 END AS ascii_visible_ratio, CASE WHEN tokens > 0 THEN round(ascii_words / tokens, 6) ELSE 0 END AS ascii_words_per_token FROM m),
 rs AS (SELECT *, list_filter([CASE WHEN nonspace_characters < 80 THEN 'insufficient_embedded_text' END, CASE WHEN control_characters > 0 THEN 'unicode_control_characters' END, CASE WHEN replacement_characters >= 2 THEN 'replacement_characters' END, CASE WHEN mojibake_markers >= 2 THEN 'mojibake_markers' END,
  CASE WHEN nonspace_characters >= 80 AND ascii_visible_ratio < 0.75 THEN 'low_ascii_visible_ratio' END, CASE WHEN tokens >= 20 AND ascii_words_per_token < 0.25 THEN 'low_english_token_ratio' END], lambda x: x IS NOT NULL) AS reasons FROM m2)"""


def _measured(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", *[c.alias(n) for n, c in C.metrics(F.col("text")).items()])


@register("p09_text_metrics", f"WITH {METRICS} SELECT doc_id, nonspace_characters, ascii_visible_ratio, control_characters, replacement_characters, mojibake_markers, tokens, ascii_words, ascii_words_per_token FROM m2")
def p09_text_metrics(spark, sf_dir):
    return _measured(spark, sf_dir).drop("source")


@register("p10_quality_classes", f"WITH {METRICS} SELECT doc_id, CASE WHEN len(reasons) > 0 THEN 'needs_repair' ELSE 'pass' END AS status, array_to_string(reasons, ',') AS reasons FROM rs")
def p10_quality_classes(spark, sf_dir):
    r = _measured(spark, sf_dir).withColumn("reasons", C.reasons())
    return r.select("doc_id", F.when(F.size("reasons") > 0, "needs_repair").otherwise("pass").alias("status"), F.array_join("reasons", ",").alias("reasons"))


@register("p11_quality_gate", f"WITH {METRICS} SELECT doc_id FROM rs WHERE len(reasons) = 0")
def p11_quality_gate(spark, sf_dir):
    return _measured(spark, sf_dir).filter(F.size(C.reasons()) == 0).select("doc_id")


@register("a23_reason_counts", f"WITH {METRICS} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM rs) GROUP BY reason")
def a23_reason_counts(spark, sf_dir):
    return _measured(spark, sf_dir).select(F.explode(C.reasons()).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@register("a20_corpus_totals", f"WITH {METRICS} SELECT source, count(*) AS texts, sum(tokens)::BIGINT AS tokens, sum((len(reasons) > 0)::INT)::BIGINT AS repairs, bool_and(len(reasons) = 0) AS ready FROM rs GROUP BY source")
def a20_corpus_totals(spark, sf_dir):
    r = _measured(spark, sf_dir).withColumn("bad", F.size(C.reasons()) > 0)
    return r.groupBy("source").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"), F.sum(F.col("bad").cast("long")).alias("repairs"), F.bool_and(~F.col("bad")).alias("ready"))


def _at(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(text, '{q(pattern)}') THEN length(string_split(regexp_replace(text, '{q(pattern)}', chr(1)), chr(1))[1]) END"


PLACES = [_at("(?im)" + SECTION_HEADER), *[_at("(?i)" + p) for p in DISPOSITIVE]]
FACTS = having("cases") + f""", f1 AS (SELECT *, list_min(list_filter([{', '.join(f'{{place: {p}, ord: {k}}}' for k, p in enumerate(PLACES))}], lambda x: x.place IS NOT NULL)) AS hit, round(length(text) * {CONFIG.retained})::INT AS cap FROM cases),
 f2 AS (SELECT *, CASE WHEN text = '' THEN 'empty_text' WHEN hit IS NULL OR hit.place > cap THEN 'positional_cap' WHEN hit.ord = 0 THEN 'section_header' ELSE 'dispositive_cue' END AS boundary_reason, CASE WHEN hit IS NULL OR hit.place > cap THEN cap ELSE hit.place END AS cut FROM f1),
 f3 AS (SELECT *, length(regexp_extract(substring(text, 1, cut), '(?s)^.*[.!?](?:["'')\\]”’]+)?\\s*', 0)) AS aligned FROM f2),
 f4 AS (SELECT *, CASE WHEN text <> '' THEN (CASE WHEN aligned >= {CONFIG.aligned_chars} THEN aligned ELSE cut END)::INT END AS boundary_char FROM f3),
 facts AS (SELECT *, coalesce(regexp_replace(substring(text, 1, boundary_char), '\\s+$', ''), '') AS facts FROM f4)"""
ELIGIBLE = f"length(text) > 0 AND length(facts) / length(text) >= {CONFIG.least_retained} AND {WORDS.format('facts')} >= {CONFIG.least_words}"


@register("p13_facts_slice", FACTS + " SELECT doc_id, boundary_char, boundary_reason, length(text)::INT AS source_chars, length(facts)::INT AS retained_chars, facts FROM facts")
def p13_facts_slice(spark, sf_dir):
    return X.extract(cases(spark, sf_dir)).select("doc_id", "boundary_char", "boundary_reason", "source_chars", "retained_chars", "facts")


@register("p16_facts_eligibility", FACTS + f" SELECT split, count(*) AS cases, sum(({ELIGIBLE})::INT)::BIGINT AS eligible FROM facts GROUP BY split")
def p16_facts_eligibility(spark, sf_dir):
    return X.extract(cases(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("cases"), F.sum(X.eligible().cast("long")).alias("eligible"))


SPOKEN = "CASE WHEN doc_id % 3 = 0 THEN text || ' The appeal is dismissed. We allow the petition. THE APPEAL IS DISMISSED.' ELSE text END"


@register("p15_outcome_cues", f"WITH c AS (SELECT doc_id, list_distinct(flatten([{', '.join(f'regexp_extract_all(text, {chr(39)}(?i){q(p)}{chr(39)})' for p in DISPOSITIVE)}])) AS x FROM (SELECT doc_id, {SPOKEN} AS text FROM documents)) SELECT doc_id, len(x)::INT AS n, array_to_string(list_transform(list_sort(list_transform(x, lambda v: {{'k': lower(v), 'v': v}})), lambda s: s.v), '|') AS phrases FROM c")
def p15_outcome_cues(spark, sf_dir):
    """Distinct phrases of all outcome patterns, in case-blind order; every third text is given some."""
    x = X.cues(F.expr(SPOKEN))
    return table(spark, sf_dir, "documents").select("doc_id", x.alias("x")).select("doc_id", F.size("x").alias("n"), F.array_join("x", "|").alias("phrases"))


@register("p17_ends_a_sentence", FACTS + " SELECT doc_id, regexp_matches(facts, '[.!?”’]\\s*$') AS complete FROM facts")
def p17_ends_a_sentence(spark, sf_dir):
    return X.extract(cases(spark, sf_dir)).select("doc_id", F.col("facts").rlike(r"[.!?”’]\s*$").alias("complete"))


@register("a10_facts_medians", FACTS + f" SELECT boundary_reason, count(*) AS n, median({WORDS.format('facts')}) AS kept_words, median({WORDS.format('text')}) AS source_words FROM facts GROUP BY boundary_reason")
def a10_facts_medians(spark, sf_dir):
    f = X.extract(cases(spark, sf_dir))
    # the texts are read once: what follows reads the counts five times
    sizes = written(f.select("boundary_reason", *[F.size(T.words(F.col(c))).alias(c) for c in ("facts", "text")]), "facts-sizes")
    kept = M.percentiles(sizes, ["boundary_reason"], "facts", {"kept_words": 0.5}).drop("n").withColumnRenamed("boundary_reason", "_reason")
    source = M.percentiles(sizes, ["boundary_reason"], "text", {"source_words": 0.5}).drop("n").withColumnRenamed("boundary_reason", "_other")
    counts = sizes.groupBy("boundary_reason").agg(F.count("*").alias("n"))
    both = counts.join(kept, F.col("boundary_reason").eqNullSafe(F.col("_reason"))).join(source, F.col("boundary_reason").eqNullSafe(F.col("_other")))
    return both.select("boundary_reason", "n", "kept_words", "source_words")


CATEGORY = (
    "CASE WHEN o LIKE '%criminal%' AND o LIKE '%jurisdiction%' THEN 'criminal' WHEN o LIKE '%civil%' AND o LIKE '%jurisdiction%' THEN 'civil' "
    "WHEN o LIKE '%original jurisdiction%' THEN 'original' WHEN o LIKE '%writ petition%' THEN 'writ_or_constitutional' ELSE 'other_or_unclassified' END"
)


@register("p18_header_category", f"SELECT doc_id, {CATEGORY} AS category FROM (SELECT doc_id, lower(substring(text, 1, 1500)) AS o FROM documents)")
def p18_header_category(spark, sf_dir):
    o = F.lower(F.substring("text", 1, 1500))
    has = lambda *w: [o.contains(x) for x in w]
    a, b, c, d, e = has("criminal", "jurisdiction", "civil", "original jurisdiction", "writ petition")
    kind = F.when(a & b, "criminal").when(c & b, "civil").when(d, "original").when(e, "writ_or_constitutional").otherwise("other_or_unclassified")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("category"))


@register("p12_required_fields", having("sources") + " SELECT sum((case_id IS NULL OR case_id = '')::INT)::BIGINT AS no_case, sum((decision_date IS NULL)::INT)::BIGINT AS no_date, sum((title IS NULL OR title = '')::INT)::BIGINT AS no_title, sum((text IS NULL OR text = '' OR decision_date IS NULL OR title IS NULL OR title = '')::INT)::BIGINT AS invalid FROM sources")
def p12_required_fields(spark, sf_dir):
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    total = lambda c, n: F.sum(c.cast("long")).alias(n)
    no_date = F.col("decision_date").isNull()
    return sources(spark, sf_dir).agg(total(blank("case_id"), "no_case"), total(no_date, "no_date"), total(blank("title"), "no_title"), total(blank("text") | no_date | blank("title"), "invalid"))


@register("p20_canonical_ids", having("sources", "cases") + r" SELECT s.doc_id, regexp_extract(case_id, '^(\d{4}) INSC (\d+)$', 1) || '_' || regexp_extract(case_id, '^(\d{4}) INSC (\d+)$', 2)::BIGINT AS canonical, c.id = regexp_extract(case_id, '^(\d{4}) INSC (\d+)$', 1) || '_' || regexp_extract(case_id, '^(\d{4}) INSC (\d+)$', 2)::BIGINT AS same FROM sources s JOIN cases c ON s.doc_id = c.doc_id")
def p20_canonical_ids(spark, sf_dir):
    both = sources(spark, sf_dir).select("doc_id", T.canonical_case_id(F.col("case_id")).alias("canonical")).join(cases(spark, sf_dir).select("doc_id", T.canonical_case_id(F.col("id")).alias("own")), "doc_id")
    return both.select("doc_id", "canonical", (F.col("canonical") == F.col("own")).alias("same"))


@register("p21_citation_normal", having("sources") + f" SELECT doc_id, trim(regexp_replace({fold('title')}, '\\s+', ' ', 'g')) AS citation FROM sources")
def p21_citation_normal(spark, sf_dir):
    return sources(spark, sf_dir).select("doc_id", T.citation(F.col("title")).alias("citation"))


@register("p22_title_normal", having("sources") + f" SELECT doc_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(replace({fold('title')}, 'versus', ' v '), '\\bu\\.?\\s*p\\.?\\b', 'uttar pradesh', 'g'), '[a-z0-9]+'), lambda x: x NOT IN ('and', 'anr', 'another', 'ors', 'others', 'etc', 'of', 'the')), ' ') AS title FROM sources")
def p22_title_normal(spark, sf_dir):
    return sources(spark, sf_dir).select("doc_id", T.title(F.col("title")).alias("title"))


@register("p23_url_parts", r"SELECT page_id, regexp_extract(url, '^\w+://([^/?#]+)', 1) AS host, regexp_extract(url, '^\w+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def p23_url_parts(spark, sf_dir):
    part = lambda p: F.coalesce(F.parse_url("url", F.lit(p)), F.lit("")).alias(p.lower())
    return table(spark, sf_dir, "pages").select("page_id", part("HOST"), part("PATH"))


@register("p26_excerpts", "SELECT doc_id, substring(text, 1, 300) AS preview, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), 1, 12), ' ') AS opening FROM documents")
def p26_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 300).alias("preview"), F.array_join(F.slice(T.words(F.col("text")), 1, 12), " ").alias("opening"))


@register("f09_text_hashes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def f09_text_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5(F.encode("text", "UTF-8")).alias("md5"))


@register("f08_json_fields", "SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM events, (SELECT unnest(['k', 'v', 'a']) AS k)")
def f08_json_fields(spark, sf_dir):
    keys = F.explode(F.array(*[F.lit(k) for k in ("k", "v", "a")]))
    e = table(spark, sf_dir, "events").select("event_id", "props", keys.alias("k"))
    return e.select("event_id", F.expr("get_json_object(props, concat('$.', k))").alias("v"), "k")
