"""Scans, set operations, samples, audits and the remaining aggregates."""

from __future__ import annotations

import atexit
import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import outcome
from ..operators import sampling as S
from ..operators.outcome import STRENGTHS
from ..registry import register
from ..sources import formats
from ..sources.adapters import cases, having, passages, sources, table
from ..sources.store import Scratch, drop, shared_dir, written
from ..streaming import ingest


@register("s01_projected_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem")
def s01_projected_scan(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")


@register("s02_first_match", having("cases") + " SELECT id, split FROM cases WHERE id = (SELECT min(id) FROM cases)")
def s02_first_match(spark, sf_dir):
    c = cases(spark, sf_dir).select("id", "split")
    value = c.agg(F.min("id")).first()[0]
    return formats.read_first_match([c.filter(F.col("split") == x) for x in ("train", "validation", "test")], "id", value)


@register("s03_listed_rows", "SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def s03_listed_rows(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return formats.read_listed(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", wanted)[0]


@register("s05_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "labels", "lineitem", "orders")))
def s05_row_counts(spark, sf_dir):
    one = lambda t: table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
    return one("documents").unionByName(one("labels")).unionByName(one("lineitem")).unionByName(one("orders"))


@register("s07_tagged_union", having("cases") + " SELECT split, count(*) AS n, min(query_year)::INT AS first, max(query_year)::INT AS last FROM cases GROUP BY split")
def s07_tagged_union(spark, sf_dir):
    c = cases(spark, sf_dir)
    parts = [c.filter(F.col("split") == x).drop("split").withColumn("split", F.lit(x)) for x in ("train", "validation", "test")]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("split").agg(F.count("*").alias("n"), F.min("query_year").alias("first"), F.max("query_year").alias("last"))


@register("p08_null_kept_cast", having("sources") + " SELECT doc_id, decision_date::VARCHAR AS d, decision_year::VARCHAR AS y FROM sources")
def p08_null_kept_cast(spark, sf_dir):
    return sources(spark, sf_dir).select("doc_id", F.col("decision_date").cast("string").alias("d"), F.col("decision_year").cast("string").alias("y"))


@register("p24_source_urls", having("sources") + " SELECT doc_id, 'https://host.example/' || substring(source_id[3:], 1, 4) || '/' || source_id[3:] || '_EN.pdf' AS url, source_id[3:] AS back FROM sources")
def p24_source_urls(spark, sf_dir):
    bare = F.regexp_replace("source_id", "^S_", "")
    url = F.concat(F.lit("https://host.example/"), F.substring(bare, 1, 4), F.lit("/"), bare, F.lit("_EN.pdf"))
    return sources(spark, sf_dir).select("doc_id", url.alias("url"), T.source_id_of_url(url).alias("back"))


@register("p25_citation_presence", having("sources") + " SELECT doc_id, regexp_matches(text || ' ' || decision_year || ' (' || doc_id || ') S.C.R.', '(?i)' || decision_year || '\\D{0,24}(?:supp\\D{0,12})?' || doc_id || '\\D{0,16}(?:s\\D{0,3}c\\D{0,3}r|i\\D{0,3}t\\D{0,3}r|air)') AS present FROM sources")
def p25_citation_presence(spark, sf_dir):
    s = sources(spark, sf_dir)
    pattern = F.concat(F.lit("(?i)"), F.col("decision_year"), F.lit(r"\D{0,24}(?:supp\D{0,12})?"), F.col("doc_id"), F.lit(r"\D{0,16}(?:s\D{0,3}c\D{0,3}r|i\D{0,3}t\D{0,3}r|air)"))
    return s.select("doc_id", F.regexp_like(F.concat("text", F.lit(" "), "decision_year", F.lit(" ("), "doc_id", F.lit(") S.C.R.")), pattern).alias("present"))


@register("j02_results_with_chunks", "SELECT e.event_id, u.c_name, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS rank FROM events e JOIN customer u ON u.c_custkey = e.user_id")
def j02_results_with_chunks(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(w).cast("long"))
    return e.join(table(spark, sf_dir, "customer"), e.user_id == F.col("c_custkey")).select("event_id", "c_name", "rank")


@register("j03_array_parameters", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN (SELECT unnest([1, 2, 3]) AS k, unnest([1, 2, 1]) AS n) p ON l_orderkey = k AND l_linenumber = n")
def j03_array_parameters(spark, sf_dir):
    zipped = F.arrays_zip(F.array(*map(F.lit, (1, 2, 3))).alias("k"), F.array(*map(F.lit, (1, 2, 1))).alias("n"))
    p = spark.range(1).select(F.explode(zipped).alias("z")).select(F.col("z.k").alias("k"), F.col("z.n").alias("n"))
    l = table(spark, sf_dir, "lineitem")
    return l.join(p, (l.l_orderkey == p.k) & (l.l_linenumber == p.n)).select("l_orderkey", "l_linenumber", "l_quantity")


@register("j08_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j08_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@register("j09_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j09_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@register("j13_left_with_failures", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'authority_without_linked_evidence' END AS failure FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def j13_left_with_failures(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("k")).distinct()
    return table(spark, sf_dir, "documents").join(l, "doc_id", "left").select("doc_id", F.when(F.col("k").isNull(), "authority_without_linked_evidence").alias("failure"))


@register("j16_before_after", "SELECT a.o_custkey, a.n AS before, b.n AS after, b.n - a.n AS gain FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) <= 1995 GROUP BY 1) a JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) b ON a.o_custkey = b.o_custkey")
def j16_before_after(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    both = o.groupBy("o_custkey").agg(F.sum((F.year("o_orderdate") <= 1995).cast("long")).alias("before"), F.count("*").alias("after"))
    return both.filter("before > 0").withColumn("gain", F.col("after") - F.col("before"))


@register("j18_unique_lookup", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1")
def j18_unique_lookup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n = 1")


@register("a05_document_frequency", "SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents) GROUP BY token")
def a05_document_frequency(spark, sf_dir):
    t = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))))
    return table(spark, sf_dir, "documents").select(t.alias("token")).groupBy("token").agg(F.count("*").alias("df"))


@register("a06_value_counts", "SELECT lang, source, count(*) AS n, count(DISTINCT text) AS texts FROM documents GROUP BY lang, source")
def a06_value_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", F.sha2("text", 256).alias("h"))
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.countDistinct("h").alias("texts"))


@register("a08_spans", "SELECT o_custkey, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last, count(*) AS n FROM orders GROUP BY o_custkey")
def a08_spans(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"), F.count("*").alias("n"))


PERCENTS = (10, 25, 50, 75, 90, 95, 99)


@register("a09_percentiles", "SELECT lang, " + ", ".join(f"round(quantile_cont(n_chars, {p / 100}), 6) AS p{p}" for p in PERCENTS) + ", sum((n_chars > 4000)::INT)::BIGINT AS above FROM documents GROUP BY lang")
def a09_percentiles(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = M.percentiles(d, ["lang"], "n_chars", {f"p{p}": p / 100 for p in PERCENTS})
    above = d.groupBy(F.col("lang").alias("_lang")).agg(F.sum((F.col("n_chars") > 4000).cast("long")).alias("above"))
    return p.join(above, F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in PERCENTS], "above")


@register("a22_population_summary", having("cases") + " SELECT split, label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 2) AS percent, round(quantile_cont(length(text), 0.5), 1) AS median FROM cases GROUP BY split, label")
def a22_population_summary(spark, sf_dir):
    all_ = cases(spark, sf_dir).withColumn("size", F.char_length("text"))
    middle = M.percentiles(all_, ["split", "label"], "size", {"median": 0.5}).select(F.col("split").alias("_split"), F.col("label").alias("_label"), F.round("median", 1).alias("median"))
    counts = all_.groupBy("split", "label").agg(F.count("*").alias("n"))
    c = counts.join(middle, (F.col("split") == F.col("_split")) & F.col("label").eqNullSafe(F.col("_label"))).drop("_split", "_label")
    return c.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("split")), 2))


RUN = 1000


def _levels(n: int) -> str:
    """Digests of runs of RUN lines, twice: for keys below a million."""
    one = "SELECT {keys}, k // {run} AS k, sha256(string_agg(h, chr(10) ORDER BY k)) AS h, sum(n)::BIGINT AS n FROM {of} GROUP BY {keys}, k // {run}"
    return ", ".join(f"l{i} AS ({one.format(keys='g', run=RUN, of=f'l{i - 1}')})" for i in range(1, n + 1))


DEEP = "(SELECT CASE WHEN max(k) < 1000 THEN 1 WHEN max(k) < 1000000 THEN 2 ELSE 3 END FROM l0)"


def _digest_sql(lines: str) -> str:
    return f"l0 AS ({lines}), {_levels(3)}, d AS (SELECT g, h, n FROM l1 WHERE {DEEP} = 1 UNION ALL SELECT g, h, n FROM l2 WHERE {DEEP} = 2 UNION ALL SELECT g, h, n FROM l3 WHERE {DEEP} = 3)"


MANIFEST = "SELECT 0 AS g, doc_id AS k, sha256(doc_id || ':' || length(text) || ':' || sha256(text)) AS h, 1 AS n FROM documents"


@register("a24_manifest_digest", f"WITH {_digest_sql(MANIFEST)} SELECT h AS digest, n FROM d")
def a24_manifest_digest(spark, sf_dir):
    line = F.concat_ws(":", "doc_id", F.char_length("text"), F.sha2("text", 256))
    return S.digest(table(spark, sf_dir, "documents"), line, F.col("doc_id"), RUN)


@register("a25_id_digest", having("cases") + f", {_digest_sql('SELECT split AS g, doc_id AS k, sha256(id) AS h, 1 AS n FROM cases')} SELECT g AS split, h AS digest, n FROM d")
def a25_id_digest(spark, sf_dir):
    return S.digest(cases(spark, sf_dir), F.col("id"), F.col("doc_id"), RUN, "split")


@register("w09_latest_run", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def w09_latest_run(spark, sf_dir):
    return S.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@register("w10_hash_sample", "SELECT doc_id, source FROM documents ORDER BY md5(doc_id || ':17'), doc_id LIMIT 50")
def w10_hash_sample(spark, sf_dir):
    return S.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 50)


@register("w11_stratified_sample", "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || ':17'), doc_id) AS n FROM documents) WHERE n <= 3")
def w11_stratified_sample(spark, sf_dir):
    return S.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"], 3)


@register("w12_first_long_passage", having("pages", "passages") + " SELECT doc_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS n FROM passages WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 20) WHERE n = 1")
def w12_first_long_passage(spark, sf_dir):
    p = passages(spark, sf_dir).filter(F.size(T.words(F.col("text"))) >= 20)
    return p.groupBy("doc_id").agg(F.min_by("chunk_id", "page").alias("chunk_id"))


@register("o03_case_blind_sort", "SELECT source, string_agg(lang, ',' ORDER BY lower(lang), lang) AS langs FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source")
def o03_case_blind_sort(spark, sf_dir):
    named = F.transform(F.array_sort(F.collect_set(F.struct(F.lower("lang").alias("k"), "lang"))), lambda x: x["lang"])
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(named, ",").alias("langs"))


@register("o05_argmax_tie", "SELECT l_suppkey, arg_max(l_orderkey, (l_quantity, -l_orderkey)) AS best FROM lineitem GROUP BY l_suppkey")
def o05_argmax_tie(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_orderkey", F.struct("l_quantity", -F.col("l_orderkey"))).alias("best"))


@register("u03_set_operations", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT 'both' AS op, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first_only', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)")
def u03_set_operations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = (o.filter(F.col("o_orderstatus") == s).select("o_custkey").distinct() for s in "FO")
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return one("both", a.intersect(b)).unionByName(one("first_only", a.subtract(b))).unionByName(one("either", a.union(b).distinct()))


@register("u07_set_equality", "SELECT count(*) = 0 AS equal FROM ((SELECT DISTINCT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) UNION ALL (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem))")
def u07_set_equality(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    odd = a.join(b, "k", "left_anti").unionByName(b.join(a, "k", "left_anti"))
    return odd.agg((F.count("*") == 0).alias("equal"))


@register("m01_tfidf_document_frequency", r"SELECT t AS term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])))) AS t FROM (SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2) AS w FROM documents)) GROUP BY t HAVING count(*) >= 2")
def m01_tfidf_document_frequency(spark, sf_dir):
    t = outcome.terms(table(spark, sf_dir, "documents")).select(F.explode(F.array_distinct("terms")).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df")).filter("df >= 2")


@register("m03_outcome_baseline")
def m03_outcome_baseline(spark, sf_dir):
    c = cases(spark, sf_dir).filter("label is not null").select("id", "split", "text", "label")
    with Scratch(spark) as scratch:
        best, rows = outcome.select(*[c.filter(F.col("split") == s) for s in ("train", "validation", "test")], scratch)
        return written(M.confusion(rows, "label", "guess").withColumn("strength", F.lit(best)), "baseline")


FIXED = ("the", "and", "of")
"""Terms of the small baseline, which SQL can solve."""

STEPS = 1500
LABELLED = r"lab AS (SELECT id, split, label, list_filter(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2) AS w FROM cases WHERE label IS NOT NULL)"


def _fit_sql(name: str, where: str) -> str:
    """Vectors of some rows in list columns, and accelerated descent on them for all strengths, until nothing moves."""
    k = len(FIXED)
    seen = [f"len(list_filter(w, lambda t: t = '{t}'))" for t in FIXED]
    tfidf = ", ".join(f"CASE WHEN tf[{i + 1}] > 0 THEN (1 + ln(tf[{i + 1}])) * (ln((1 + n) / (1 + df[{i + 1}])) + 1) ELSE 0 END" for i in range(k))
    dot = lambda a, b: " + ".join(f"{a}[{i + 1}] * {b}[{i + 1}]" for i in range(k + 1))
    return f"""{name}_tf AS (SELECT id, label, [{', '.join(seen)}] AS tf FROM lab WHERE {where}),
 {name}_n AS (SELECT count(*) AS n, [{', '.join(f'sum((tf[{i + 1}] > 0)::INT)' for i in range(k))}] AS df FROM {name}_tf),
 {name}_raw AS (SELECT id, 2.0 * label - 1 AS y, n, [{tfidf}] AS x FROM {name}_tf, {name}_n),
 {name}_x AS (SELECT y, n, list_append(list_transform(x, lambda v: v / greatest(sqrt({' + '.join(f'x[{i + 1}] * x[{i + 1}]' for i in range(k))}), 1e-300)), 1.0::DOUBLE) AS x FROM {name}_raw),
 {name}_w AS (SELECT 0 AS step, c, {[0.0] * (k + 1)}::DOUBLE[] AS w, {[0.0] * (k + 1)}::DOUBLE[] AS v FROM (VALUES {', '.join(f'({c}::DOUBLE)' for c in STRENGTHS)}) s(c)
  UNION ALL SELECT step + 1, c, new AS w, list_transform(range(1, {k + 2}), lambda i: new[i] + momentum * (new[i] - w[i])) AS v
  FROM (SELECT any_value(step) AS step, o.c, any_value(w) AS w, (1 - sqrt(any_value(q))) / (1 + sqrt(any_value(q))) AS momentum,
   [{', '.join(f'any_value(v[{i + 1}]) - any_value(rate) * (sum(-y * x[{i + 1}] / (1 + exp(y * ({dot("x", "v")})))) / any_value(n) + any_value(v[{i + 1}]) / (o.c * any_value(n)))' for i in range(k + 1))}] AS new
   FROM (SELECT *, 1 / (0.5 + 1 / (c * (SELECT n FROM {name}_n))) AS rate, 1 / (c * (SELECT n FROM {name}_n)) / (0.5 + 1 / (c * (SELECT n FROM {name}_n))) AS q FROM {name}_w) o, {name}_x GROUP BY o.c) WHERE step < {STEPS}),
 {name}_fit AS (SELECT c, w FROM {name}_w WHERE step = {STEPS})"""


@register("m02_strength_path", having("cases") + f", {LABELLED}, {_fit_sql('a', chr(39).join(['split = ', 'train', '']))} SELECT c AS strength, round(w[1], 4) AS w1, round(w[2], 4) AS w2, round(w[3], 4) AS w3, round(w[4], 4) AS constant, true AS converged FROM a_fit")
def m02_strength_path(spark, sf_dir):
    """The regression on three fixed terms under all strengths: weights in the order of the terms."""
    c = cases(spark, sf_dir).filter("label is not null and split = 'train'").select("id", "text", "label")
    with Scratch(spark) as scratch:
        m = outcome.train(c, scratch, only=FIXED)
        by_term = {r["term"]: r for r in m.table.collect()}  # three rows
        rows = [(s, *(round(by_term[t][f"w{k}"] if t in by_term else 0.0, 4) for t in FIXED), round(m.constants[k], 4), m.norms[k] < 1e-6) for k, s in enumerate(m.strengths)]
    return spark.createDataFrame(rows, "strength double, w1 double, w2 double, w3 double, constant double, converged boolean")


@register("t01_streamed_chunks", having("pages", "passages") + " SELECT decision_year, count(*) AS n FROM passages GROUP BY decision_year")
def t01_streamed_chunks(spark, sf_dir):
    """Chunks through the streaming ingest, each offered twice and kept once."""
    folder = f"{shared_dir(spark)}/ingest-{os.urandom(8).hex()}"
    atexit.register(drop, spark, folder)
    p = passages(spark, sf_dir).select("chunk_id", F.concat(F.lit("S_"), "doc_id").alias("source_id"), "decision_year", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("arrived"), "text")
    p.unionByName(p).write.parquet(f"{folder}/in")
    ingest.append_to(ingest.distinct_chunks(ingest.read_chunks(spark, f"{folder}/in")), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(ingest.CHUNKS).option("recursiveFileLookup", "true").parquet(f"{folder}/out").groupBy("decision_year").agg(F.count("*").alias("n"))


@register("t02_latest_runs", "SELECT user_id || ':' || event_type AS key, event_id AS id, 3 AS orders FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def t02_latest_runs(spark, sf_dir):
    """The latest event of each user and kind, kept by a stream that gets the events in three orders, four files of each one by one; in how many orders it comes out the same."""
    folder = f"{shared_dir(spark)}/runs-{os.urandom(8).hex()}"
    atexit.register(drop, spark, folder)
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    tables = []
    for name, order in {"rising": F.col("at"), "falling": F.desc("at"), "mixed": F.xxhash64("id")}.items():
        e.repartitionByRange(4, order).write.parquet(f"{folder}/{name}/in")
        ingest.append_to(ingest.latest_runs(ingest.read_runs(spark, f"{folder}/{name}/in")), f"{folder}/{name}/out", f"{folder}/{name}/state", "update").awaitTermination()
        changes = spark.read.schema(ingest.RUN).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}/out")
        tables.append(ingest.newest(changes))
    every = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return every.groupBy("key", "id").agg(F.count("*").cast("int").alias("orders"))


@register("t03_arrivals", having("pages", "passages") + " SELECT decision_year, time_bucket(INTERVAL 10 minutes, TIMESTAMP '2024-01-01' + to_minutes((doc_id % 500)::BIGINT), TIMESTAMP '2024-01-01') AS start, count(*) AS n FROM passages GROUP BY ALL")
def t03_arrivals(spark, sf_dir):
    """Chunks per ten minutes of their arrival and year, counted by a stream that gets them in two batches of files."""
    folder = f"{shared_dir(spark)}/arrivals-{os.urandom(8).hex()}"
    atexit.register(drop, spark, folder)
    minute = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") % 500).cast("int"))
    p = passages(spark, sf_dir).select("chunk_id", F.concat(F.lit("S_"), "doc_id").alias("source_id"), "decision_year", (F.lit("2024-01-01 00:00:00").cast("timestamp") + minute).alias("arrived"), "text")
    files = max(2, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # no task holds a part of the table that grows with its share of two
    p.repartition(files, "chunk_id").write.parquet(f"{folder}/in")
    counted = ingest.arrivals(ingest.read_chunks(spark, f"{folder}/in", (files + 1) // 2), late="30 days")
    ingest.append_to(counted, f"{folder}/out", f"{folder}/state", "update").awaitTermination()
    changes = spark.read.schema("start timestamp, decision_year int, n long").option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return changes.groupBy("decision_year", "start").agg(F.max("n").alias("n")).select("decision_year", F.col("start").cast("timestamp_ntz").alias("start"), "n")
