"""Readers and writers over files they wrote, scalar functions, ranks and positions."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import text as T
from ..operators import alignment as A
from ..operators import metrics as M
from ..operators import outcome
from ..operators import retrieval as R
from ..registry import register
from ..sources import formats
from ..sources.adapters import cases, fold, having, logits, passages, queries, sources, table
from ..sources.index import Index
from ..sources.keyed import Keyed, Ordered
from ..sources.store import Scratch, drop, shared_dir, written
from .alignment import identity
from .evaluation import MEAN, TOKENS
from .retrieval import BASE, POSTINGS, PRE, SALIENT, _scored, retrieved


def _folder(spark, name):
    """A new folder, deleted at the end of the session."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


# --- files ------------------------------------------------------------------------


@register("s04_streamed_filter", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 2000 AND lang = 'en'")
def s04_streamed_filter(spark, sf_dir):
    """A scan that filters batch by batch: both conditions go to the files, and only three columns are read."""
    return table(spark, sf_dir, "documents").filter("n_chars > 2000 AND lang = 'en'").select("doc_id", "n_chars")


@register("s06_year_files", having("sources") + " SELECT decision_year::VARCHAR AS year, count(*) AS n, min(doc_id)::VARCHAR AS first FROM sources WHERE decision_year IS NOT NULL GROUP BY decision_year")
def s06_year_files(spark, sf_dir):
    """Metadata written to one folder a year, with the year in the files too, and read as one table."""
    at = _folder(spark, "metadata")
    blank = [F.lit(None).cast("string").alias(c) for c in ("petitioner", "respondent", "disposal_nature")]
    s = sources(spark, sf_dir).filter("decision_year is not null").select("title", *blank, F.col("case_id").alias("citation"), "case_id", F.date_format("decision_date", "dd-MM-yyyy").alias("decision_date"), "court", F.col("doc_id").cast("string").alias("path"), F.col("decision_year").cast("string").alias("year"))
    s.withColumn("folder", F.col("year")).repartition("folder").write.partitionBy("folder").parquet(at)
    return formats.read_year_files(spark, at).groupBy("year").agg(F.count("*").alias("n"), F.min(F.col("path").cast("long")).cast("string").alias("first"))


def _lines(spark, sf_dir):
    """Chunk lines as JSON; every seventh is cut, and blank lines stand between."""
    p = passages(spark, sf_dir)
    fields = [F.concat(F.lit("S_"), "doc_id").alias("source_id"), F.lit("c").alias("court"), F.lit("t").alias("title"), "chunk_id", F.lit("31-12-2009").alias("decision_date"), F.lit("f").alias("pdf_file"), F.col("page").cast("int").alias("page_number"), F.lit(0).alias("passage_start_char"), F.char_length("text").alias("passage_end_char"), "text", F.lit("v1").alias("cleaning_version")]
    line = F.to_json(F.struct(*fields))
    line = p.withColumn("line", line)
    return line.select(F.concat(F.when(F.col("doc_id") % 7 == 0, F.substring("line", 1, 20)).otherwise(F.col("line")), F.lit("\n")).alias("value"))


@register("s08_json_lines", having("pages", "passages") + " SELECT chunk_id, page::BIGINT AS page, length(text)::BIGINT AS n FROM passages WHERE doc_id % 7 <> 0")
def s08_json_lines(spark, sf_dir):
    at = _folder(spark, "chunks")
    _lines(spark, sf_dir).write.text(at)
    good, _ = formats.read_chunks(spark, at)
    return good.select("chunk_id", F.col("page_number").cast("long").alias("page"), F.char_length("text").cast("long").alias("n"))


@register("s09_malformed_lines", having("pages", "passages") + " SELECT 'chunks' AS kind, count(*) AS n FROM passages WHERE doc_id % 7 <> 0 UNION ALL SELECT 'malformed', count(*) FROM passages WHERE doc_id % 7 = 0")
def s09_malformed_lines(spark, sf_dir):
    at = _folder(spark, "chunks")
    _lines(spark, sf_dir).write.text(at)
    good, bad = formats.read_chunks(spark, at)
    return good.agg(F.count("*").alias("n")).select(F.lit("chunks").alias("kind"), "n").unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("malformed").alias("kind"), "n"))


@register("s10_json_document", "SELECT item_id::BIGINT AS item_id, length(text)::BIGINT AS n FROM benchmark")
def s10_json_document(spark, sf_dir):
    """A test set as one JSON document; such documents are small by their nature."""
    at = _folder(spark, "document")
    table(spark, sf_dir, "benchmark").agg(F.to_json(F.struct(F.collect_list(F.struct("item_id", "text")).alias("entries")))).write.text(at)
    return formats.read_document(spark, at).select(F.col("item_id").cast("long"), F.char_length("text").cast("long").alias("n"))


@register("s11_csv_crosswalk", having("sources") + " SELECT source_id, case_id, court FROM sources WHERE decision_year IS NOT NULL")
def s11_csv_crosswalk(spark, sf_dir):
    at = _folder(spark, "crosswalk")
    formats.write_csv(sources(spark, sf_dir).filter("decision_year is not null").select("source_id", "case_id", "court"), at)
    return formats.read_crosswalk(spark, at)


@register("s16_listed_chunks", having("pages", "passages") + " SELECT chunk_id, length(text)::BIGINT AS n FROM passages WHERE doc_id % 100 = 0 AND page <= 2")
def s16_listed_chunks(spark, sf_dir):
    """The first two chunks of every hundredth document, looked up by a table of their ids, of which some have no chunk."""
    store = Keyed.write(passages(spark, sf_dir).select("chunk_id", "text"), _folder(spark, "keyed"), "chunk_id")
    pages_ = F.explode(F.array(F.lit(1), F.lit(2))).alias("page")
    wanted = queries(spark, sf_dir).select("query_id", pages_).select(F.format_string("S_%d::p%04d", "query_id", "page").alias("chunk_id"))
    return store.lookup(wanted).select("chunk_id", F.char_length("text").cast("long").alias("n"))


@register("s17_ordered_scan", "SELECT o_orderkey, o_custkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 10000 AS page FROM orders")
def s17_ordered_scan(spark, sf_dir):
    """The whole table in pages of 10,000 rows by key."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return Ordered.write(rows, _folder(spark, "ordered"), "o_orderkey").numbered().select("o_orderkey", "o_custkey", "page")


@register("s18_chunk_store", having("pages", "passages") + " SELECT chunk_id, '2009-12-31'::DATE AS decision_date, page::INT AS page_number, length(text)::INT AS n FROM passages WHERE doc_id % 7 <> 0")
def s18_chunk_store(spark, sf_dir):
    """Chunks, each offered twice, loaded once into a typed table."""
    lines, at = _folder(spark, "chunks"), _folder(spark, "store")
    _lines(spark, sf_dir).write.text(lines)
    good, _ = formats.read_chunks(spark, lines)
    formats.load_store(good.unionByName(good), at)
    return formats.store_table(spark, at).select("chunk_id", "decision_date", "page_number", F.char_length("chunk_text").alias("n"))


@register("s19_run_log", BASE + f", {PRE} SELECT r.run, n, (SELECT count(*) FROM queries) AS queries FROM (SELECT count(*) AS n FROM pre), (VALUES ('a'), ('b')) r(run)")
def s19_run_log(spark, sf_dir):
    """Two runs, one of them logged again by a retry, and a third that breaks off before it is committed."""
    log, q, run = formats.run_log(spark, _folder(spark, "log")), queries(spark, sf_dir), retrieved(spark, sf_dir)
    for name in ("a", "b", "a"):
        log.log(name, q.select(F.lit(name).alias("run"), "query_id"), run.withColumn("run", F.lit(name)))
    log.kept.write(q.select(F.lit("c").alias("run"), "query_id"), "runs")
    log.compact()
    asked = log.read("runs").groupBy("run").agg(F.count("*").alias("queries"))
    return log.read("results").groupBy("run").agg(F.count("*").alias("n")).join(asked, "run", "full").select("run", "n", "queries")


@register("s21_json_artifact", having("sources") + " SELECT court, count(*) AS n FROM sources GROUP BY court")
def s21_json_artifact(spark, sf_dir):
    at = _folder(spark, "artifact")
    formats.write_json(sources(spark, sf_dir).groupBy("court").agg(F.count("*").alias("n")), at)
    return spark.read.schema("court string, n long").json(at)


@register("s22_markdown_report", "SELECT '| lang | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' |', chr(10) ORDER BY lang) AS report FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def s22_markdown_report(spark, sf_dir):
    report = formats.markdown(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang"))
    return spark.createDataFrame([(report,)], "report string")


@register("s23_windows_kept", f"SELECT doc_id AS document, start::INT AS start, least(start + {CONFIG.window}, n)::INT AS stop FROM (SELECT doc_id, n, unnest(CASE WHEN n <= {CONFIG.window} THEN [0] ELSE list_distinct(list_append(range(0, n - {CONFIG.window} + 1, {CONFIG.window - CONFIG.overlap}), n - {CONFIG.window})) END) AS start FROM (SELECT doc_id, {TOKENS} AS n FROM documents))")
def s23_windows_kept(spark, sf_dir):
    """Token windows written once and read by document."""
    at = _folder(spark, "windows")
    n = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.size(T.words(F.col("text"))).alias("n"))
    w = n.select("document", "n", F.posexplode(M.window_starts(F.col("n"), CONFIG.window, CONFIG.overlap)).alias("window", "start"))
    formats.write_windows(w.withColumn("stop", F.least(F.col("start") + CONFIG.window, "n")), at)
    return formats.read_windows(spark, at).select("document", "start", "stop")


KEPT_TERMS = "df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term) SELECT df.term, df, cf, n_all, round(avgdl, 6) AS avgdl FROM df, (SELECT count(*) AS n_all, avg(len(t)) AS avgdl FROM tok)"


def _index_facts(i):
    n, avgdl = i.size()
    return i.terms().select("term", "df", "cf", F.lit(n).alias("n_all"), F.lit(round(avgdl, 6)).alias("avgdl"))


@register("s24_index_kept", having("pages", "passages") + f", {POSTINGS}, {KEPT_TERMS}")
def s24_index_kept(spark, sf_dir):
    """The inverted index written to a folder and opened anew."""
    at = _folder(spark, "index")
    Index(spark, at).add(R.chunk_vectors(passages(spark, sf_dir)))
    return _index_facts(Index(spark, at))


DELETED = ", ".join(f"'S_{k}::p0001'" for k in range(10, 20))


@register("s24_index_grown", having("pages", "passages") + f", {POSTINGS.replace('FROM passages', f'FROM passages WHERE chunk_id NOT IN ({DELETED})')}, {KEPT_TERMS}")
def s24_index_grown(spark, sf_dir):
    """The index built in parts: half of the chunks, the rest in three segments of which some replace what is there, a merge, ten deletions. Equals one build."""
    at = _folder(spark, "grown")
    for part in ("doc_id % 2 = 0", "doc_id % 4 = 1", "doc_id % 8 = 3", "doc_id % 8 in (3, 7)"):
        # chosen before they are cut, as no filter passes the function that counts terms
        Index(spark, at).add(R.chunk_vectors(passages(spark, sf_dir).filter(part)))
    while Index(spark, at).merge():
        pass
    Index(spark, at).delete(passages(spark, sf_dir).filter(f"chunk_id in ({DELETED})"))
    return _index_facts(Index(spark, at))


@register("s25_model_kept", having("cases") + " SELECT count(*) AS n, true AS equal, 1 AS strengths FROM cases WHERE label IS NOT NULL AND split = 'test'")
def s25_model_kept(spark, sf_dir):
    """The outcome baseline saved and loaded: margins of the loaded model against those of the fitted one."""
    c = cases(spark, sf_dir).filter("label is not null").select("id", "split", "text", "label")
    at, test = _folder(spark, "model"), c.filter("split = 'test'")
    with Scratch(spark) as scratch:
        # fitted once: two fits agree to the solver's tolerance only, a model and its copy exactly
        fitted = outcome.train(c.filter("split = 'train'"), scratch, strengths=(1.0,))
        fitted.save(at)
        a, b = fitted.margins(test, "id"), outcome.Model.load(spark, at).margins(test, "id").withColumnRenamed("m0", "again")
        near = F.bool_and(F.coalesce(F.abs(F.col("m0") - F.col("again")) < 1e-6, F.lit(False)))
        return written(a.join(b, "id", "full").agg(F.count("*").alias("n"), near.alias("equal"), F.lit(1).alias("strengths")), "kept")


# --- scalar functions -------------------------------------------------------------


@register("f01_strings", "SELECT c_custkey, lower(c_name) AS l, upper(c_mktsegment) AS u, trim('  ' || c_name || ' ') AS t, length(c_name) AS n, replace(c_name, '#', '-') AS r, lpad(c_custkey::VARCHAR, 8, '0') AS p, starts_with(c_mktsegment, 'A') AS a FROM customer")
def f01_strings(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.selectExpr("c_custkey", "lower(c_name) AS l", "upper(c_mktsegment) AS u", "trim('  ' || c_name || ' ') AS t", "CAST(char_length(c_name) AS BIGINT) AS n", "replace(c_name, '#', '-') AS r", "lpad(CAST(c_custkey AS STRING), 8, '0') AS p", "startswith(c_mktsegment, 'A') AS a")


@register("f02_patterns", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+'))::INT AS words, regexp_extract(text, '(\d+)', 1) AS number, regexp_replace(substring(text, 1, 200), '\s+', ' ', 'g') AS line, regexp_matches(text, '\d{4}') AS dated FROM documents")
def f02_patterns(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all(t, F.lit("[A-Za-z]+"), F.lit(0))).alias("words"), F.regexp_extract(t, r"(\d+)", 1).alias("number"), F.regexp_replace(F.substring(t, 1, 200), r"\s+", " ").alias("line"), t.rlike(r"\d{4}").alias("dated"))


@register("f03_marks_off", r"SELECT doc_id, strip_accents(text) AS plain, len(regexp_extract_all(text, '[\x{00}-\x{1F}\x{7F}-\x{9F}]'))::INT AS control, len(regexp_extract_all(text, '[\x{21}-\x{7E}]'))::INT AS printable FROM documents")
def f03_marks_off(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.unmarked(t).alias("plain"), F.regexp_count(t, F.lit(r"[\x00-\x1F\x7F-\x9F]")).alias("control"), F.regexp_count(t, F.lit(r"[\x21-\x7E]")).alias("printable"))


@register("f04_dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, strftime(o_orderdate, '%d-%m-%Y') AS d, date_diff('day', o_orderdate::DATE, DATE '1999-01-01') AS days, strptime(strftime(o_orderdate, '%d-%m-%Y'), '%d-%m-%Y')::DATE AS back FROM orders")
def f04_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.date_format("o_orderdate", "dd-MM-yyyy")
    return o.select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"), text.alias("d"), F.datediff(F.lit("1999-01-01").cast("date"), F.to_date("o_orderdate")).cast("long").alias("days"), F.to_date(text, "dd-MM-yyyy").alias("back"))


@register("f05_numbers", "SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 6) AS l, round(sqrt(l_extendedprice), 6) AS s, floor(l_extendedprice)::BIGINT AS f, ceil(l_discount * 100)::BIGINT AS c, greatest(l_tax, l_discount) AS g, round(ln(1 + l_quantity), 6) AS l1 FROM lineitem")
def f05_numbers(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "round(ln(l_quantity), 6) AS l", "round(sqrt(l_extendedprice), 6) AS s", "floor(l_extendedprice) AS f", "ceil(l_discount * 100) AS c", "greatest(l_tax, l_discount) AS g", "round(log1p(l_quantity), 6) AS l1")


@register("f06_arrays", "SELECT doc_id, len(t)::INT AS n, t[1] AS first, array_to_string(list_slice(t, 2, 4), ' ') AS some, list_contains(t, 'the') AS has, len(list_distinct(t))::INT AS kinds FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents)")
def f06_arrays(spark, sf_dir):
    t = F.col("t")
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("t"))
    return d.select("doc_id", F.size(t).alias("n"), F.get(t, 0).alias("first"), F.array_join(F.slice(t, 2, 3), " ").alias("some"), F.array_contains(t, "the").alias("has"), F.size(F.array_distinct(t)).alias("kinds"))


@register("f07_counters", "SELECT lang, string_agg(source || '=' || n, ',' ORDER BY n DESC, source) AS counts FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def f07_counters(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    held = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "source")))
    return n.groupBy("lang").agg(F.array_join(F.transform(held, lambda x: F.concat(x["source"], F.lit("="), -x["m"])), ",").alias("counts"))


@register("f10_run_ids", "SELECT count(*) AS n, true AS distinct_ids, true AS well_formed, true AS dated FROM supplier")
def f10_run_ids(spark, sf_dir):
    """Run ids and times differ from run to run; their count, form and order are checked."""
    s = table(spark, sf_dir, "supplier").select(F.uuid().alias("id"), F.current_timestamp().alias("at"))
    return s.agg(F.count("*").alias("n"), (F.countDistinct("id") == F.count("*")).alias("distinct_ids"), F.bool_and(F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("well_formed"), F.bool_and(F.col("at") > F.lit("2020-01-01").cast("timestamp")).alias("dated"))


@register("f11_nulls", having("sources") + " SELECT doc_id, coalesce(decision_year, 0)::INT AS y, nullif(court, 'src1') AS c, decision_year IS NULL AS missing, decision_year IS DISTINCT FROM 1950 AS other FROM sources")
def f11_nulls(spark, sf_dir):
    return sources(spark, sf_dir).select("doc_id", F.coalesce("decision_year", F.lit(0)).alias("y"), F.nullif(F.col("court"), F.lit("src1")).alias("c"), F.col("decision_year").isNull().alias("missing"), (~F.col("decision_year").eqNullSafe(1950)).alias("other"))


@register("f12_url_names", "SELECT page_id, nullif(regexp_extract(regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1), '([^/]+)_EN\\.pdf$', 1), '') AS name FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://host.example/a/S_' || page_id || '_EN.pdf?x=1' ELSE url END AS u FROM pages)")
def f12_url_names(spark, sf_dir):
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://host.example/a/S_"), "page_id", F.lit("_EN.pdf?x=1"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.source_id_of_url(u).alias("name"))


# --- ranks, positions and order ------------------------------------------------------


@register("w01_score_ranks", BASE + f", ranked AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM marked) SELECT * FROM ranked WHERE rank <= {CONFIG.top_k}")
def w01_score_ranks(spark, sf_dir):
    return retrieved(spark, sf_dir, before=False).select("query_id", "chunk_id", "score", "rank")


@register("w04_chunk_numbers", having("pages") + " SELECT doc_id, page::INT AS page, count(*) OVER (PARTITION BY doc_id ORDER BY page) AS number, printf('S_%d::p%04d::c%03d', doc_id, page, page) AS chunk_id FROM pgs")
def w04_chunk_numbers(spark, sf_dir):
    from ..sources.adapters import pages

    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")).cast("long")
    return pages(spark, sf_dir).select("doc_id", F.col("page").cast("int"), n.alias("number"), F.format_string("S_%d::p%04d::c%03d", "doc_id", "page", n.cast("int")).alias("chunk_id"))


@register("w06_first_positions", f"SELECT query_id, term, min(pos) AS first FROM (SELECT query_id, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM (SELECT doc_id AS query_id, regexp_extract_all({fold('text')}, '[A-Za-z0-9]{{2,}}') AS t FROM documents WHERE doc_id % 100 = 0)) GROUP BY ALL")
def w06_first_positions(spark, sf_dir):
    q = queries(spark, sf_dir).select("query_id", F.posexplode(T.query_tokens(F.col("query_text"))).alias("pos", "term"))
    return q.groupBy("query_id", "term").agg(F.min("pos").cast("long").alias("first"))


@register("w07_windows_of_six", f"SELECT doc_id, greatest(len(t) - 5, 0)::INT AS windows, array_to_string(list_slice(t, 1, 6), ' ') AS first FROM (SELECT doc_id, regexp_extract_all({fold('text')}, '[a-z]{{3,}}') AS t FROM documents) WHERE len(t) >= 6")
def w07_windows_of_six(spark, sf_dir):
    w = T.windows(T.phrase_tokens(F.col("text")), 6)
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).filter(F.size("w") > 0).select("doc_id", F.size("w").alias("windows"), F.get("w", F.lit(0)).alias("first"))


@register("w05_evidence_ids", "SELECT conv_id, turn, 'E' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS evidence_id FROM conversations")
def w05_evidence_ids(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("E"), n).alias("evidence_id"))


@register("o01_best_by_score", BASE + " SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM marked) WHERE k <= 10")
def o01_best_by_score(spark, sf_dir):
    return R.top_k(_scored(spark, sf_dir, k=10), 10, before=False).select("query_id", "chunk_id", "score")


@register("o04_manifest_order", "SELECT path, bytes, row_number() OVER (ORDER BY path) AS place FROM (SELECT source || '/' || doc_id || '.txt' AS path, octet_length(encode(text)) AS bytes FROM documents) ORDER BY path LIMIT 200")
def o04_manifest_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("bytes"))
    return d.orderBy("path").limit(200).withColumn("place", F.row_number().over(Window.orderBy("path")).cast("long"))


@register("o06_first_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 25")
def o06_first_rows(spark, sf_dir):
    """A stop after the first rows that qualify: each task stops at as many."""
    return table(spark, sf_dir, "orders").filter("o_totalprice > 100000").orderBy("o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@register("u04_missing_customers", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def u04_missing_customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@register("r05_stop_word_queries", f"WITH RECURSIVE queries AS (SELECT doc_id AS query_id, 2000 AS query_year, CASE WHEN doc_id % 3 = 0 THEN 'The court and the appeal in the matter' WHEN doc_id % 3 = 1 THEN 'the appeal under section ' || doc_id ELSE substring(text, 1, 200) END AS query_text FROM documents WHERE doc_id % 100 < 3), {SALIENT} SELECT query_id, term, score, rank FROM salient")
def r05_stop_word_queries(spark, sf_dir):
    """Queries of nothing but stop words: what is left is legal references, or nothing."""
    q = table(spark, sf_dir, "documents").filter("doc_id % 100 < 3").selectExpr("doc_id AS query_id", "2000 AS query_year", "CASE WHEN doc_id % 3 = 0 THEN 'The court and the appeal in the matter' WHEN doc_id % 3 = 1 THEN 'the appeal under section ' || doc_id ELSE substring(text, 1, 200) END AS query_text")
    return R.salient_terms(q).select("query_id", "term", "score", "rank")


@register("d04_title_gate", having("sources") + f" SELECT doc_id, len(list_intersect({identity('title')}, {identity('other')})) AS terms, len(list_intersect({identity('title')}, {identity('other')})) >= {CONFIG.shared_terms} AND len(list_intersect({identity('title')}, {identity('other')})) / len({identity('title')}) >= {CONFIG.identity_coverage} AS passed FROM (SELECT a.doc_id, a.title, b.text AS other FROM sources a JOIN sources b ON b.doc_id = a.doc_id + CASE WHEN a.doc_id % 2 = 0 THEN 0 ELSE 1 END) WHERE len({identity('title')}) > 0")
def d04_title_gate(spark, sf_dir):
    """Titles against their own text, and against the next one."""
    s = sources(spark, sf_dir)
    a = s.select("doc_id", "title", (F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1)).alias("at"))
    met = a.join(s.select(F.col("doc_id").alias("at"), "text"), "at")
    return A.title_gate(met).filter("terms > 0").select("doc_id", F.col("shared_terms").alias("terms"), "passed")


@register("m07_pooled_logits", having("logits") + f", {MEAN} SELECT guess, count(*) AS n, sum((guess = label)::INT)::BIGINT AS correct FROM mean GROUP BY guess")
def m07_pooled_logits(spark, sf_dir):
    p = M.mean_pool(logits(spark, sf_dir))
    return p.groupBy("guess").agg(F.count("*").alias("n"), F.sum((F.col("guess") == F.col("label")).cast("long")).alias("correct"))


TERMS = r"list_filter(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2)"
WEIGHTS = f"""w AS (SELECT doc_id, {TERMS} AS w FROM documents), n AS (SELECT count(*) AS n FROM documents),
 t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
 vocabulary AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT {outcome.VOCABULARY}),
 x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN vocabulary USING (term), n)"""


@register("m01_tfidf_weights", f"WITH {WEIGHTS} SELECT doc_id, count(*) AS terms, round(sqrt(sum(x * x)), 5) AS length, round(max(x) / sqrt(sum(x * x)), 5) AS largest, round(sum(x) / sqrt(sum(x * x)), 4) AS total FROM x GROUP BY doc_id")
def m01_tfidf_weights(spark, sf_dir):
    """Sublinear TF-IDF of words and pairs over the most frequent terms, each document of unit length."""
    x = outcome.weights(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    length = F.sqrt(F.sum(F.col("x") * F.col("x")))
    return x.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(length, 5).alias("length"), F.round(F.max("x") / length, 5).alias("largest"), F.round(F.sum("x") / length, 4).alias("total"))
