"""Views of the driver's tables in the shape of the engine's data model.

Each has the same arithmetic as the SQL of its name in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import text as T


TEXT_TABLES = ("documents", "pages")
SMALL_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies. Only a small text table in fewer files than there are cores is dealt out anew: a file of one
    row group is one task however many cores wait, and texts cost far more than moving a few megabytes."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SMALL_BYTES and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def year():
    return (1950 + (F.col("doc_id") * 37) % 71).cast("int")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments: a stable source id, a nullable date, court, title and text."""
    dated = F.col("doc_id") % 97 != 0
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat(F.lit("S_"), F.col("doc_id")).alias("source_id"),
        F.concat(year(), F.lit(" INSC "), F.col("doc_id")).alias("case_id"),
        F.when(dated, F.make_date(year(), (1 + F.col("doc_id") % 12).cast("int"), (1 + F.col("doc_id") % 28).cast("int"))).alias("decision_date"),
        F.when(dated, year()).alias("decision_year"),
        F.col("source").alias("court"),
        F.array_join(F.slice(F.split("text", r"\s+"), 1, 8), " ").alias("title"),
        "text",
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query side: id, year, text, label and split of every document."""
    part = (F.col("doc_id") / 10).cast("long") % 10
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat_ws("_", year(), F.col("doc_id")).alias("id"),
        year().alias("query_year"),
        "text",
        "label",
        F.when(part < 7, "train").when(part == 7, "validation").otherwise("test").alias("split"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search set: every document whose id is divisible by 100, against all rows."""
    return table(spark, sf_dir, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), year().alias("query_year"), F.col("text").alias("query_text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a source: runs of lines, numbered from 1."""
    n = CONFIG.lines_per_page
    cut = lambda lines: F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / n).cast("int")), lambda i: F.array_join(F.slice(lines, i * n + 1, n), "\n"))
    runs = T.bind(F.split("text", "\n"), cut)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(runs).alias("at", "raw_text")).select("doc_id", (F.col("at") + 1).alias("page"), "raw_text")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as indexed passages, with id and year of their source."""
    dated = F.when(F.col("doc_id") % 97 != 0, year())
    p = pages(spark, sf_dir)
    return p.select("doc_id", F.format_string("S_%d::p%04d", F.col("doc_id"), F.col("page")).alias("chunk_id"), dated.alias("decision_year"), "page", F.col("raw_text").alias("text"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window logits of a two-class model: two components of each embedding."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select((v % 100).alias("document"), v.alias("window"), F.col("embedding")[0].cast("double").alias("l0"), F.col("embedding")[1].cast("double").alias("l1"), ((v % 100) % 2).cast("int").alias("label"))


YEAR = "(1950 + (doc_id * 37) % 71)"
FOLD = "replace(lower(coalesce({0}, '')), 'ß', 'ss')"


def fold(x: str) -> str:
    return FOLD.format(x)


SQL = {
    "sources": f"""sources AS (SELECT doc_id, 'S_' || doc_id AS source_id, {YEAR} || ' INSC ' || doc_id AS case_id,
        CASE WHEN doc_id % 97 <> 0 THEN make_date({YEAR}::BIGINT, 1 + doc_id % 12, 1 + doc_id % 28) END AS decision_date,
        CASE WHEN doc_id % 97 <> 0 THEN {YEAR} END AS decision_year, source AS court,
        array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 1, 8), ' ') AS title, text FROM documents)""",
    "cases": f"""cases AS (SELECT d.doc_id, {YEAR.replace('doc_id', 'd.doc_id')} || '_' || d.doc_id AS id, {YEAR.replace('doc_id', 'd.doc_id')} AS query_year, d.text, l.quality AS label,
        CASE WHEN (d.doc_id // 10) % 10 < 7 THEN 'train' WHEN (d.doc_id // 10) % 10 = 7 THEN 'validation' ELSE 'test' END AS split
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "queries": f"queries AS (SELECT doc_id AS query_id, {YEAR} AS query_year, text AS query_text FROM documents WHERE doc_id % 100 = 0)",
    "pages": f"""pgs AS (SELECT doc_id, i + 1 AS page, array_to_string(list_slice(string_split(text, chr(10)), i * {CONFIG.lines_per_page} + 1, i * {CONFIG.lines_per_page} + {CONFIG.lines_per_page}), chr(10)) AS raw_text
        FROM (SELECT doc_id, text, unnest(range(0, (len(string_split(text, chr(10))) - 1) // {CONFIG.lines_per_page} + 1)) AS i FROM documents))""",
    "passages": f"passages AS (SELECT doc_id, printf('S_%d::p%04d', doc_id, page) AS chunk_id, CASE WHEN doc_id % 97 <> 0 THEN {YEAR} END AS decision_year, page, raw_text AS text FROM pgs)",
    "logits": "logits AS (SELECT vec_id % 100 AS document, vec_id AS win, embedding[1]::DOUBLE AS l0, embedding[2]::DOUBLE AS l1, ((vec_id % 100) % 2)::INT AS label FROM embeddings)",
}


def having(*names: str) -> str:
    """WITH clause of the named views."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)
