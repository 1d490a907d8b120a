"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import RunLog, Store

CHUNK_SCHEMA = "source_id string, case_id string, citation string, decision_date string, court string, title string, chunk_id string, pdf_file string, page_number int, passage_start_char int, passage_end_char int, text string, cleaning_version string, extraction_method string"
METADATA_SCHEMA = "title string, petitioner string, respondent string, citation string, case_id string, decision_date string, disposal_nature string, court string, path string, year string"
STORE_DDL = "chunk_id string, source_id string, case_id string, citation string, decision_date date, court string, title string, pdf_file string, page_number int, passage_start_char int, passage_end_char int, chunk_text string"
REQUIRED = ("source_id", "decision_date", "court", "title", "chunk_id", "pdf_file", "page_number", "passage_start_char", "passage_end_char", "text", "cleaning_version")


def read_year_files(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata files of all years. The year is a column of the files too, so folder names are not read as one."""
    return spark.read.schema(METADATA_SCHEMA).option("recursiveFileLookup", "true").parquet(folder)


def read_first_match(frames: list[DataFrame], key: str, value: str) -> DataFrame:
    """The row with a key from the first of several tables that has it."""
    tagged = [f.filter(F.col(key) == value).withColumn("_t", F.lit(k)) for k, f in enumerate(frames)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    names = [c for c in both.columns if c != "_t"]
    return both.agg(F.min_by(F.struct(*names), "_t").alias("r")).select("r.*").filter(F.col(key).isNotNull())


def read_listed(frame: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a wanted key, wanted keys that are missing)."""
    return frame.join(wanted.select(key), key, "left_semi"), wanted.select(key).join(frame.select(key), key, "left_anti")


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, malformed lines) of JSON lines; blank lines are skipped, bad ones kept aside."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", CHUNK_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.filter("r._bad is null").select("r.*").drop("_bad"), parsed.filter("r._bad is not null").select(F.col("value").alias("line"))


def read_document(spark: SparkSession, path: str, entries: str = "entries") -> DataFrame:
    """Entries of one JSON document."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode(entries).alias("e")).select("e.*")


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").csv(path)


def load_store(chunks: DataFrame, path: str) -> int:
    """Chunks as a typed table, once per id: the first by page and place. Replaces the table as a whole; its version."""
    from ..operators.alignment import first_of

    once = first_of(chunks, ["chunk_id"], [F.col("page_number"), F.col("passage_start_char"), F.col("source_id")])
    typed = once.withColumn("decision_date", F.to_date("decision_date", "dd-MM-yyyy")).withColumnRenamed("text", "chunk_text")
    return Store(chunks.sparkSession, path, STORE_DDL).load(typed, "chunk_id")


RESULTS = "run string, query_id long, rank long, chunk_id string, score double, status string"


def run_log(spark: SparkSession, folder: str) -> RunLog:
    """Retrieval runs and their results: both of a run are visible, or neither."""
    return RunLog(spark, folder, RESULTS)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


WINDOWS = "document long, window int, start int, stop int"


def write_windows(windows: DataFrame, folder: str) -> None:
    """Token windows of documents, a document's windows together and in order."""
    windows.select([c.split()[0] for c in WINDOWS.split(", ")]).repartitionByRange("document").sortWithinPartitions("document", "window").write.mode("overwrite").parquet(folder)


def read_windows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(WINDOWS).parquet(folder)


def store_table(spark: SparkSession, path: str) -> DataFrame:
    return Store(spark, path, STORE_DDL).read()


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; more than ``most`` rows are refused."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report has at most {most} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got)])


def violations(chunks: DataFrame) -> DataFrame:
    """(rule, n): required fields that are missing and passage bounds that are wrong."""
    checks = [F.sum((F.col(c).isNull() | (F.col(c).cast("string") == "")).cast("long")).alias(f"missing:{c}") for c in REQUIRED]
    bounds = F.sum(((F.col("passage_start_char") < 0) | (F.col("passage_end_char") <= F.col("passage_start_char"))).cast("long")).alias("bounds")
    wide = chunks.agg(*checks, bounds)
    return wide.unpivot([], wide.columns, "rule", "n").select("rule", F.coalesce("n", F.lit(0)).alias("n"))
