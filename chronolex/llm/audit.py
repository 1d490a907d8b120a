"""How filters interact: every order of the filters replayed over every document.

Each document is reduced to the set of filters that it fails. The sets are
crossed with a broadcast table of all orders (120 for five filters), each
document of an order gets the step at which it first fails, its steps are
exploded, and counts are taken by part, order and step in the tasks that made
the rows, so that only sums are shuffled. Texts stay where they lie: what
moves is a digest and a few numbers a document.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
SYMBOLS = r"[#$%&*|]"
MOST_FILTERS = 6
"""Orders are a broadcast table: 720 rows at most."""


def document_flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E): which filters a document fails. A null text is empty, a null source is the empty string.

    E compares SHA-256 digests of whole texts with the smallest doc_id of the same digest. Documents without an id never
    fail it, and those that share the smallest id of a text all pass it.
    """
    x = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(x, F.lit(WORD), F.lit(0))
    held = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), x.alias("x"), words.alias("w"))
    rows = held.select(
        "doc_id", "part", F.unhex(F.sha2("x", 256)).alias("digest"),
        (F.size("w") < LEAST_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("w")).cast("long") < LEAST_DISTINCT * F.size("w").cast("long")).alias("B"),
        (100 * F.regexp_count("x", F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.char_length("x").cast("long")).alias("C"),
        F.col("x").rlike(SYMBOLS).alias("D"),
    )
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.unhex(F.sha2(x, 256)).alias("_digest"))
    copied = texts.groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    met = rows.join(copied, F.col("digest") == F.col("_digest"), "left")
    return met.select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).alias("E"))


def labelled(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """``flags`` with ``good`` and ``toxic``; a document with several labels is either if any of them says so."""
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    met = flags.join(marks, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    return met.withColumn("good", F.coalesce("_good", F.lit(False))).withColumn("toxic", F.coalesce("_toxic", F.lit(False))).drop("_good", "_toxic")


def orders(flags: DataFrame, filters: str) -> DataFrame:
    """All orders: their letters, the bit of each place, and the steps as structs."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    bit = {x: 1 << k for k, x in enumerate(filters)}
    rows = [("".join(p), *(bit[x] for x in p), [(k + 1, bit[x]) for k, x in enumerate(p)]) for p in permutations(filters)]
    places = ", ".join(f"b{k + 1} int" for k in range(len(filters)))
    return flags.sparkSession.createDataFrame(rows, f"filter_order string, {places}, steps array<struct<step: int, bit: int>>")


def _first_failure(n: int) -> Column:
    """The step that removes a document with the failures ``m``; n + 1 if none does."""
    at = F.lit(n + 1)
    for k in range(n, 0, -1):
        at = F.when(F.col("m").bitwiseAND(F.col(f"b{k}")) != 0, k).otherwise(at)
    return at


def replay(flags: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``flags`` has part, good, toxic and one boolean column for each letter of ``filters``.
    """
    n = len(filters)
    m = F.lit(0)
    for k, x in enumerate(filters):
        m = m + F.when(F.col(x), 1 << k).otherwise(0)
    sets = flags.select("part", "good", "toxic", m.alias("m"))
    crossed = sets.crossJoin(F.broadcast(orders(flags, filters))).withColumn("gone", _first_failure(n))
    steps = crossed.select("part", "filter_order", "m", "good", "toxic", "gone", F.explode("steps").alias("s")).select("*", "s.step", "s.bit")
    here = F.col("gone") == F.col("step")
    counts = steps.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("gone") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if((F.col("gone") < F.col("step")) & (F.col("m").bitwiseAND(F.col("bit")) != 0)).alias("redundant"),
        F.count_if(F.col("m") == F.col("bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    # a part and a filter have as many rows as there are orders
    own = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return counts.withColumn("shapley", F.sum("removed").over(own))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per source, order and step.

    * Nulls: a null text is empty, a null source is the empty string, labels that are null or missing mark nothing.
    * Very long texts are read whole; their words are held in the memory of one task.
    * Repeated rows count as often as they occur; equal texts under one id don't fail the copy filter.
    * An empty table gives no rows, and a part without failures rows of zeros. Further columns are not read.
    """
    return replay(labelled(document_flags(docs), labels))
