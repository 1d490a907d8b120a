"""Deterministic samples and latest rows. Hash order replaces a seeded generator, so any engine can repeat it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 17) -> DataFrame:
    """``n`` rows in hash order of their key; only the best of each partition travel."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(n)


def stratified(rows: DataFrame, key: str, strata: list[str], n: int, seed: int = 17) -> DataFrame:
    """Up to ``n`` rows of each stratum in hash order."""
    w = Window.partitionBy(*strata).orderBy(hash_order(F.col(key), seed), key)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def digest(rows: DataFrame, line: Column, order: Column, per: int = 1000, *keys: str) -> DataFrame:
    """(keys, digest, n): SHA-256 over the digests of runs of lines, in order of a whole-number key.

    A run holds the lines whose key is the same multiple of ``per``; the digests
    of runs are put together in runs again until one is left, so no task holds
    more than ``per`` of them, however many rows there are. Keys may not repeat.
    """
    level = rows.select(*keys, order.cast("long").alias("_k"), F.sha2(line, 256).alias("_h"), F.lit(1).cast("long").alias("_n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_h"))), lambda x: x["_h"])
    widest = rows.agg(F.max(F.abs(order.cast("long")))).first()[0] or 0
    while True:
        level = level.groupBy(*keys, F.floor(F.col("_k") / per).cast("long").alias("_r")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("_h"), F.sum("_n").alias("_n")).withColumnRenamed("_r", "_k")
        widest //= per
        if not widest:
            return level.select(*keys, F.col("_h").alias("digest"), F.col("_n").alias("n"))
