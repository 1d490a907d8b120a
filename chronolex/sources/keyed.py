"""A table kept by key: batch lookups that leave it where it lies, and ordered reading in pages.

``Keyed`` is bucketed and sorted by its key, with Bloom filters in its files. A
table of keys is dealt to the buckets and meets them there, so the kept table
is not shuffled, and the files of a single key are found by its bucket, its
range and the filter. ``Ordered`` lies in files by ranges of the key; where a
row stands in the whole order follows from its file and its place in it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

PAGE = 10_000

BITS = 1 << 22
"""Bits that tell which rows may have a wanted key: 512 KB, however many keys there are."""


def among(rows: DataFrame, key: str, wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows whose ``key`` may be one of ``wanted``; few others stay. Neither table is shuffled, so a join after it moves few rows of ``rows``."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    word, bit = F.shiftright(at, 6).cast("int"), (at % 64).cast("int")
    held = wanted.select(word.alias("word"), bit.alias("bit")).withColumn("bits", F.expr("shiftleft(1L, bit)")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    every = rows.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = held.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all"))
    of = F.get(words.select(F.col("all.bits")).scalar(), word)
    return rows.filter(F.getbit(of, bit) == 1)


class Keyed:
    def __init__(self, spark: SparkSession, name: str, key: str):
        self.spark, self.name, self.key = spark, name, key

    @classmethod
    def write(cls, rows: DataFrame, folder: str, key: str, buckets: int = 16) -> Keyed:
        """Write ``rows`` under a new name of the catalog, its files in ``folder``."""
        name = f"keyed_{uuid.uuid4().hex}"
        # each task holds one bucket, so a bucket is one sorted file
        dealt = rows.repartition(buckets, key)
        dealt.write.bucketBy(buckets, key).sortBy(key).option("path", folder).option(f"parquet.bloom.filter.enabled#{key}", "true").format("parquet").saveAsTable(name)
        return cls(rows.sparkSession, name, key)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def get(self, *values) -> DataFrame:
        """Rows of a few keys, which reach the scan as literals."""
        return self.table().filter(F.col(self.key).isin(list(values)))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is in ``keys``; only ``keys`` is shuffled."""
        return self.table().join(keys.select(self.key).hint("shuffle_merge"), self.key, "left_semi")

    def missing(self, keys: DataFrame) -> DataFrame:
        """Keys without a row."""
        return keys.select(self.key).distinct().join(self.table().select(self.key).hint("shuffle_merge"), self.key, "left_anti")

    def drop(self) -> None:
        """Forget the name; the files stay for whoever made the folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class Ordered:
    """Rows by a key that is unique and not null."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder, key
        self.rows = spark.read.parquet(folder)

    @classmethod
    def write(cls, rows: DataFrame, folder: str, key: str) -> Ordered:
        rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").parquet(folder)
        return cls(rows.sparkSession, folder, key)

    def _files(self) -> DataFrame:
        """(file, least, most, n, before): a row per file, with how many rows come before it."""
        files = self.rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(self.key).alias("least"), F.max(self.key).alias("most"), F.count("*").alias("n"))
        earlier = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
        return files.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    def numbered(self, size: int = PAGE) -> DataFrame:
        """All rows with their ``place`` in the order, from 0, and their ``page``; nothing but the counts of files is sorted."""
        at = self.rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("_index"))
        placed = at.join(self._files().select("file", "before"), "file").withColumn("place", F.col("before") + F.col("_index"))
        return placed.withColumn("page", F.floor(F.col("place") / size)).drop("file", "before", "_index")

    def pages(self, size: int = PAGE, after=None) -> Iterator[tuple[list[Row], object]]:
        """Pages of ``size`` rows in order and the token to go on from, each page read by itself: (rows, token).

        ``after`` is the token of the last page that was read. A page opens only the
        files that its keys can be in.
        """
        files = self._files().orderBy("least").select("least", "most", "n").collect()  # a row per file
        while True:
            ahead, reach = 0, None
            for f in files:
                if after is None or f["most"] > after:
                    ahead += f["n"] if after is None or f["least"] > after else 0
                    reach = f["most"]
                    if ahead >= size:
                        break
            if reach is None:
                return
            part = self.rows.filter(F.col(self.key) <= reach)
            got = (part if after is None else part.filter(F.col(self.key) > after)).orderBy(self.key).limit(size).collect()
            if not got:
                return
            after = got[-1][self.key]
            yield got, after
