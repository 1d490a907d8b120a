"""The best k chunks of every query without scoring all that match.

A threshold comes first: the k-th best score that a query's best blocks alone
give, which no final score of the best k is below. Terms whose greatest
contributions add up to less than it cannot bring a chunk among the best, so
only chunks with one of the other, essential terms are scored, by those terms
first; what still can pass the k-th best of these sums is completed from the
chunk's own vector. Every bound holds for the whole index, so the result is
that of scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import temporal
from ..sources.index import Index, bucket, impact, postings_of
from ..sources.store import Scratch
from .retrieval import SALTS

FIRST = 0.5
"""Blocks that the first round opens for each wanted chunk."""

SLACK = 1e-5
"""Scores are rounded to six places before they are ranked."""


def weighted(index: Index, terms: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query_year, term, w, bucket): query terms with weight times idf over the whole index."""
    n, _ = index.size()
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    met = terms.join(index.terms(), "term").join(queries.select("query_id", "query_year"), "query_id")
    return met.select("query_id", "query_year", "term", (F.col("weight") * F.when(idf <= 0, CONFIG.least_idf).otherwise(idf)).alias("w"), bucket(F.col("term"), index.buckets).alias("bucket"))


def pruned(blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """Blocks in the buckets of the wanted terms: the scan leaves out the folders of all others when it starts."""
    wanted = weights.agg(F.collect_set("bucket")).scalar()  # at most as many numbers as there are buckets
    return blocks.filter(F.array_contains(wanted, F.col("bucket")))


@dataclass
class Search:
    """Steps of a search, each a table; ``found`` is the result."""

    heads: DataFrame
    first: DataFrame
    essential: DataFrame
    candidates: DataFrame
    found: DataFrame


def _kth(sums: DataFrame, k: int, column: str) -> DataFrame:
    """(query_id, floor): the k-th best sum of each query that has so many."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(column)))
    return sums.select("query_id", column, rank.alias("_r")).filter(F.col("_r") <= k).filter(F.col("_r") == k).select("query_id", F.col(column).alias("floor"))


def search(index: Index, terms: DataFrame, queries: DataFrame, k: int, eligible: bool, scratch: Scratch) -> Search:
    """The best ``k`` of every query as ``retrieval.top_k`` gives them. ``eligible``: only chunks before the query's year compete."""
    n, avgdl = index.size()
    mean = F.lit(avgdl or 1.0)
    weights = scratch.write(weighted(index, terms, queries), "weights")
    blocks = pruned(index.blocks(), weights)
    in_time = (F.col("min_year") < F.col("query_year")) if eligible else F.lit(True)
    # impacts grow with the mean length by no more than its own growth
    bound = F.col("w") * F.col("impact") * F.greatest(F.lit(1.0), mean / F.col("built_with"))
    heads = scratch.write(blocks.select("segment", "tier", "bucket", "term", "block", "n", "impact", "min_year", "built_with").join(weights.drop("bucket"), "term").filter(in_time).withColumn("bound", bound), "heads")

    def scored(met: DataFrame) -> DataFrame:
        entries = index.alive(met.select("segment", "query_id", "query_year", "w", F.explode("entries").alias("e")).select("segment", "query_id", "query_year", "w", "e.*"))
        if eligible:
            entries = entries.filter(F.col("decision_year") < F.col("query_year"))
        return entries.groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * impact(F.col("tf"), F.col("dl"), mean)).alias("part"))

    # first round: the blocks with the best bounds among those of high impact
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "term", "block"))
    most = max(2, int(FIRST * k))
    first = scratch.write(heads.filter("tier = 0").withColumn("_r", rank).filter(F.col("_r") <= most).select("segment", "bucket", "term", "block", "query_id", "query_year", "w", "n"), "first")
    opened = pruned(index.blocks().filter("tier = 0"), first).select("segment", "term", "block", "entries")
    floor = _kth(scored(opened.join(first, ["segment", "term", "block"])), k, "part")

    # terms by their greatest contribution: the first ones that stay below the floor together are not essential
    most_of = heads.groupBy("query_id", "query_year", "term").agg(F.max("bound").alias("most"), F.first("w").alias("w"))
    up_to = F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("most").over(Window.partitionBy("query_id"))
    ranked = most_of.join(floor, "query_id", "left").withColumn("up_to", up_to).withColumn("total", total).withColumn("least", F.coalesce(F.col("floor") - SLACK, F.lit(float("-inf"))))
    split = scratch.write(ranked.select("query_id", "query_year", "term", "w", "most", "total", "least", (F.col("up_to") >= F.col("least")).alias("essential"), bucket(F.col("term"), index.buckets).alias("bucket")), "split")
    needed = split.filter("essential")
    rest = split.filter("not essential").groupBy("query_id").agg(F.sum("most").alias("rest"))
    salted = needed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("bucket")
    dealt = pruned(index.blocks(), needed).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
    passing = (bound + F.col("total") - F.col("most") >= F.col("least")) & in_time
    essential = dealt.join(salted, ["term", "salt"]).filter(passing)
    sums = scratch.write(scored(essential), "sums")
    higher = _kth(sums, k, "part").withColumnRenamed("floor", "higher")
    kept = sums.join(split.select("query_id", "least").distinct(), "query_id").join(rest, "query_id", "left").join(higher, "query_id", "left")
    can_pass = F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.greatest("least", F.coalesce(F.col("higher") - SLACK, F.col("least")))
    candidates = scratch.write(kept.filter(can_pass).select("query_id", "chunk_id"), "candidates")

    # what is left is scored from the chunk's own terms
    wanted = split.groupBy("query_id", "query_year").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("ws"))
    rows = index.vectors().drop("segment").join(candidates, "chunk_id").join(wanted, "query_id").withColumn("key", F.struct("query_id", "chunk_id", "doc_id", "decision_year", "query_year"))
    own = postings_of(rows.select("key", "ws", "dl", "terms")).withColumn("w", F.try_element_at("ws", F.col("term"))).filter("w is not null")
    score = own.groupBy("key").agg(F.round(F.sum(F.col("w") * impact(F.col("tf"), F.col("dl"), mean)), 6).alias("score")).select("key.*", "score")
    marked = score.withColumn("status", temporal.status(F.col("query_year"), F.col("decision_year")))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    found = marked.withColumn("rank", best.cast("long")).filter(F.col("rank") <= k)
    return Search(heads, first, essential.select("query_id", "term", "n"), candidates, found)


def top_k(index: Index, terms: DataFrame, queries: DataFrame, k: int = CONFIG.top_k, before: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """Ranked candidates with their time status. ``before``: only eligible ones compete; else all do."""
    return search(index, terms, queries, k, before, scratch or Scratch(queries.sparkSession)).found
