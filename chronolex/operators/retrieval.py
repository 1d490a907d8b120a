"""Inverted index, BM25 under the strict time rule, and selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, PROCEDURAL_STOP_WORDS
from ..functions import temporal
from ..functions import text as T
from ..sources.index import postings_of


def postings(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(term, key, tf)."""
    return chunks.select(key, F.explode(T.index_tokens(F.col("text"))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame, *carry: str, key: str = "chunk_id") -> DataFrame:
    """(key, dl): index tokens per chunk, counted without a shuffle."""
    return chunks.select(key, *carry, F.size(T.index_tokens(F.col("text"))).cast("long").alias("dl"))


def query_terms(queries: DataFrame, mode: str = "salient") -> DataFrame:
    """(query_id, term, weight): the query's terms, with how often each counts."""
    if mode == "legacy":
        first = F.slice(T.query_tokens(F.col("query_text")), 1, CONFIG.query_terms)
        return queries.select("query_id", F.explode(first).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight"))
    return salient_terms(queries).select("query_id", "term", F.lit(1).cast("long").alias("weight"))


def segments(queries: DataFrame) -> DataFrame:
    """(query_id, segment, body): paragraphs and sentences with four tokens or more, else the whole text."""
    cut = F.split("query_text", r"(?:\r?\n){2,}|(?<=[.!?])\s+")
    kept = F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.size(F.regexp_extract_all(s, F.lit("[A-Za-z0-9]{2,}"), F.lit(0))) >= 4)
    parts = F.when(F.size(kept) > 0, kept).otherwise(F.array("query_text"))
    return queries.select("query_id", F.posexplode(parts).alias("segment", "body"))


def salient_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, score, first, rank): terms by their best TF-IDF in a segment, frequency and legal references."""
    stop = [F.lit(w) for w in PROCEDURAL_STOP_WORDS]
    tokens = queries.select("query_id", F.posexplode(T.query_tokens(F.col("query_text"))).alias("pos", "term"))
    counts = tokens.groupBy("query_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    seg = segments(queries)
    total = seg.groupBy("query_id").agg(F.count("*").alias("segments"))
    bounded = F.regexp_extract_all(F.lower("body"), F.lit(r"(?U)\b[a-zA-Z0-9]{2,}\b"), F.lit(0))
    tf = seg.select("query_id", "segment", F.explode(bounded).alias("term")).filter(~F.col("term").isin(*stop)).groupBy("query_id", "segment", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    weighted = tf.join(df, ["query_id", "term"]).join(total, "query_id").withColumn("w", F.col("tf") * (F.log((1 + F.col("segments")) / (1 + F.col("df"))) + 1))
    norm = weighted.groupBy("query_id", "segment").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    best = weighted.join(norm, ["query_id", "segment"]).groupBy("query_id", "term").agg(F.max(F.col("w") / F.col("norm")).alias("tfidf"))
    some = best.select("query_id").distinct().withColumn("scored", F.lit(True))
    legal = r"\b(section|sections|article|articles)\s+(\d+[a-z]*)"
    folded = T.casefold(F.col("query_text"))
    names = F.transform(F.regexp_extract_all(folded, F.lit(legal), F.lit(1)), lambda x: F.when(x.startswith("section"), "section").otherwise("article"))
    marks = queries.select("query_id", F.explode(F.array_union(names, F.regexp_extract_all(folded, F.lit(legal), F.lit(2)))).alias("term")).withColumn("boost", F.lit(CONFIG.legal_boost))
    joined = counts.join(best, ["query_id", "term"], "left").join(some, "query_id", "left").join(marks, ["query_id", "term"], "left")
    gentle = 1 + F.log1p("n")
    # a text of nothing but stop words falls back to frequency
    base = F.when(F.col("scored"), F.col("tfidf") * gentle).otherwise(F.when(~F.col("term").isin(*stop), gentle))
    scored = joined.withColumn("score", F.round(F.coalesce(base, F.lit(0.0)) + F.coalesce("boost", F.lit(0.0)), 6)).filter(base.isNotNull() | F.col("boost").isNotNull())
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "term")))
    return ranked.filter(F.col("rank") <= CONFIG.query_terms).select("query_id", "term", "score", F.col("first").cast("long"), F.col("rank").cast("long"))


SALTS = 8
"""Parts that the postings of one term are dealt to when queries meet them, as a common term is in most chunks."""


def chunk_vectors(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, decision_year, dl, terms) of every chunk. A chunk's tokens are in its row, so nothing is shuffled."""
    tokens = chunks.select("chunk_id", "doc_id", "decision_year", T.index_tokens(F.col("text")).alias("t"))
    held = tokens.select("chunk_id", "doc_id", "decision_year", F.size("t").cast("long").alias("dl"), F.coalesce("t", F.array().cast("array<string>")).alias("t"))
    kind = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    return held.mapInArrow(_terms(), f"chunk_id {kind['chunk_id']}, doc_id {kind['doc_id']}, decision_year {kind['decision_year']}, dl bigint, terms array<struct<term: string, tf: bigint>>")


def _terms():
    """Rows of tokens as rows of terms with their counts, in order; a local function, so that workers need not import this package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column("t")
            ends = np.asarray(t.offsets)
            coded = t.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
            words = coded.dictionary.take(order := pc.sort_indices(coded.dictionary))
            rank = np.empty(len(words), np.int64)
            rank[np.asarray(order)] = np.arange(len(words))
            k = max(len(words), 1)
            held, n = np.unique(np.repeat(np.arange(b.num_rows), np.diff(ends)) * k + rank[np.asarray(coded.indices)], return_counts=True)
            row, term = np.divmod(held, k)
            each = pa.StructArray.from_arrays([words.take(pa.array(term)), pa.array(n.astype(np.int64))], ["term", "tf"])
            starts = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("chunk_id", "doc_id", "decision_year", "dl")], pa.ListArray.from_arrays(starts, each)], ["chunk_id", "doc_id", "decision_year", "dl", "terms"])

    return run


def index_postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, doc_id, decision_year, dl, tf) of every chunk."""
    return postings_of(chunk_vectors(chunks))


def index_terms(postings: DataFrame) -> DataFrame:
    """(term, df, cf) over the whole index."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def index_size(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length."""
    return lengths(chunks).agg(F.count("*").alias("n_all"), F.avg("dl").alias("avgdl"))


def weighted(terms: DataFrame, statistics: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, query_year, term, w): weight times idf over ``n`` chunks, for terms that some chunk has."""
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    met = terms.join(statistics, "term").join(queries.select("query_id", "query_year"), "query_id")
    return met.select("query_id", "query_year", "term", (F.col("weight") * F.when(idf <= 0, CONFIG.least_idf).otherwise(idf)).alias("w"))


def bm25(postings: DataFrame, statistics: DataFrame, size: DataFrame, terms: DataFrame, queries: DataFrame, eligible: bool = False) -> DataFrame:
    """(query_id, query_year, chunk_id, doc_id, decision_year, score) of every chunk with a query term, from a stored index.

    Frequencies of terms, numbers of chunks and their lengths are those of the
    whole index; ``eligible`` leaves chunks that are not earlier than the query
    out before they are scored, which changes no score. Postings of one term are
    dealt to SALTS parts, so a common term is no one task's.
    """
    whole = size.select(F.struct("n_all", "avgdl")).scalar()
    weights = terms.join(statistics, "term").join(queries.select("query_id", "query_year"), "query_id").withColumn("whole", whole).select("*", "whole.*")
    idf = F.log((F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = weights.withColumn("idf", F.when(idf <= 0, CONFIG.least_idf).otherwise(idf)).select("query_id", "query_year", "term", "weight", "idf", "avgdl", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = postings.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int"))
    met = salted.join(weights, ["term", "salt"])
    if eligible:
        met = met.filter(F.col("decision_year") < F.col("query_year"))
    part = F.col("weight") * F.col("idf") * F.col("tf") * (CONFIG.k1 + 1) / (F.col("tf") + CONFIG.k1 * (1 - CONFIG.b + CONFIG.b * F.col("dl") / F.col("avgdl")))
    return met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"), F.first("doc_id").alias("doc_id"), F.first("decision_year").alias("decision_year"), F.first("query_year").alias("query_year"))


def without(candidates: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Candidates from sources that are not the query's own judgment; ``duplicates`` has (query_id, doc_id). Ranks stay."""
    return candidates.join(duplicates.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


def top_k(scored: DataFrame, k: int = CONFIG.top_k, before: bool = True) -> DataFrame:
    """Ranked candidates with their time status. ``before``: only eligible ones compete; else all do."""
    marked = scored.withColumn("status", temporal.status(F.col("query_year"), F.col("decision_year")))
    if before:
        marked = marked.filter(F.col("status") == "eligible")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return marked.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def diverse(candidates: DataFrame, n: int = CONFIG.selected) -> DataFrame:
    """The best passage of each source, then the best ``n`` of those."""
    own = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "rank"))
    best = candidates.withColumn("own", own).filter("own = 1").drop("own")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))
    return best.withColumn("position", place.cast("long")).filter(F.col("position") <= n)
